"""The whole run: baskets, models, evaluation, blends and stored artifacts."""

from __future__ import annotations

import time
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pannier.config import BoostConfig, TrainConfig
from pannier.operators import evaluate as ev
from pannier.operators import tune
from pannier.operators.baskets import Prepared
from pannier.operators.pairs import item_counts, pair_counts
from pannier.operators.sampling import leave_one_out, sample_cases, train_val_split
from pannier.operators.topk import Queries
from pannier.recommend.base import Model
from pannier.recommend.boost import POOL_FACTOR, BlendedPool, ContentBoost, DenseBoost
from pannier.recommend.cooccurrence import CooccurrenceLift, SessionCooccurrence
from pannier.recommend.embedding import Item2Vec, ItemGraphNode2Vec, text_vectors
from pannier.recommend.factors import ImplicitALS, ImplicitBPR
from pannier.recommend.fusion import EnsembleRRF, PopularityRerank
from pannier.recommend.popular import TopPopular
from pannier.recommend.ranker import LambdaRanker
from pannier.session import materialise
from pannier.sources.snapshot import model_path, save_model, save_table, worth_saving

BASE_MODELS = (
    "TopPopular",
    "CooccurrenceLift",
    "Item2Vec",
    "ImplicitALS",
    "ImplicitBPR",
    "SessionCooccurrence",
    "ContentBoost",
    "ItemGraphNode2Vec",
    "STBoost",
)

#: Models that start from pair counts; those of one item table are mined once a run.
PAIR_MODELS = ("CooccurrenceLift", "SessionCooccurrence", "ContentBoost", "ItemGraphNode2Vec", "STBoost")


def chosen_models(cfg: TrainConfig) -> list[str]:
    """Base models of this run; ``only`` must name one of them."""
    enabled = [m for m in BASE_MODELS if m in cfg.models]
    if not cfg.only:
        return enabled
    if cfg.only not in enabled:
        raise ValueError(f"only={cfg.only!r} is no enabled model; choose from {enabled}")
    return [cfg.only]


def tuned(
    model: BlendedPool, cfg: BoostConfig, cases: Queries, seed: int, k: int = 5
) -> BlendedPool:
    """The model with the grid's best weights; its tables are kept as they are."""
    if not cfg.tune_weights:
        return model
    sample = materialise(sample_cases(cases.cases, cfg.tune_max_cases, seed), "tune_cases")
    subset = Queries(
        sample, cases.items.join(sample.select("query_id"), "query_id", "left_semi"), cases.max_size
    )
    parts = materialise(model.pool_parts(subset, POOL_FACTOR * k), "tune_parts")
    grid = tune.weight_grid(cfg.cooc_grid, cfg.category_grid)
    return model.with_weights(tune.best_weights(tune.grid_hits(sample, parts, grid, k)))


def fit_base(
    name: str,
    prepared: Prepared,
    cfg: TrainConfig,
    catalog: DataFrame | None,
    vectors: DataFrame | None,
    tune_on: Queries,
    mined: dict[str, DataFrame] | None = None,
) -> Model:
    """One model; ``mined`` keeps the pair counts of each item table for the models that follow."""
    level = "profiles" if name in cfg.profile_models else "orders"
    items = prepared.profile_baskets if level == "profiles" else prepared.train
    mined = {} if mined is None else mined
    if name in PAIR_MODELS and level not in mined:
        least = min(
            cfg.cooc_min_support, cfg.session_min_support, cfg.graph.min_support, cfg.content.min_support, cfg.dense.min_support
        )
        mined[level] = materialise(pair_counts(items, min_support=least), "mined_pairs")
    pairs = mined.get(level)
    if name == "TopPopular":
        return TopPopular.fit(items)
    if name == "CooccurrenceLift":
        return CooccurrenceLift.fit(items, cfg.cooc_min_support, cfg.cooc_metric, pairs)
    if name == "Item2Vec":
        return Item2Vec.fit(items, cfg.item2vec)
    if name == "ImplicitALS":
        return ImplicitALS.fit(items, cfg.als, cfg.seed)
    if name == "ImplicitBPR":
        return ImplicitBPR.fit(items, cfg.bpr, cfg.seed)
    if name == "SessionCooccurrence":
        return SessionCooccurrence.fit(
            items, prepared.histories, cfg.history_weight, cfg.session_min_support, pairs
        )
    if name == "ItemGraphNode2Vec":
        return ItemGraphNode2Vec.fit(items, cfg.graph, pairs)
    if name == "ContentBoost":
        model = ContentBoost.fit(items, catalog, cfg.content, cfg.text, pairs)
        return tuned(model, cfg.content, tune_on, cfg.seed)
    if name == "STBoost":
        if vectors is None and catalog is not None:
            vectors = text_vectors(catalog, replace(cfg.item2vec, min_count=1))
        model = DenseBoost.fit(items, catalog, vectors, cfg.dense, pairs)
        return tuned(model, cfg.dense, tune_on, cfg.seed)
    raise ValueError(f"unknown model {name!r}")


def train(
    prepared: Prepared,
    cfg: TrainConfig,
    catalog: DataFrame | None = None,
    vectors: DataFrame | None = None,
    models_dir: str | None = None,
) -> tuple[dict[str, Model], DataFrame]:
    """Fit and evaluate everything; returns the models and the long metrics table."""
    names = chosen_models(cfg)
    batches = {s: leave_one_out(prepared.split(s), cfg.seed, f"l1o_{s}") for s in ("test", "oot")}
    n_items = prepared.titles.agg(F.count(F.lit(1)))
    buckets = materialise(
        ev.item_buckets(materialise(item_counts(prepared.train), "item_counts"), cfg.n_buckets),
        "item_buckets",
    )
    top = max(cfg.k_values)
    spark = prepared.items.sparkSession
    models: dict[str, Model] = {}
    tables: list[DataFrame] = []

    def judge(model: Model, seconds: float, test: Queries | None = None) -> None:
        parts = []
        for split, queries in {**batches, **({"test": test} if test else {})}.items():
            recs = materialise(model.recommend(queries, top), f"recs_{split}")
            standard = ev.evaluate(
                queries.cases, recs, n_items, model.name, split, cfg.k_values
            )
            if split == "test":
                standard = ev.merge_metrics(
                    standard,
                    ev.debiased(
                        queries.cases, recs, buckets, model.name, split, cfg.k_values
                    ),
                )
            parts.append(standard)
        took = spark.createDataFrame(
            [(model.name, "train", "run", None, "train_time_s", seconds)], parts[0].schema
        )
        own = materialise(
            reduce(DataFrame.unionByName, [*parts, took]).coalesce(1), "metrics"
        )
        tables.append(own)
        models[model.name] = model
        if models_dir and (not cfg.skip_zero_models or worth_saving(own, model.name)):
            save_model(model, model_path(models_dir, model.name))

    mined: dict[str, DataFrame] = {}
    for name in names:
        start = time.perf_counter()
        model = fit_base(name, prepared, cfg, catalog, vectors, batches["test"], mined)
        judge(model, time.perf_counter() - start)

    if not cfg.only:
        _blends(prepared, cfg, catalog, batches, models, tables, judge)
    metrics = reduce(DataFrame.unionByName, tables)
    if models_dir:
        save_table(metrics, f"{models_dir}/metrics")
        save_table(prepared.titles, f"{models_dir}/item_titles")
        save_table(prepared.train, f"{models_dir}/train_baskets")
        save_table(prepared.profile_baskets, f"{models_dir}/profile_baskets")
    return models, metrics


def _blends(prepared, cfg, catalog, batches, models, tables, judge) -> None:
    spark = prepared.items.sparkSession
    if "PopularityRerank" in cfg.models and "ContentBoost" in models:
        start = time.perf_counter()
        # the base keeps its fit: refitting it here would drop its text signal
        model = PopularityRerank.fit(models["ContentBoost"], prepared.train, cfg.pop_weight)
        judge(model, time.perf_counter() - start)
    if "EnsembleRRF" in cfg.models:
        weights = spark.createDataFrame(list(cfg.ensemble_weights), "model string, weight double")
        chosen = ev.ensemble_members(
            reduce(DataFrame.unionByName, tables), weights, cfg.ensemble_min_hit5
        )
        members = [(models[r["model"]], r["weight"]) for r in chosen.orderBy("model").collect()]
        if len(members) >= 2:
            judge(EnsembleRRF.of(members), 0.0)
    if "LGBMEnsemble" in cfg.models:
        chosen = ev.ranker_members(reduce(DataFrame.unionByName, tables))
        members = {r["model"]: models[r["model"]] for r in chosen.orderBy("model").collect()}
        if len(members) >= 2:
            start = time.perf_counter()
            test = batches["test"]
            marked = materialise(
                train_val_split(test.cases, cfg.ranker.val_ratio, cfg.seed), "ranker_split"
            )

            def part(flag: str) -> Queries:
                cases = marked.where(flag).drop("is_val")
                return Queries(
                    cases,
                    test.items.join(cases.select("query_id"), "query_id", "left_semi"),
                    test.max_size,
                )

            model = LambdaRanker.of(
                members, prepared.train, catalog, prepared.histories, replace(cfg.ranker, seed=cfg.seed)
            ).fit(part("not is_val"))
            # only cases the ranker was not trained on judge it
            judge(model, time.perf_counter() - start, part("is_val"))
