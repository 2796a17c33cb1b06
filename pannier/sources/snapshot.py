"""Stored snapshots of prepared baskets and of fitted models."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pannier.config import DataConfig, RankerConfig
from pannier.operators.baskets import SPLITS, Prepared
from pannier.recommend import boost, cooccurrence, embedding, factors, fusion, popular, ranker
from pannier.recommend.base import MODELS, Model
from pannier.sources.csv import path_exists

# Raise when the stored tables change their meaning.
SNAPSHOT_VERSION = 1

# Short names under which models can be asked for.
SHORT_NAMES = {
    "popularity": popular.TopPopular.name,
    "cooccurrence": cooccurrence.CooccurrenceLift.name,
    "session": cooccurrence.SessionCooccurrence.name,
    "item2vec": embedding.Item2Vec.name,
    "item_graph": embedding.ItemGraphNode2Vec.name,
    "implicit_als": factors.ImplicitALS.name,
    "implicit_bpr": factors.ImplicitBPR.name,
    "content_boost": boost.ContentBoost.name,
    "st_boost": boost.DenseBoost.name,
    "popularity_rerank": fusion.PopularityRerank.name,
    "ensemble": fusion.EnsembleRRF.name,
    "lgbm_ensemble": ranker.LambdaRanker.name,
}


def _write_meta(spark: SparkSession, path: str, meta: dict[str, Any]) -> None:
    text = json.dumps(meta, sort_keys=True)
    spark.createDataFrame([(text,)], "meta string").coalesce(1).write.mode("overwrite").parquet(path)


def _read_meta(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.parquet(path).first()["meta"])


def save_prepared(prepared: Prepared, cfg: DataConfig, path: str) -> None:
    """The version is written last: an interrupted save is not taken for a snapshot."""
    for name in Prepared.TABLES:
        writer = getattr(prepared, name).write.mode("overwrite")
        if name == "items":
            writer = writer.partitionBy(*SPLITS)
        writer.parquet(f"{path}/{name}")
    meta = {"version": SNAPSHOT_VERSION, "config": asdict(cfg)}
    _write_meta(prepared.items.sparkSession, f"{path}/_meta_table", meta)


def load_prepared(spark: SparkSession, cfg: DataConfig, path: str) -> Prepared | None:
    """The stored tables, or None when version or settings differ."""
    if not path_exists(spark, f"{path}/_meta_table"):
        return None
    meta = _read_meta(spark, f"{path}/_meta_table")
    want = json.loads(json.dumps({"version": SNAPSHOT_VERSION, "config": asdict(cfg)}))
    if meta != want:
        return None
    return Prepared(
        **{name: spark.read.parquet(f"{path}/{name}") for name in Prepared.TABLES}
    )


def prepared_or_built(
    spark: SparkSession, cfg: DataConfig, path: str, build: Callable[[], Prepared]
) -> Prepared:
    found = load_prepared(spark, cfg, path)
    if found is None:
        save_prepared(build(), cfg, path)
        found = load_prepared(spark, cfg, path)
    return found


def save_model(model: Model, path: str) -> None:
    """Tables as Parquet, settings as one JSON document, base models below."""
    parts = model.components()
    spark = SparkSession.active()
    for name, df in model.tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    for name, part in parts.items():
        save_model(part, f"{path}/components/{name}")
    meta = {
        "model": model.name,
        "params": model.params,
        "tables": sorted(model.tables),
        "components": list(parts),
        "config": asdict(model.cfg) if isinstance(model, ranker.LambdaRanker) else None,
    }
    _write_meta(spark, f"{path}/_meta_table", meta)


def read_model(spark: SparkSession, path: str) -> Model:
    if not path_exists(spark, f"{path}/_meta_table"):
        raise FileNotFoundError(f"no model at {path}; run training first")
    meta = _read_meta(spark, f"{path}/_meta_table")
    tables = {t: spark.read.parquet(f"{path}/tables/{t}") for t in meta["tables"]}
    parts = {c: read_model(spark, f"{path}/components/{c}") for c in meta["components"]}
    kind = MODELS[meta["model"]]
    if kind is fusion.PopularityRerank:
        return kind(meta["params"], tables, next(iter(parts.values())))
    if kind is fusion.EnsembleRRF:
        return kind(meta["params"], tables, parts)
    if kind is ranker.LambdaRanker:
        return kind(meta["params"], tables, parts, RankerConfig(**meta["config"]))
    return kind(meta["params"], tables)


def model_path(models_dir: str, name: str) -> str:
    return f"{models_dir}/{name.lower()}_model"


def load_model(spark: SparkSession, short_name: str, models_dir: str) -> Model:
    if short_name not in SHORT_NAMES:
        raise ValueError(f"unknown model {short_name!r}; choose from {sorted(SHORT_NAMES)}")
    return read_model(spark, model_path(models_dir, SHORT_NAMES[short_name]))


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_report(report: DataFrame, path: str) -> None:
    """A one-row JSON report as one text document."""
    report.select("report").coalesce(1).write.mode("overwrite").text(path)


def load_titles(spark: SparkSession, models_dir: str) -> DataFrame:
    path = f"{models_dir}/item_titles"
    if not path_exists(spark, path):
        return spark.createDataFrame([], "item_id long, title string")
    return spark.read.parquet(path)


def load_metrics(spark: SparkSession, models_dir: str) -> DataFrame:
    path = f"{models_dir}/metrics"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no metrics at {path}; run training first")
    return spark.read.parquet(path)


def worth_saving(metrics: DataFrame, model: str) -> bool:
    """False when the model's Hit@5 or MRR on the test split is zero."""
    row = (
        metrics.where(
            (F.col("model") == model)
            & (F.col("split") == "test")
            & (F.col("scope") == "micro")
            & F.col("metric").isin("hit@5", "mrr")
        )
        .agg(F.min("value").alias("low"), F.count(F.lit(1)).alias("n"))
        .first()
    )
    return row["n"] == 2 and row["low"] > 0
