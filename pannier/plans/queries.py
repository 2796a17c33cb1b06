"""Registered queries over a star schema of orders, lines, parts, texts and vectors.

Queries on prepared data share one workspace per session and data folder: its
tables are built by Spark from the given tables on first use and stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pannier.config import (
    BoostConfig,
    DataConfig,
    EmbeddingConfig,
    FactorConfig,
    GraphConfig,
    RankerConfig,
    TextConfig,
)
from pannier.functions.scalar import parse_mixed, strip_tags
from pannier.operators import baskets as bk
from pannier.operators import content, context, features, health, pairs, sampling, tune
from pannier.operators import evaluate as ev
from pannier.operators.nearest import nearest
from pannier.operators.numbering import popularity_rank
from pannier.operators.topk import Queries, top_k
from pannier.operators.walks import random_walks
from pannier.plans import reports
from pannier.recommend import embedding
from pannier.recommend.boost import ContentBoost, DenseBoost
from pannier.recommend.cooccurrence import CooccurrenceLift, SessionCooccurrence
from pannier.recommend.embedding import Item2Vec, ItemGraphNode2Vec, graph_edges
from pannier.recommend.factors import ImplicitALS, ImplicitBPR
from pannier.recommend.fusion import EnsembleRRF, PopularityRerank
from pannier.recommend.popular import TopPopular
from pannier.recommend.ranker import LambdaRanker
from pannier.session import materialise, run_dir
from pannier.sources import csv, tpch
from pannier.streaming.baskets import append_partial_baskets, merged_baskets
from pannier.streaming.pairs import PairStore, advance_pairs

DATA = DataConfig(success_statuses=("F", "O"), train_days=1825, test_days=210, oot_days=210)
OVERLAP = DataConfig(success_statuses=("F", "O"), train_days=1825, test_days=600, oot_days=210)
K = 10
TOP = 20
GRID = ((0.5, 0.6, 0.7), (0.15, 0.25, 0.35))
SEED = 42
BUCKETS = 5
RANKER = RankerConfig(n_candidates=20, rounds=5, learning_rate=0.1, max_train_cases=0)

Query = Callable[[SparkSession, str], DataFrame]


class Workspace:
    """Tables and models several queries start from, each built once."""

    _open: dict[tuple[str, str], Workspace] = {}

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Workspace:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._open:
            cls._open[key] = cls(spark, sf_dir)
        return cls._open[key]

    @cached_property
    def prepared(self) -> bk.Prepared:
        lines = tpch.order_lines(self.spark, self.sf_dir, titles=False)
        return bk.prepare(lines, DATA, tpch.item_names(self.spark, self.sf_dir))

    @property
    def train(self) -> DataFrame:
        return self.prepared.train

    @cached_property
    def catalog(self) -> DataFrame:
        return tpch.catalog(self.spark, self.sf_dir)

    @cached_property
    def vectors(self) -> DataFrame:
        return tpch.item_vectors(self.spark, self.sf_dir)

    @cached_property
    def test(self) -> Queries:
        return sampling.leave_one_out(self.prepared.split("test"), SEED, "l1o_test")

    @cached_property
    def oot(self) -> Queries:
        return sampling.leave_one_out(self.prepared.split("oot"), SEED, "l1o_oot")

    @cached_property
    def counts(self) -> DataFrame:
        return materialise(pairs.item_counts(self.train), "counts")

    @cached_property
    def pairs(self) -> DataFrame:
        """Pairs of the training baskets, mined once for all models."""
        return materialise(pairs.pair_counts(self.train), "mined_pairs")

    @cached_property
    def popular(self) -> TopPopular:
        return TopPopular.fit(self.train)

    @cached_property
    def cooc(self) -> CooccurrenceLift:
        return CooccurrenceLift.fit(self.train, 1, "npmi", self.pairs)

    @cached_property
    def session(self) -> SessionCooccurrence:
        return SessionCooccurrence.fit(self.train, self.prepared.histories, 0.3, 1, self.pairs)

    @cached_property
    def content(self) -> ContentBoost:
        return ContentBoost.fit(self.train, self.catalog, BoostConfig(min_support=1), mined=self.pairs)

    @cached_property
    def dense(self) -> DenseBoost:
        cfg = BoostConfig(0.5, 0.2, 0.3, min_support=1)
        return DenseBoost.fit(self.train, self.catalog, self.vectors, cfg, self.pairs)

    @cached_property
    def cooc_recs(self) -> DataFrame:
        return materialise(self.cooc.recommend(self.test, TOP), "cooc_recs")

    @cached_property
    def popular_recs(self) -> DataFrame:
        return materialise(self.popular.recommend(self.test, TOP), "popular_recs")

    @cached_property
    def n_items(self) -> DataFrame:
        return self.prepared.titles.agg(F.count(F.lit(1)))

    @cached_property
    def buckets(self) -> DataFrame:
        return materialise(ev.item_buckets(self.counts, BUCKETS), "buckets")

    @cached_property
    def metrics(self) -> DataFrame:
        """Micro metrics of two models on test and out-of-time."""
        out = None
        for model in (self.popular, self.cooc):
            for split, queries in (("test", self.test), ("oot", self.oot)):
                recs = model.recommend(queries, TOP)
                part = ev.evaluate(queries.cases, recs, self.n_items, model.name, split)
                out = part if out is None else out.unionByName(part)
        return materialise(out, "metrics")

    @cached_property
    def ranker(self) -> LambdaRanker:
        members = {m.name: m for m in (self.popular, self.cooc)}
        return LambdaRanker.of(
            members, self.train, self.catalog, self.prepared.histories, RANKER, self.pairs
        )


def _r(df: DataFrame, *names: str) -> DataFrame:
    """Round doubles to six places so that engines agree on the last digits.

    The small shift keeps a value on a rounding limit on one side whatever the
    order of summation was.
    """
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _recs(df: DataFrame) -> DataFrame:
    return _r(_long(df, "rank"), "score").select("query_id", "rank", "item_id", "score")


def _good(spark: SparkSession, d: str, titles: bool = False) -> DataFrame:
    return bk.successful(tpch.order_lines(spark, d, titles), DATA.success_statuses)


# ---- baskets -------------------------------------------------------------------------


def status_filter(spark, d):
    return _good(spark, d).select("order_id", "item_id", "pos", "status")


def basket_assembly(spark, d):
    return bk.basket_lines(_good(spark, d))


def basket_dedup(spark, d):
    return bk.order_items(_good(spark, d)).where("item_id is not null").select(
        "order_id", "item_id", "pos"
    )


def order_headers(spark, d):
    return bk.order_headers(bk.order_items(_good(spark, d)))


def item_titles(spark, d):
    return bk.item_titles(_good(spark, d, titles=True))


def split_bounds(spark, d):
    return bk.split_bounds(bk.order_headers(bk.order_items(_good(spark, d))), DATA)


def temporal_split(spark, d):
    return bk.temporal_split(bk.order_headers(bk.order_items(_good(spark, d))), DATA)


def temporal_split_overlap(spark, d):
    return bk.temporal_split(bk.order_headers(bk.order_items(_good(spark, d))), OVERLAP)


def split_counts(spark, d):
    return bk.split_summary(Workspace.of(spark, d).prepared.orders)


def user_histories(spark, d):
    return bk.histories(Workspace.of(spark, d).train)


def profile_baskets(spark, d):
    return bk.profile_baskets(Workspace.of(spark, d).prepared.histories).select(
        F.col("order_id").alias("profile_id"), "item_id", "size"
    )


def csv_baskets(spark, d):
    """Order lines written as CSV in the raw column names, times in four forms and some titles
    with a line break, and read back."""
    path = f"{run_dir(spark)}/csv_lines-{uuid.uuid4().hex[:12]}"
    lines = tpch.order_lines(spark, d)
    forms = ("dd.MM.yyyy HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS", "yyyy-MM-dd HH:mm:ssXX")
    text = F.coalesce(*[F.when(F.col("order_id") % 4 == k, F.date_format("created_at", f)) for k, f in enumerate(forms)])
    broken = F.when(F.col("item_id") % 5 == 0, F.concat("title", F.lit(",\nsecond line"))).otherwise(F.col("title"))
    lines.select(
        text.alias("created_at"),
        "profile_id",
        F.col("order_id").alias("order_oms_id"),
        F.col("item_id").alias("order_item_oms_id"),
        broken.alias("order_item_title"),
        F.col("status").alias("order_status_title"),
    ).write.mode("overwrite").option("header", True).csv(path)
    back = bk.successful(csv.read_order_lines(spark, path, DATA), DATA.success_statuses)
    return bk.order_headers(bk.order_items(back)).select(
        "order_id", "profile_id", "size", F.col("order_ts").cast("timestamp_ntz").alias("order_ts")
    )


def mixed_timestamps(spark, d):
    """Order dates written in twelve forms by turns and parsed back."""
    orders = tpch.table(spark, d, "orders")
    forms = (
        "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXX",
        "yyyy-MM-dd", "yyyy/MM/dd HH:mm", "yyyy-M-d H:mm", "MM/dd/yyyy", "MMM d, yyyy", "d MMMM yyyy HH:mm", "M/d/yyyy h:mm:ss a",
    )
    turn = F.col("o_orderkey") % len(forms)
    text = F.coalesce(*[F.when(turn == k, F.date_format("o_orderdate", f)) for k, f in enumerate(forms)])
    return orders.select(
        F.col("o_orderkey").alias("order_id"), parse_mixed(text).cast("timestamp_ntz").alias("created_at")
    )


def csv_rejects(spark, d):
    """Order lines written as CSV with times and ids that cannot be read among them: what is rejected, how often,
    and how many lines are left (column ``kept``)."""
    path = f"{run_dir(spark)}/csv_rejects-{uuid.uuid4().hex[:12]}"
    lines = tpch.order_lines(spark, d, titles=False)

    def spoilt(every: int, text: str, value):
        return F.when(F.col("item_id") % every == 1, F.lit(text)).otherwise(value.cast("string"))

    lines.select(
        spoilt(11, "soon", F.date_format("created_at", "yyyy/M/d H:mm")).alias("created_at"),
        spoilt(7, "12.7", F.col("profile_id")).alias("profile_id"),
        F.when(F.col("order_id") % 9 == 0, F.concat("order_id", F.lit(".0"))).otherwise(F.col("order_id").cast("string")).alias("order_oms_id"),
        spoilt(13, "x3", F.col("item_id")).alias("order_item_oms_id"),
        F.lit("t").alias("order_item_title"),
        F.col("status").alias("order_status_title"),
    ).write.mode("overwrite").option("header", True).csv(path)
    return csv.line_counts(spark, path, DATA)


def stream_baskets(spark, d):
    """Lines arrive as a stream of files, joined to the orders they belong to."""
    orders = tpch.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("profile_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
    )
    schema = tpch.table(spark, d, "lineitem").schema
    arriving = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("pathGlobFilter", "lineitem.parquet")
        .parquet(d)
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("item_id"),
            (F.shiftleft(F.col("l_linenumber").cast("long"), 40) + F.col("l_partkey")).alias("pos"),
        )
        .join(orders, "order_id")
    )
    base = f"{run_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    query = append_partial_baskets(
        arriving, DATA.success_statuses, f"{base}/parts", f"{base}/checkpoint"
    )
    query.awaitTermination()
    merged = merged_baskets(spark.read.parquet(f"{base}/parts"))
    return merged.select("order_id", "item_id", "pos", "profile_id")


def stream_pairs(spark, d):
    """Pairs of all successful orders, mined batch by batch: the lines of an order arrive in any of eight files."""
    base = f"{run_dir(spark)}/stream-pairs-{uuid.uuid4().hex[:12]}"
    lines = tpch.order_lines(spark, d, titles=False).select("order_id", "item_id", "status")
    lines.repartition(8).write.parquet(f"{base}/lines")
    arriving = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/lines")
    store = PairStore(spark, f"{base}/store")
    advance_pairs(arriving, DATA.success_statuses, store, f"{base}/checkpoint").awaitTermination()
    return store.pairs()


# ---- associations --------------------------------------------------------------------


def item_frequency(spark, d):
    return pairs.item_counts(Workspace.of(spark, d).train)


def popularity_order(spark, d):
    return popularity_rank(Workspace.of(spark, d).counts)


def pair_counts(spark, d):
    return pairs.pair_counts(Workspace.of(spark, d).train)


def pair_counts_supported(spark, d):
    return pairs.pair_counts(Workspace.of(spark, d).train, min_support=2)


def _assoc(metric: str) -> Query:
    def query(spark, d):
        ws = Workspace.of(spark, d)
        total = pairs.basket_total(ws.train)
        return _r(pairs.association_table(ws.train, ws.counts, total, metric, 2), "score")

    return query


def category_lift(spark, d):
    ws = Workspace.of(spark, d)
    total = pairs.basket_total(ws.train)
    table = pairs.category_affinity(ws.train, ws.catalog, total)
    return _r(table.select("cat_a", "cat_b", "affinity"), "affinity")


def item_graph_edges(spark, d):
    return graph_edges(Workspace.of(spark, d).train, 2)


# ---- cases and samples ---------------------------------------------------------------


def l1o(spark, d):
    return sampling.held_out(Workspace.of(spark, d).prepared.split("test"), SEED)


def l1o_items(spark, d):
    return Workspace.of(spark, d).test.items


def stratified_l1o(spark, d):
    ws = Workspace.of(spark, d)
    out = sampling.stratified_cases(ws.test.cases, ws.buckets, None, SEED)
    return _long(out.select("query_id", "held_out", "bucket"), "bucket")


def tune_subset(spark, d):
    return sampling.sample_cases(Workspace.of(spark, d).test.cases, 300, SEED).select(
        "query_id", "held_out"
    )


def rank_train_val_split(spark, d):
    ws = Workspace.of(spark, d)
    return sampling.train_val_split(ws.test.cases, 0.3, SEED).select("query_id", "is_val")


def example_basket(spark, d):
    return sampling.example_basket(Workspace.of(spark, d).train, SEED)


# ---- recommenders --------------------------------------------------------------------


def top_popular_recs(spark, d):
    ws = Workspace.of(spark, d)
    return _recs(ws.popular.recommend(ws.test, K))


def cooc_recs(spark, d):
    ws = Workspace.of(spark, d)
    return _recs(ws.cooc.recommend(ws.test, K))


def session_recs(spark, d):
    ws = Workspace.of(spark, d)
    return _recs(ws.session.recommend(ws.test, K))


def content_boost_recs(spark, d):
    ws = Workspace.of(spark, d)
    return _recs(ws.content.recommend(ws.test, K))


def dense_boost_recs(spark, d):
    ws = Workspace.of(spark, d)
    return _recs(ws.dense.recommend(ws.test, K))


def popularity_rerank(spark, d):
    ws = Workspace.of(spark, d)
    return _recs(PopularityRerank.fit(ws.cooc, ws.train).recommend(ws.test, K))


def rrf_ensemble(spark, d):
    ws = Workspace.of(spark, d)
    model = EnsembleRRF.of([(ws.popular, 1.0), (ws.cooc, 1.2)])
    return _recs(model.recommend(ws.test, K))


def context_pairs(spark, d):
    """How often two items of the training baskets stand within five places, rare items left out first."""
    words = context.basket_words(Workspace.of(spark, d).train)
    return context.context_pairs(context.frequent_words(words, 2), 5)


def item2vec_recs(spark, d):
    ws = Workspace.of(spark, d)
    model = Item2Vec.fit(ws.train, EmbeddingConfig())
    return _recs(model.recommend(ws.test, K))


def als_recs(spark, d):
    ws = Workspace.of(spark, d)
    model = ImplicitALS.fit(ws.train, FactorConfig())
    return _recs(model.recommend(ws.test, K))


def bpr_recs(spark, d):
    ws = Workspace.of(spark, d)
    model = ImplicitBPR.fit(ws.train, FactorConfig(iterations=100))
    return _recs(model.recommend(ws.test, K))


def graph_walk_recs(spark, d):
    ws = Workspace.of(spark, d)
    return _recs(ItemGraphNode2Vec.fit(ws.train, GraphConfig(), ws.pairs).recommend(ws.test, K))


def graph_walks(spark, d):
    edges = materialise(graph_edges(Workspace.of(spark, d).train, 2), "walk_edges")
    return _long(random_walks(edges, GraphConfig().walk_length, GraphConfig().num_walks, SEED), "walk", "step")


def lambdarank_recs(spark, d):
    ws = Workspace.of(spark, d)
    if not ws.ranker.params["trees"]:
        ws.ranker.fit(ws.test)
    return _recs(ws.ranker.recommend(ws.oot, K))


def feature_importance(spark, d):
    ws = Workspace.of(spark, d)
    if not ws.ranker.params["trees"]:
        ws.ranker.fit(ws.test)
    return ws.ranker.importance().limit(10)


# ---- content -------------------------------------------------------------------------


def html_strip(spark, d):
    return tpch.table(spark, d, "pages").select(
        "page_id", strip_tags(F.col("html")).alias("description")
    )


def tfidf_weights(spark, d):
    """Names of all parts."""
    cfg = TextConfig()
    texts = content.with_text(tpch.catalog(spark, d))
    counts, vocab = content.text_tables(texts, cfg)
    return _r(
        content.tfidf(counts, vocab, content.text_count(texts), cfg.sublinear_tf), "weight"
    )


def tfidf_documents(spark, d):
    """Whole texts of all documents."""
    cfg = TextConfig()
    texts = content.with_text(
        tpch.table(spark, d, "documents").select(
            F.col("doc_id").alias("item_id"), F.col("text").alias("description")
        )
    )
    counts, vocab = content.text_tables(texts, cfg)
    return _r(
        content.tfidf(counts, vocab, content.text_count(texts), cfg.sublinear_tf), "weight"
    )


def category_scores(spark, d):
    ws = Workspace.of(spark, d)
    out = content.category_scores(
        ws.test.items, ws.cooc_recs, ws.catalog, ws.content.tables["affinity"]
    )
    return _r(out, "category")


def text_similarity(spark, d):
    ws = Workspace.of(spark, d)
    out = content.text_similarity(ws.test.items, ws.cooc_recs, ws.content.tables["tfidf"])
    return _r(out, "text")


def dense_similarity(spark, d):
    ws = Workspace.of(spark, d)
    return _r(content.dense_similarity(ws.test.items, ws.cooc_recs, ws.vectors), "text")


def unit_vectors(spark, d):
    unit = content.unit_vectors(tpch.item_vectors(spark, d))
    return unit.select(
        "item_id", F.posexplode("vec").alias("dim", "value")
    ).select("item_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value") + 1e-9, 6).alias("value"))


def text_vectors(spark, d):
    """Vectors of all part names from word vectors trained on them."""
    return embedding.text_vectors(tpch.catalog(spark, d), EmbeddingConfig(min_count=1))


def dense_cosine_topk(spark, d):
    """Ten nearest vectors of every vector, itself left out."""
    vectors = tpch.item_vectors(spark, d)
    asks = vectors.select(
        F.col("item_id").alias("query_id"), "vec", F.lit(K + 1).cast("long").alias("want")
    )
    found = nearest(asks, vectors).where("query_id <> item_id")
    return _recs(top_k(found, K))


# ---- evaluation ----------------------------------------------------------------------


def eval_hit_mrr(spark, d):
    ws = Workspace.of(spark, d)
    wide = ev.held_out_ranks(ws.test.cases, ws.cooc_recs).agg(*ev.rate_columns((5, 10, 20)))
    return _r(ev.to_long(wide, ev.metric_names((5, 10, 20))), "value")


def eval_coverage(spark, d):
    ws = Workspace.of(spark, d)
    return _r(ev.coverage(ws.cooc_recs, ws.n_items, TOP), "value")


def popularity_buckets(spark, d):
    ws = Workspace.of(spark, d)
    return _long(ev.item_buckets(ws.counts, BUCKETS), "bucket")


def bucket_ranges(spark, d):
    return _long(ev.bucket_ranges(Workspace.of(spark, d).counts, BUCKETS), "bucket")


def debiased_metrics(spark, d):
    ws = Workspace.of(spark, d)
    out = ev.debiased(ws.test.cases, ws.cooc_recs, ws.buckets, "CooccurrenceLift", "test")
    return _r(_long(out.select("scope", "bucket", "metric", "value"), "bucket"), "value")


def bucket_summary(spark, d):
    ws = Workspace.of(spark, d)
    metrics = ev.debiased(ws.test.cases, ws.cooc_recs, ws.buckets, "CooccurrenceLift", "test")
    out = ev.bucket_summary(metrics, ev.bucket_ranges(ws.counts, BUCKETS))
    return _long(out.select("scope", "bucket", "lo", "hi", "hit5", "hit10", "mrr"), "bucket")


def ensemble_members(spark, d):
    ws = Workspace.of(spark, d)
    weights = spark.createDataFrame(
        [("TopPopular", 1.0), ("CooccurrenceLift", 1.2), ("ContentBoost", 1.0)],
        "model string, weight double",
    )
    return ev.ensemble_members(ws.metrics, weights, 0.002)


def ranker_members(spark, d):
    return ev.ranker_members(Workspace.of(spark, d).metrics)


def debiased_summary(spark, d):
    ws = Workspace.of(spark, d)
    metrics = ev.debiased(ws.test.cases, ws.cooc_recs, ws.buckets, "CooccurrenceLift", "test")
    return _r(reports.debiased_summary(metrics), "debiased_hit5", "debiased_mrr")


def weight_grid(spark, d):
    ws = Workspace.of(spark, d)
    parts = materialise(ws.content.pool_parts(ws.test, 25), "grid_parts")
    hits = tune.grid_hits(ws.test.cases, parts, tune.weight_grid(*GRID))
    return _r(_long(hits, "grid_idx"), "cooc_w", "category_w", "text_w", "hit")


# ---- data health ---------------------------------------------------------------------


def basket_stats(spark, d):
    p = Workspace.of(spark, d).prepared
    out = None
    for split in ("train", "test", "oot"):
        part = health.basket_stats(p.orders, p.items, split)
        out = part if out is None else out.unionByName(part)
    return out


def top_mass_share(spark, d):
    return _long(health.top_mass_share(Workspace.of(spark, d).counts), "k")


def cold_items(spark, d):
    p = Workspace.of(spark, d).prepared
    return health.cold_items(p.items, "test").unionByName(health.cold_items(p.items, "oot"))


def heldout_mean_rank(spark, d):
    ws = Workspace.of(spark, d)
    return health.held_out_mean_rank(ws.test.cases, ws.popular.ranks)


def popularity_oracle_metrics(spark, d):
    ws = Workspace.of(spark, d)
    return health.popularity_metrics(ws.test.cases, ws.test.items, ws.popular.ranks, "test")


def random_baseline(spark, d):
    return health.random_hit5(Workspace.of(spark, d).prepared.titles)


def catalog_summary(spark, d):
    return csv.catalog_summary(tpch.catalog(spark, d))


def health_report(spark, d):
    ws = Workspace.of(spark, d)
    p = ws.prepared
    return health.report(
        p.items,
        p.orders,
        p.titles,
        ws.counts,
        ws.popular.ranks,
        {"test": (ws.test.cases, ws.test.items), "oot": (ws.oot.cases, ws.oot.items)},
    )


# ---- features ------------------------------------------------------------------------


def item_features(spark, d):
    ws = Workspace.of(spark, d)
    out = features.item_features(ws.train, ws.catalog)
    return _r(out, "item_popularity_log", "avg_basket_size")


def user_features(spark, d):
    ws = Workspace.of(spark, d)
    out = features.user_features(
        ws.test.cases, ws.test.items, ws.counts, ws.catalog, ws.prepared.histories
    )
    return _r(out, *features.USER_FEATURES)


def candidate_features(spark, d):
    ws = Workspace.of(spark, d)
    lists = [("pop", ws.popular_recs), ("cooc", ws.cooc_recs)]
    wide = features.candidate_scores(lists, TOP)
    out = features.label_candidates(wide, ws.test.cases, ["pop", "cooc"], TOP)
    return _r(_long(out, "label"), *features.score_features(["pop", "cooc"]))


# ---- reports -------------------------------------------------------------------------


def summary_pivot(spark, d):
    return reports.summary(Workspace.of(spark, d).metrics)


def test_vs_oot(spark, d):
    return _r(reports.test_vs_oot(Workspace.of(spark, d).metrics, "mrr"), "test", "oot")


def hits_by_model(spark, d):
    out = reports.hits_by_model(Workspace.of(spark, d).metrics)
    return _r(out, "test_hit5", "test_hit10", "test_hit20")


def improvement_pct(spark, d):
    out = reports.improvement(Workspace.of(spark, d).metrics)
    return _r(out, *[c for c in out.columns if c != "model"])


def degradation_pct(spark, d):
    out = reports.degradation(Workspace.of(spark, d).metrics)
    return _r(out, "hit5", "hit10", "mrr")


def quality_table(spark, d):
    return reports.quality_table(Workspace.of(spark, d).metrics)


def recs_with_titles(spark, d):
    ws = Workspace.of(spark, d)
    return _long(reports.with_titles(ws.cooc_recs, ws.prepared.titles), "rank")


def comparison_pivot(spark, d):
    ws = Workspace.of(spark, d)
    out = reports.compare_models(
        [("pop", ws.popular_recs), ("cooc", ws.cooc_recs)], ws.prepared.titles
    )
    return _long(out, "rank")


QUERIES: dict[str, Query] = {
    "status_filter": status_filter,
    "basket_assembly": basket_assembly,
    "basket_dedup": basket_dedup,
    "order_headers": order_headers,
    "item_titles": item_titles,
    "split_bounds": split_bounds,
    "temporal_split": temporal_split,
    "temporal_split_overlap": temporal_split_overlap,
    "split_counts": split_counts,
    "user_histories": user_histories,
    "profile_baskets": profile_baskets,
    "csv_baskets": csv_baskets,
    "csv_rejects": csv_rejects,
    "mixed_timestamps": mixed_timestamps,
    "stream_baskets": stream_baskets,
    "stream_pairs": stream_pairs,
    "item_frequency": item_frequency,
    "popularity_rank": popularity_order,
    "pair_counts": pair_counts,
    "pair_counts_supported": pair_counts_supported,
    "assoc_lift": _assoc("lift"),
    "assoc_pmi": _assoc("pmi"),
    "assoc_npmi": _assoc("npmi"),
    "category_lift": category_lift,
    "item_graph_edges": item_graph_edges,
    "l1o": l1o,
    "l1o_items": l1o_items,
    "stratified_l1o": stratified_l1o,
    "tune_subset": tune_subset,
    "rank_train_val_split": rank_train_val_split,
    "example_basket": example_basket,
    "top_popular_recs": top_popular_recs,
    "cooc_recs": cooc_recs,
    "session_recs": session_recs,
    "content_boost_recs": content_boost_recs,
    "dense_boost_recs": dense_boost_recs,
    "popularity_rerank": popularity_rerank,
    "rrf_ensemble": rrf_ensemble,
    "context_pairs": context_pairs,
    "item2vec_recs": item2vec_recs,
    "als_recs": als_recs,
    "bpr_recs": bpr_recs,
    "graph_walk_recs": graph_walk_recs,
    "graph_walks": graph_walks,
    "lambdarank_recs": lambdarank_recs,
    "feature_importance": feature_importance,
    "html_strip": html_strip,
    "tfidf_weights": tfidf_weights,
    "tfidf_documents": tfidf_documents,
    "category_scores": category_scores,
    "text_similarity": text_similarity,
    "dense_similarity": dense_similarity,
    "unit_vectors": unit_vectors,
    "text_vectors": text_vectors,
    "dense_cosine_topk": dense_cosine_topk,
    "eval_hit_mrr": eval_hit_mrr,
    "eval_coverage": eval_coverage,
    "popularity_buckets": popularity_buckets,
    "bucket_ranges": bucket_ranges,
    "debiased_metrics": debiased_metrics,
    "bucket_summary": bucket_summary,
    "debiased_summary": debiased_summary,
    "ensemble_members": ensemble_members,
    "ranker_members": ranker_members,
    "weight_grid": weight_grid,
    "basket_stats": basket_stats,
    "top_mass_share": top_mass_share,
    "cold_items": cold_items,
    "heldout_mean_rank": heldout_mean_rank,
    "popularity_oracle_metrics": popularity_oracle_metrics,
    "random_baseline": random_baseline,
    "catalog_summary": catalog_summary,
    "health_report": health_report,
    "item_features": item_features,
    "user_features": user_features,
    "candidate_features": candidate_features,
    "summary_pivot": summary_pivot,
    "test_vs_oot": test_vs_oot,
    "hits_by_model": hits_by_model,
    "improvement_pct": improvement_pct,
    "degradation_pct": degradation_pct,
    "quality_table": quality_table,
    "recs_with_titles": recs_with_titles,
    "comparison_pivot": comparison_pivot,
}
