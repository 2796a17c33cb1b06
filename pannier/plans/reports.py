"""Comparison tables over the long metrics, and readable recommendations."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pannier.functions.scalar import item_label, percent_change
from pannier.operators.topk import Queries
from pannier.recommend.base import Model

METRICS = ("hit@5", "hit@10", "hit@20", "mrr")
SPLITS = ("test", "oot")


def _column(split: str, metric: str) -> str:
    return f"{split}_{metric.replace('@', '')}"


def _micro(metrics: DataFrame) -> DataFrame:
    return metrics.where("scope = 'micro'")


def wide(
    metrics: DataFrame, splits: Sequence[str] = SPLITS, names: Sequence[str] = METRICS
) -> DataFrame:
    """One row per model, one column per split and metric; a missing value is 0."""
    columns = [
        F.coalesce(
            F.max(
                F.when((F.col("split") == s) & (F.col("metric") == m), F.col("value"))
            ),
            F.lit(0.0),
        ).alias(_column(s, m))
        for s in splits
        for m in names
    ]
    return _micro(metrics).groupBy("model").agg(*columns)


def summary(metrics: DataFrame) -> DataFrame:
    """Models against splits and metrics, rounded to 4 places, with the training time."""
    table = wide(metrics)
    times = metrics.where("metric = 'train_time_s'").select(
        "model", F.col("value").alias("train_time_s")
    )
    numbers = [c for c in table.columns if c != "model"]
    return table.join(times, "model", "left").select(
        "model",
        *[F.round(c, 4).alias(c) for c in numbers],
        F.round(F.coalesce("train_time_s", F.lit(0.0)), 4).alias("train_time_s"),
    )


def test_vs_oot(metrics: DataFrame, metric: str = "hit@5") -> DataFrame:
    table = wide(metrics, names=[metric])
    return table.select(
        "model",
        F.col(_column("test", metric)).alias("test"),
        F.col(_column("oot", metric)).alias("oot"),
    )


def hits_by_model(metrics: DataFrame, split: str = "test") -> DataFrame:
    return wide(metrics, [split], METRICS[:3])


def improvement(metrics: DataFrame, baseline: str = "TopPopular") -> DataFrame:
    """Percent gain over a baseline on the test split; empty without the baseline."""
    table = wide(metrics, ["test"])
    base = table.where(F.col("model") == baseline)
    names = [_column("test", m) for m in METRICS]
    if base.isEmpty():
        warnings.warn(f"baseline {baseline!r} has no metrics, nothing to compare", stacklevel=2)
        return table.where("false").select("model", *[F.col(n) for n in names])
    row = base.select(F.struct(*names)).scalar()
    return (
        table.where(F.col("model") != baseline)
        .withColumn("_b", row)
        .select(
            "model", *[percent_change(F.col(n), F.col(f"_b.{n}")).alias(n) for n in names]
        )
    )


def degradation(metrics: DataFrame) -> DataFrame:
    """Percent lost from test to out-of-time: ``(test - oot) / test``; 0 without a test value."""
    names = ("hit@5", "hit@10", "mrr")
    table = wide(metrics, names=names)
    columns = []
    for m in names:
        test, oot = F.col(_column("test", m)), F.col(_column("oot", m))
        columns.append(
            F.when(test > 0, (test - oot) / test * 100)
            .otherwise(F.lit(0.0))
            .alias(m.replace("@", ""))
        )
    return table.select("model", *columns)


def quality_table(metrics: DataFrame) -> DataFrame:
    table = wide(metrics, names=("hit@5", "mrr"))
    return table.select("model", *[F.round(c, 4).alias(c) for c in table.columns if c != "model"])


def debiased_summary(metrics: DataFrame) -> DataFrame:
    """Macro-averaged Hit@5 and MRR of the models that have a positive one."""
    rows = metrics.where("scope = 'debiased' and split = 'test'")

    def pick(metric: str):
        return F.coalesce(
            F.max(F.when(F.col("metric") == metric, F.col("value"))), F.lit(0.0)
        )

    return (
        rows.groupBy("model")
        .agg(pick("hit@5").alias("debiased_hit5"), pick("mrr").alias("debiased_mrr"))
        .where("debiased_hit5 > 0 or debiased_mrr > 0")
    )


def with_titles(recs: DataFrame, titles: DataFrame) -> DataFrame:
    """An item without a title reads ``Item #<id>``."""
    return recs.join(titles.select("item_id", "title"), "item_id", "left").select(
        "query_id", "rank", "item_id", item_label(F.col("title"), F.col("item_id")).alias("title")
    )


def compare_models(
    lists: Sequence[tuple[str, DataFrame]], titles: DataFrame
) -> DataFrame:
    """One row per query and rank, one column of titles per model."""
    tagged = None
    for name, recs in lists:
        part = with_titles(recs, titles).withColumn("model", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    return (
        tagged.groupBy("query_id", "rank")
        .pivot("model", [name for name, _ in lists])
        .agg(F.first("title"))
    )


def infer(model: Model, baskets: DataFrame, titles: DataFrame, top_k: int = 5) -> DataFrame:
    """Titled recommendations for free baskets (query_id, item_id)."""
    return with_titles(model.recommend(Queries.from_items(baskets), top_k), titles)
