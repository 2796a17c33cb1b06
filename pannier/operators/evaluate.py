"""Hit@K, MRR, coverage and their popularity-debiased forms as long metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out_ranks(cases: DataFrame, recs: DataFrame) -> DataFrame:
    """Every case with the rank of its held-out item, null where it was not proposed."""
    hits = recs.select("query_id", F.col("item_id").alias("held_out"), "rank")
    return cases.select("query_id", "held_out").join(hits, ["query_id", "held_out"], "left")


def rate_columns(k_values: Sequence[int]) -> list[Column]:
    """Hit rates and MRR over ranked cases; an empty input gives 0."""
    top = max(k_values)
    hits = [
        F.coalesce(F.avg((F.coalesce(F.col("rank") <= k, F.lit(False))).cast("double")), F.lit(0.0))
        .alias(f"hit@{k}")
        for k in k_values
    ]
    reciprocal = F.when(F.col("rank") <= top, 1.0 / F.col("rank")).otherwise(0.0)
    return [*hits, F.coalesce(F.avg(reciprocal), F.lit(0.0)).alias("mrr")]


def metric_names(k_values: Sequence[int]) -> list[str]:
    return [*[f"hit@{k}" for k in k_values], "mrr"]


def to_long(wide: DataFrame, metrics: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return wide.unpivot(list(keep), list(metrics), "metric", "value")


def coverage(recs: DataFrame, n_items: DataFrame, k: int) -> DataFrame:
    """Share of the ``n_items`` items that were proposed to anyone; 0 without items."""
    proposed = recs.where(F.col("rank") <= k).select("item_id").distinct()
    n = F.col("_n")
    return (
        proposed.agg(F.count(F.lit(1)).alias("c"))
        .withColumn("_n", n_items.scalar())
        .select(
            F.lit("coverage").alias("metric"),
            F.when(n > 0, F.col("c") / n).otherwise(F.lit(0.0)).alias("value"),
        )
    )


def evaluate(
    cases: DataFrame,
    recs: DataFrame,
    n_items: DataFrame,
    model: str,
    split: str,
    k_values: Sequence[int] = (5, 10, 20),
) -> DataFrame:
    """Micro metrics of one model on one split. ``n_items``: one-row, one-column count."""
    wide = held_out_ranks(cases, recs).agg(*rate_columns(k_values))
    rates = to_long(wide, metric_names(k_values)).unionByName(
        coverage(recs, n_items, max(k_values))
    )
    return rates.select(
        F.lit(model).alias("model"),
        F.lit(split).alias("split"),
        F.lit("micro").alias("scope"),
        F.lit(None).cast("int").alias("bucket"),
        "metric",
        "value",
    )


def bucket_thresholds(counts: DataFrame, n_buckets: int = 5) -> DataFrame:
    """Interpolated percentiles of the item frequency at equal steps, as one array.

    Works on the histogram of frequencies, which is far smaller than the items.
    """
    histogram = counts.groupBy("freq").agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(*[F.lit(i / n_buckets) for i in range(n_buckets + 1)])
    return histogram.agg(F.percentile("freq", steps, F.col("n")).alias("thresholds"))


def item_buckets(counts: DataFrame, n_buckets: int = 5) -> DataFrame:
    """Item goes to the first bucket whose upper limit it does not exceed, else the last."""
    limits = bucket_thresholds(counts, n_buckets)
    return counts.withColumn("_t", limits.scalar()).select(
        "item_id",
        "freq",
        F.size(
            F.filter(F.slice("_t", 2, n_buckets - 1), lambda t: t < F.col("freq"))
        ).alias("bucket")
        if n_buckets > 1
        else F.lit(0).alias("bucket"),
    )


def bucket_ranges(counts: DataFrame, n_buckets: int = 5) -> DataFrame:
    t = F.col("thresholds")
    return (
        bucket_thresholds(counts, n_buckets)
        .where(F.size(t) > 0)
        .select(
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(1), F.lit(n_buckets)),
                    lambda i: F.struct(
                        F.element_at(t, i).alias("lo"), F.element_at(t, i + 1).alias("hi")
                    ),
                )
            ).alias("bucket", "r")
        )
        .select("bucket", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    )


def debiased(
    cases: DataFrame,
    recs: DataFrame,
    buckets: DataFrame,
    model: str,
    split: str,
    k_values: Sequence[int] = (5, 10, 20),
) -> DataFrame:
    """Micro, per-bucket and macro-averaged rates; one pass gives the first two."""
    known = buckets.select(F.col("item_id").alias("held_out"), "bucket")
    ranked = held_out_ranks(cases, recs).join(known, "held_out", "left").withColumn(
        "bucket", F.coalesce("bucket", F.lit(-1))
    )
    names = metric_names(k_values)
    # the rollup's grand total is the micro row; bucket -1 holds items new to training
    grouped = ranked.rollup("bucket").agg(
        F.grouping("bucket").alias("_all"), *rate_columns(k_values)
    )
    rates = to_long(
        grouped.where((F.col("_all") == 1) | (F.col("bucket") >= 0)).withColumn(
            "scope", F.when(F.col("_all") == 1, F.lit("micro")).otherwise(F.lit("bucket"))
        ),
        names,
        ["scope", "bucket"],
    )
    macro = (
        rates.where("scope = 'bucket'")
        .groupBy("metric")
        .agg(F.avg("value").alias("value"))
        .select(
            F.lit("debiased").alias("scope"),
            F.lit(None).cast("int").alias("bucket"),
            "metric",
            "value",
        )
    )
    return rates.unionByName(macro).select(
        F.lit(model).alias("model"),
        F.lit(split).alias("split"),
        "scope",
        F.col("bucket").cast("int").alias("bucket"),
        "metric",
        "value",
    )


def bucket_summary(metrics: DataFrame, ranges: DataFrame) -> DataFrame:
    """Hit@5, Hit@10 and MRR per bucket with its frequency range, then both averages."""
    wide = (
        metrics.where("metric in ('hit@5', 'hit@10', 'mrr')")
        .groupBy("model", "split", "scope", "bucket")
        .pivot("metric", ["hit@5", "hit@10", "mrr"])
        .agg(F.first("value"))
    )
    return wide.join(ranges, "bucket", "left").select(
        "model", "split", "scope", "bucket", "lo", "hi",
        F.round("hit@5", 4).alias("hit5"),
        F.round("hit@10", 4).alias("hit10"),
        F.round("mrr", 4).alias("mrr"),
    )


def merge_metrics(standard: DataFrame, by_bucket: DataFrame) -> DataFrame:
    """Standard metrics plus only the bucket and macro rows of the debiased table."""
    return standard.unionByName(by_bucket.where("scope <> 'micro'"))


def metric_value(metrics: DataFrame, metric: str, split: str = "test") -> DataFrame:
    return metrics.where(
        (F.col("metric") == metric) & (F.col("split") == split) & (F.col("scope") == "micro")
    ).select("model", "value")


def ensemble_members(
    metrics: DataFrame, weights: DataFrame, min_hit5: float = 0.0
) -> DataFrame:
    """Models worth fusing: positive Hit@5 and MRR on test and Hit@5 of at least ``min_hit5``."""
    hit5 = metric_value(metrics, "hit@5").withColumnRenamed("value", "hit5")
    mrr = metric_value(metrics, "mrr").withColumnRenamed("value", "mrr")
    return (
        weights.join(hit5, "model")
        .join(mrr, "model")
        .where(
            (F.col("hit5") > 0) & (F.col("mrr") > 0) & (F.col("hit5") >= min_hit5)
        )
        .select("model", "weight")
    )


# Models that are themselves blends and never feed the learned ranker.
BLENDS = ("EnsembleRRF", "PopularityRerank", "LGBMEnsemble")


def ranker_members(metrics: DataFrame) -> DataFrame:
    return (
        metric_value(metrics, "hit@5")
        .where((F.col("value") > 0) & ~F.col("model").isin(*BLENDS))
        .select("model")
    )
