"""Statistics over prepared baskets that judge the data before any model does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# The list sizes whose share of all lines is reported.
TOP_SIZES = (1, 5, 10, 20, 50, 100, 200)


def basket_stats(orders: DataFrame, items: DataFrame, split: str) -> DataFrame:
    """Count, mean, the size at positions n/2 and 0.9 n, and distinct items.

    Positions are read off the cumulative histogram of sizes, so no basket is sorted.
    """
    histogram = (
        orders.where(f"in_{split}").groupBy("size").agg(F.count(F.lit(1)).alias("c"))
    )
    running = Window.partitionBy(F.lit(0)).orderBy("size").rowsBetween(
        Window.unboundedPreceding, 0
    )
    total = Window.partitionBy(F.lit(0))
    placed = histogram.select(
        "size", "c", F.sum("c").over(running).alias("upto"), F.sum("c").over(total).alias("n")
    )

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("upto") > position, F.col("size")))

    n_items = (
        items.where(f"in_{split}")
        .select("item_id")
        .distinct()
        .agg(F.count(F.lit(1)).alias("uniq_items"))
    )
    return placed.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_baskets"),
        F.round(F.sum(F.col("size") * F.col("c")) / F.sum("c"), 3).alias("mean_size"),
        at(F.floor(F.col("n") / 2)).alias("p50"),
        at(F.floor(F.col("n") * F.lit(0.9))).alias("p90"),
    ).select(
        F.lit(split).alias("split"), "*", n_items.scalar().alias("uniq_items")
    )


def top_mass_share(counts: DataFrame, sizes: Sequence[int] = TOP_SIZES) -> DataFrame:
    """Share of all lines held by the k most bought items."""
    head = counts.orderBy(F.col("freq").desc(), "item_id").limit(max(sizes))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("freq").desc(), "item_id")
    running = head.select(
        F.row_number().over(order).alias("place"),
        F.sum("freq").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("mass"),
    )
    wanted = F.explode(F.array(*[F.lit(k) for k in sizes])).alias("k")
    sums = running.select("place", "mass", wanted).where("place <= k")
    total = counts.agg(F.sum("freq"))
    return (
        sums.groupBy("k")
        .agg(F.max("mass").alias("mass"))
        .withColumn("_t", total.scalar())
        .select("k", F.round(F.col("mass") / F.col("_t"), 4).alias("share"))
    )


def cold_items(items: DataFrame, split: str) -> DataFrame:
    """Items of a split that training never saw."""
    known = items.where("in_train").select("item_id").distinct()
    mine = items.where(f"in_{split}").select("item_id").distinct()
    flagged = mine.join(known.withColumn("_k", F.lit(1)), "item_id", "left")
    n = F.count(F.lit(1))
    cold = F.count_if(F.col("_k").isNull())
    return flagged.agg(
        F.lit(split).alias("split"),
        cold.alias("n_cold"),
        F.when(n > 0, F.round(cold / n, 4)).alias("cold_frac"),
    )


def held_out_mean_rank(cases: DataFrame, ranks: DataFrame) -> DataFrame:
    """Mean popularity rank of held-out items; an unseen item ranks one behind the last."""
    last = ranks.agg(F.count(F.lit(1)))
    placed = cases.select(F.col("held_out").alias("item_id")).join(
        ranks.select("item_id", "rank"), "item_id", "left"
    )
    return placed.withColumn("_n", last.scalar()).agg(
        F.round(F.avg(F.coalesce(F.col("rank"), F.col("_n") + 1)), 2).alias("mean_rank")
    )


def filtered_ranks(cases: DataFrame, items: DataFrame, ranks: DataFrame) -> DataFrame:
    """Popularity rank of the held-out item once the basket's own items are skipped."""
    held = cases.select("query_id", "held_out").join(
        ranks.select(F.col("item_id").alias("held_out"), F.col("rank").alias("_held")),
        "held_out",
        "left",
    )
    mine = items.join(ranks.select("item_id", "rank"), "item_id").select("query_id", "rank")
    ahead = (
        mine.join(held.where("_held is not null"), "query_id")
        .groupBy("query_id")
        .agg(F.count_if(F.col("rank") < F.col("_held")).alias("_ahead"))
    )
    return held.join(ahead, "query_id", "left").select(
        "query_id",
        "held_out",
        (F.col("_held") - F.coalesce("_ahead", F.lit(0))).alias("rank"),
    )


def popularity_metrics(
    cases: DataFrame, items: DataFrame, ranks: DataFrame, split: str
) -> DataFrame:
    """Hit@K and untruncated MRR of the full popularity order."""
    placed = filtered_ranks(cases, items, ranks)

    def share(k: int) -> Column:
        return F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double"))

    return placed.agg(
        F.lit(split).alias("split"),
        F.count(F.lit(1)).alias("n"),
        *[F.round(share(k), 6).alias(f"hit{k}") for k in (5, 10, 20)],
        F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def random_hit5(titles: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return titles.agg(
        n.alias("n_items"),
        F.when(n > 0, F.round(5 / n, 6)).otherwise(F.lit(0.0)).alias("random_hit5"),
    )


def report(
    items: DataFrame,
    orders: DataFrame,
    titles: DataFrame,
    counts: DataFrame,
    ranks: DataFrame,
    batches: dict[str, tuple[DataFrame, DataFrame]],
) -> DataFrame:
    """All statistics as one row with one JSON document.

    ``batches`` maps a split to its held-out cases and query items.
    """

    def one(df: DataFrame) -> Column:
        return df.select(F.struct("*")).scalar()

    shares = top_mass_share(counts).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("k").cast("string"), "share")))
        )
    )
    fields = [
        one(random_hit5(titles)).alias("random_baseline"),
        one(item_counts_total(counts)).alias("train_items"),
        shares.scalar().alias("train_line_share_topk"),
    ]
    for split in ("train", "test", "oot"):
        fields.append(one(basket_stats(orders, items, split)).alias(split))
    for split, (cases, query_items) in batches.items():
        fields.append(one(cold_items(items, split)).alias(f"{split}_cold"))
        fields.append(one(held_out_mean_rank(cases, ranks)).alias(f"{split}_held_out"))
        fields.append(
            one(popularity_metrics(cases, query_items, ranks, split)).alias(f"{split}_popularity")
        )
    spark = items.sparkSession
    return spark.range(1).select(F.struct(*fields).alias("r")).select(
        F.to_json("r").alias("report")
    )


def item_counts_total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count(F.lit(1)).alias("n_items"), F.sum("freq").alias("n_lines"))


