"""Held-out cases and reproducible samples.

Every choice follows a digest of the row's own key, not a random generator: the
result is the same after a repartition, a retry or in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pannier.functions.scalar import draw
from pannier.operators.numbering import by_hash, number_rows
from pannier.operators.topk import Queries


def held_out(items: DataFrame, seed: int = 42) -> DataFrame:
    """One item per basket of at least two, uniformly by digest (a plain minimum)."""
    pick = F.min(F.struct(draw(seed, "order_id", "item_id").alias("d"), "item_id"))
    return (
        items.where("size >= 2")
        .groupBy("order_id")
        .agg(pick.alias("_p"), F.max("profile_id").alias("profile_id"))
        .select(
            F.col("order_id").alias("query_id"),
            F.col("_p.item_id").alias("held_out"),
            "profile_id",
        )
    )


def rest_of_baskets(items: DataFrame, cases: DataFrame) -> DataFrame:
    """The basket without its held-out item."""
    return (
        items.select(F.col("order_id").alias("query_id"), "item_id")
        .join(cases.select("query_id", "held_out"), "query_id")
        .where(F.col("item_id") != F.col("held_out"))
        .select("query_id", "item_id")
    )


def leave_one_out(items: DataFrame, seed: int = 42, name: str = "l1o") -> Queries:
    cases = held_out(items, seed)
    return Queries.stored(cases, rest_of_baskets(items, cases), name)


def sample_cases(cases: DataFrame, n: int, seed: object) -> DataFrame:
    """``n`` cases without replacement; all of them when ``n`` is 0 or not smaller."""
    if n <= 0:
        return cases
    drawn = cases.withColumn("_d", draw(seed, "query_id"))
    return (
        number_rows(drawn, [], by_hash("_d"), [F.col("_d"), F.col("query_id")], "_r")
        .where(F.col("_r") <= n)
        .drop("_d", "_r")
    )


def train_val_split(cases: DataFrame, ratio: float, seed: object) -> DataFrame:
    """Mark ``max(1, int(n * ratio))`` cases with ``is_val``."""
    drawn = cases.withColumn("_d", draw(f"{seed}:val", "query_id"))
    n_val = cases.agg(
        F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(ratio))).alias("n")
    )
    return (
        number_rows(drawn, [], by_hash("_d"), [F.col("_d"), F.col("query_id")], "_r")
        .withColumn("is_val", F.col("_r") <= n_val.scalar())
        .drop("_d", "_r")
    )


def stratified_cases(
    cases: DataFrame,
    item_buckets: DataFrame,
    per_bucket: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Equally many cases from each popularity bucket of the held-out item.

    The default is the size of the smallest bucket that has cases; cases whose
    item was never bought in training stay as they are, with bucket -1.
    """
    placed = cases.join(
        item_buckets.select(F.col("item_id").alias("held_out"), "bucket"), "held_out", "left"
    ).withColumn("bucket", F.coalesce("bucket", F.lit(-1)))
    known = placed.where("bucket >= 0").withColumn("_d", draw(f"{seed}:strata", "query_id"))
    ranked = number_rows(
        known, ["bucket"], by_hash("_d"), [F.col("_d"), F.col("query_id")], "_r"
    )
    if per_bucket is None:
        smallest = known.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"))
        ranked = ranked.withColumn("_n", smallest.scalar())
    else:
        ranked = ranked.withColumn("_n", F.lit(per_bucket))
    columns = [*cases.columns, "bucket"]
    return (
        ranked.where(F.col("_r") <= F.col("_n"))
        .select(*columns)
        .unionByName(placed.where("bucket < 0").select(*columns))
    )


def example_basket(items: DataFrame, seed: int = 42, length: int = 3) -> DataFrame:
    """First items of one basket drawn at random.

    Only that basket is touched after the draw, and only its first positions.
    """
    drawn = (
        items.where("size >= 2")
        .select("order_id")
        .distinct()
        .orderBy(draw(f"{seed}:example", "order_id"), "order_id")
        .limit(1)
    )
    return (
        items.join(drawn, "order_id", "left_semi")
        .select("order_id", "pos", "item_id")
        .orderBy("pos")
        .limit(length)
    )
