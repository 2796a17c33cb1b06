"""Batches of query baskets, and ranking of what the models propose for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pannier.operators.numbering import number_rows
from pannier.session import materialise

# A query with more items than this is never packed into one array.
PACKED_ITEMS = 1000
# Places of a shared list written out per generated row.
PLACES = 4096


@dataclass(frozen=True)
class Queries:
    """Baskets to complete: ``cases`` has one row per query, ``items`` one per item."""

    cases: DataFrame  # query_id, profile_id, held_out (may be null), size
    items: DataFrame  # query_id, item_id
    max_size: int

    @staticmethod
    def stored(cases: DataFrame, items: DataFrame, name: str = "queries") -> Queries:
        """Store a batch; ``size`` is the number of distinct items of the query."""
        kept = materialise(items.select("query_id", "item_id"), f"{name}_items")
        sizes = kept.groupBy("query_id").agg(F.count_distinct("item_id").alias("size"))
        full = materialise(
            cases.select("query_id", "profile_id", "held_out")
            .join(sizes, "query_id", "left")
            .withColumn("size", F.coalesce("size", F.lit(0)).cast("long")),
            f"{name}_cases",
        )
        top = full.agg(F.max("size").alias("m")).first()
        return Queries(full, kept, int(top["m"] or 0))

    @staticmethod
    def from_items(items: DataFrame) -> Queries:
        """Free baskets (query_id, item_id), without profile or held-out item."""
        cases = items.select("query_id").distinct().select(
            "query_id",
            F.lit(None).cast("long").alias("profile_id"),
            F.lit(None).cast("long").alias("held_out"),
        )
        return Queries.stored(cases, items)

    @property
    def owned(self) -> DataFrame:
        return self.items.distinct()


def sort_score(score: str | Column = "score") -> Column:
    """Scores are compared to nine decimals; the item id breaks ties."""
    return F.round(score, 9)


def top_k(candidates: DataFrame, k: int, group: str = "query_id") -> DataFrame:
    """First ``k`` candidates per query; each task keeps its own best before the shuffle."""
    order = Window.partitionBy(group).orderBy(sort_score().desc(), F.col("item_id"))
    return (
        candidates.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(group, "rank", "item_id", "score")
    )


def drop_owned(candidates: DataFrame, queries: Queries) -> DataFrame:
    return candidates.join(queries.items, ["query_id", "item_id"], "left_anti")


def sum_scores(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id", "item_id").agg(F.sum("score").alias("score"))


def _skipped_packed(placed: DataFrame, k: int) -> DataFrame:
    """How many owned entries precede the k-th free one; owned ranks in one array."""
    return (
        placed.groupBy("query_id")
        .agg(F.sort_array(F.collect_list("rank")).alias("r"))
        .select(
            "query_id",
            F.size(F.filter("r", lambda r, i: r - i - 1 < k)).cast("long").alias("skip"),
        )
    )


def _skipped_long(placed: DataFrame, k: int) -> DataFrame:
    numbered = number_rows(
        placed, ["query_id"], F.floor(F.col("rank") / 4096), [F.col("rank")], "_i"
    )
    return numbered.groupBy("query_id").agg(
        F.count_if(F.col("rank") - F.col("_i") < k).cast("long").alias("skip")
    )


def first_unowned(
    lists: DataFrame,
    asks: DataFrame,
    owned: DataFrame,
    k: int,
    owned_limit: DataFrame,
    packed: bool,
) -> DataFrame:
    """First ``k`` entries of a shared ranked list that a query does not own.

    lists: list_id, rank (1..n without gaps), item_id; asks: query_id, list_id;
    owned: distinct (query_id, item_id); owned_limit: query_id, size = number of
    owned items. Instead of pairing queries with whole lists, it counts how many
    owned entries stand before the k-th free one (r-th place holding the i-th
    owned entry counts while r - i < k) and fetches just that many places.
    """
    limits = asks.join(owned_limit, "query_id")
    placed = (
        owned.join(limits, "query_id")
        .join(lists, ["list_id", "item_id"])
        .where(F.col("rank") <= F.col("size") + k)
        .select("query_id", F.col("rank").cast("long").alias("rank"))
    )
    if packed:
        skipped = _skipped_packed(placed, k)
    else:
        skipped = _skipped_long(materialise(placed, "owned_places"), k)
    last = F.lit(k) + F.coalesce("skip", F.lit(0))
    chunks = asks.join(skipped, "query_id", "left").select(
        "query_id",
        "list_id",
        last.alias("_last"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((last - 1) / PLACES))).alias("_c"),
    )
    places = chunks.select(
        "query_id",
        "list_id",
        F.explode(
            F.sequence(
                F.col("_c") * PLACES + 1, F.least(F.col("_last"), (F.col("_c") + 1) * PLACES)
            )
        ).alias("rank"),
    )
    return places.join(
        lists.withColumn("rank", F.col("rank").cast("long")), ["list_id", "rank"]
    ).join(owned, ["query_id", "item_id"], "left_anti")
