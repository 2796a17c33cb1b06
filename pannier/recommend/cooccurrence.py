"""Co-purchase recommenders: association sums over the basket, and with history.

Associations are stored as ranked lists, one per item. A query reads the lists of
its items in blocks, until no item that it has not met can be among its best.
"""

from __future__ import annotations

from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pannier.operators import threshold
from pannier.operators.pairs import association_table, basket_total, item_counts
from pannier.operators.topk import Queries
from pannier.recommend.base import Model
from pannier.session import materialise

#: Kinds of lists: an item's associations; a purchase history's sums; a large basket's sums.
ITEM, PROFILE, BASKET = 0, 1, 2
#: A history is summed once into a list when its queries would read it more often than this.
SHARED = 100_000


def fit_associations(
    items: DataFrame, metric: str, min_support: int, group: str = "order_id", mined: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Ranked associations of every item, in blocks; ``mined`` are the items' pair counts where stored already."""
    counts = materialise(item_counts(items), "item_counts")
    table = association_table(items, counts, basket_total(items, group), metric, min_support, group, mined)
    lists = table.select(
        F.lit(ITEM).alias("kind"), F.col("item_id").alias("list_id"), F.col("other_id").alias("item_id"), "score"
    )
    longest = _most_partners(items, group)
    if longest is None or longest > threshold.LONG:
        lists = materialise(lists, "associations")
    return {"blocks": materialise(threshold.list_blocks(lists, longest), "association_blocks")}


def _most_partners(items: DataFrame, group: str) -> int | None:
    """A number that no item's partners exceed: places beside it in its baskets. None without basket sizes."""
    if group != "order_id" or "size" not in items.columns:
        return None
    beside = items.groupBy("item_id").agg(F.sum(F.col("size") - 1).alias("n"))
    return int(beside.agg(F.max("n").alias("n")).first()["n"] or 0)


def summed_lists(tables: dict[str, DataFrame], members: DataFrame, kind: int) -> dict[str, DataFrame]:
    """The model's lists and further ones: sums of the associations of ``members(list_id, item_id, n)``."""
    wanted = members.select(F.col("item_id").alias("list_id")).distinct()
    partners = threshold.entries_of(tables["blocks"].where(F.col("kind") == ITEM).join(wanted, "list_id", "left_semi"))
    sums = (
        members.join(partners.select(F.col("list_id").alias("item_id"), F.col("item_id").alias("other"), "score"), "item_id")
        .groupBy("list_id", F.col("other").alias("item_id"))
        .agg(F.sum(F.col("score") * F.col("n")).alias("score"))
        .select(F.lit(kind).alias("kind"), "list_id", "item_id", "score")
    )
    blocks = materialise(threshold.list_blocks(materialise(sums, "summed_lists")), "sum_blocks")
    return {"blocks": tables["blocks"].unionByName(blocks)}


def basket_weights(queries: Queries) -> DataFrame:
    """(query_id, item_id, weight): a repeated item counts as often as it stands in the basket."""
    return queries.items.groupBy("query_id", "item_id").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def _asked(rows: DataFrame, kind: int, weight: str | Column = "weight") -> DataFrame:
    return rows.select(
        "query_id", F.lit(kind).alias("kind"), "list_id", (F.col(weight) if isinstance(weight, str) else weight).alias("weight")
    )


def basket_asks(
    weights: DataFrame, queries: Queries, tables: dict[str, DataFrame]
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(query_id, kind, list_id, weight) for weighted basket items, and all lists.

    A basket of more than ``threshold.LISTS`` items asks for one list, its own sums.
    """
    weights = weights.withColumnRenamed("item_id", "list_id")
    if queries.max_size <= threshold.LISTS:
        return _asked(weights, ITEM), tables
    large = queries.cases.where(F.col("size") > threshold.LISTS).select("query_id")
    members = weights.join(large, "query_id", "left_semi").select(
        F.col("query_id").alias("list_id"), F.col("list_id").alias("item_id"), F.col("weight").alias("n")
    )
    own = _asked(large.withColumn("list_id", F.col("query_id")), BASKET, F.lit(1.0))
    return (
        _asked(weights.join(large, "query_id", "left_anti"), ITEM).unionByName(own),
        summed_lists(tables, members, BASKET),
    )


def association_top(queries: Queries, tables: dict[str, DataFrame], k: int) -> DataFrame:
    """The ``k`` best associated items per query that it does not own."""
    asks, lists = basket_asks(basket_weights(queries), queries, tables)
    return threshold.best_sums(asks, queries.owned, lists["blocks"], k)


class CooccurrenceLift(Model):
    name: ClassVar[str] = "CooccurrenceLift"

    @classmethod
    def fit(
        cls, items: DataFrame, min_support: int = 2, score_metric: str = "lift", mined: DataFrame | None = None
    ) -> CooccurrenceLift:
        return cls(
            {"min_support": min_support, "score_metric": score_metric},
            fit_associations(items, score_metric, min_support, mined=mined),
        )

    def recommend(self, queries: Queries, k: int = 10) -> DataFrame:
        return association_top(queries, self.tables, k)


class SessionCooccurrence(Model):
    """Basket associations plus ``history_weight`` times those of the purchase history.

    A query asks for its basket items' lists with weight 1 and for those of the
    profile's other past items with ``history_weight``. A history that is long, or
    shared by many queries, is summed once into a ranked list of its own, read
    like any other; basket items in it then count that much less.
    """

    name: ClassVar[str] = "SessionCooccurrence"

    @classmethod
    def fit(
        cls,
        items: DataFrame,
        histories: DataFrame,
        history_weight: float = 0.3,
        min_support: int = 2,
        mined: DataFrame | None = None,
    ) -> SessionCooccurrence:
        return cls(
            {"history_weight": history_weight, "min_support": min_support},
            {
                **fit_associations(items, "lift", min_support, mined=mined),
                "histories": materialise(
                    histories.select("profile_id", "item_id").distinct(), "session_histories"
                ),
            },
        )

    def asks(self, queries: Queries) -> tuple[DataFrame, dict[str, DataFrame]]:
        """What each query asks for, and all lists."""
        weight = float(self.params["history_weight"])
        tables, own = self.tables, basket_weights(queries)
        asked = queries.cases.where("profile_id is not null").select("query_id", "profile_id")
        if weight == 0:
            return basket_asks(own, queries, tables)
        histories = tables["histories"]
        sizes = (
            histories.groupBy("profile_id")
            .agg(F.count(F.lit(1)).alias("past"))
            .join(asked.groupBy("profile_id").agg(F.count(F.lit(1)).alias("queries")), "profile_id")
        )
        long = (F.col("past") > threshold.LISTS) | (F.col("past") * F.col("queries") > SHARED)
        # beyond 1 a basket item would have to be taken out with a weight below zero
        shared = materialise(sizes.where(long if weight <= 1 else F.lit(False)).select("profile_id"), "shared_histories")
        past = (
            asked.join(shared, "profile_id", "left_anti")
            .join(histories, "profile_id")
            .join(queries.items, ["query_id", "item_id"], "left_anti")
        )
        light = _asked(past.withColumnRenamed("item_id", "list_id"), ITEM, F.lit(weight))
        if shared.isEmpty():
            asks, tables = basket_asks(own, queries, tables)
            return asks.unionByName(light), tables
        mine = asked.join(shared, "profile_id", "left_semi")
        both = own.join(mine, "query_id").join(histories, ["profile_id", "item_id"]).select("query_id", "item_id")
        own = own.join(both.withColumn("_less", F.lit(weight)), ["query_id", "item_id"], "left").select(
            "query_id", "item_id", (F.col("weight") - F.coalesce("_less", F.lit(0.0))).alias("weight")
        )
        asks, tables = basket_asks(own.where("weight > 0"), queries, tables)
        members = histories.join(shared, "profile_id", "left_semi").select(
            F.col("profile_id").alias("list_id"), "item_id", F.lit(1.0).alias("n")
        )
        heavy = _asked(mine.withColumnRenamed("profile_id", "list_id"), PROFILE, F.lit(weight))
        return asks.unionByName(light).unionByName(heavy), summed_lists(tables, members, PROFILE)

    def recommend(self, queries: Queries, k: int = 10) -> DataFrame:
        asks, tables = self.asks(queries)
        return threshold.best_sums(asks, queries.owned, tables["blocks"], k)
