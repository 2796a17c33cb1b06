"""Most bought items that the basket lacks."""

from __future__ import annotations

from typing import ClassVar

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pannier.operators.numbering import popularity_rank
from pannier.operators.pairs import item_counts
from pannier.operators.topk import PACKED_ITEMS, Queries, first_unowned
from pannier.recommend.base import Model
from pannier.session import materialise


class TopPopular(Model):
    name: ClassVar[str] = "TopPopular"

    @classmethod
    def fit(cls, items: DataFrame) -> TopPopular:
        counts = materialise(item_counts(items), "item_counts")
        return cls(tables={"ranks": materialise(popularity_rank(counts), "item_ranks")})

    @property
    def ranks(self) -> DataFrame:
        """item_id, freq, rank (1 = most bought)."""
        return self.tables["ranks"]

    def recommend(self, queries: Queries, k: int = 10) -> DataFrame:
        # a query reaches at most k places beyond the items it owns
        head = self.ranks.where(F.col("rank") <= k + queries.max_size).select(
            F.lit(0).alias("list_id"), "rank", "item_id", "freq"
        )
        asks = queries.cases.select("query_id", F.lit(0).alias("list_id"))
        picked = first_unowned(
            head,
            asks,
            queries.owned,
            k,
            queries.cases.select("query_id", "size"),
            packed=queries.max_size <= PACKED_ITEMS,
        )
        order = Window.partitionBy("query_id").orderBy("_place")
        return (
            picked.withColumnRenamed("rank", "_place")
            .withColumn("rank", F.row_number().over(order))
            .select("query_id", "rank", "item_id", F.col("freq").cast("double").alias("score"))
        )
