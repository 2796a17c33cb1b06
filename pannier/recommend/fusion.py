"""Models on top of other models: popularity re-rank and reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any, ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pannier.operators.pairs import item_counts
from pannier.operators.topk import Queries, sum_scores, top_k
from pannier.recommend.base import Model
from pannier.session import materialise


class PopularityRerank(Model):
    """Reciprocal rank of the base model plus a weighted log popularity."""

    name: ClassVar[str] = "PopularityRerank"

    def __init__(
        self,
        params: dict[str, Any] | None = None,
        tables: dict[str, DataFrame] | None = None,
        base: Model | None = None,
    ) -> None:
        super().__init__(params or {}, tables or {})
        self.base = base

    @classmethod
    def fit(cls, base: Model, items: DataFrame, pop_weight: float = 0.2) -> PopularityRerank:
        counts = materialise(item_counts(items), "item_counts")
        return cls({"pop_weight": pop_weight}, {"counts": counts}, base)

    def components(self) -> dict[str, Model]:
        return {self.base.name: self.base}

    def recommend(self, queries: Queries, k: int = 10) -> DataFrame:
        recs = self.base.recommend(queries, max(5 * k, 50))
        popular = F.log1p(F.coalesce("freq", F.lit(0)).cast("double"))
        scored = recs.join(self.tables["counts"], "item_id", "left").select(
            "query_id",
            "item_id",
            (1.0 / F.col("rank") + F.lit(self.params["pop_weight"]) * popular).alias("score"),
        )
        return top_k(scored, k)


def fuse(
    recs: Sequence[tuple[float, DataFrame]],
) -> DataFrame:
    """Sum of ``weight / rank`` over the lists of several models."""
    weighted = [
        df.select("query_id", "item_id", (F.lit(float(w)) / F.col("rank")).alias("score"))
        for w, df in recs
    ]
    return sum_scores(reduce(DataFrame.unionByName, weighted))


class EnsembleRRF(Model):
    name: ClassVar[str] = "EnsembleRRF"

    def __init__(
        self,
        params: dict[str, Any] | None = None,
        tables: dict[str, DataFrame] | None = None,
        members: dict[str, Model] | None = None,
    ) -> None:
        super().__init__(params or {}, tables or {})
        self.members = members or {}

    @classmethod
    def of(cls, members: Sequence[tuple[Model, float]]) -> EnsembleRRF:
        return cls(
            {"weights": {m.name: float(w) for m, w in members}},
            members={m.name: m for m, _ in members},
        )

    def components(self) -> dict[str, Model]:
        return self.members

    def recommend(self, queries: Queries, k: int = 10) -> DataFrame:
        pool = max(3 * k, 30)
        lists = [
            (self.params["weights"][name], m.recommend(queries, pool))
            for name, m in self.members.items()
        ]
        return top_k(fuse(lists), k)
