"""Weight search for blended pools in a single aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pannier.recommend.boost import PARTS


def weight_grid(
    cooc: Sequence[float], category: Sequence[float]
) -> list[tuple[float, float, float]]:
    """Weight triples that sum to 1 with a non-negative text weight, in grid order."""
    grid = [(float(c), float(a), 1.0 - float(c) - float(a)) for c in cooc for a in category]
    return [w for w in grid if w[2] >= 0]


def grid_hits(
    cases: DataFrame, parts: DataFrame, grid: Sequence[tuple[float, float, float]], k: int = 5
) -> DataFrame:
    """Hit@k per grid point: grid_idx, cooc_w, category_w, text_w, hit.

    The pool's parts are computed once. Per grid point the rank of the held-out
    item is one plus the number of pool items ahead of it, so all points are
    columns of one grouping by query; nothing is sorted or multiplied out.
    """
    held = parts.join(
        cases.select("query_id", F.col("held_out").alias("item_id")), ["query_id", "item_id"]
    ).select("query_id", F.col("item_id").alias("_held"), *[F.col(p).alias(f"_{p}") for p in PARTS])
    rows = parts.join(held, "query_id")

    def score(weights: Sequence[float], mark: str):
        a, b, c = (F.lit(w) * F.col(f"{mark}{p}") for w, p in zip(weights, PARTS))
        return F.round(a + b + c, 9)

    ranks = []
    for i, weights in enumerate(grid):
        mine, theirs = score(weights, "_"), score(weights, "")
        ahead = (theirs > mine) | ((theirs == mine) & (F.col("item_id") < F.col("_held")))
        ranks.append((1 + F.count_if(ahead)).alias(f"r{i}"))
    ranked = rows.groupBy("query_id").agg(*ranks)
    total = cases.agg(F.count(F.lit(1)))
    sums = ranked.agg(*[F.count_if(F.col(f"r{i}") <= k).alias(f"r{i}") for i in range(len(grid))])
    points = F.array(
        *[
            F.struct(
                F.lit(i).alias("grid_idx"),
                F.lit(w[0]).alias("cooc_w"),
                F.lit(w[1]).alias("category_w"),
                F.lit(w[2]).alias("text_w"),
                F.col(f"r{i}").alias("hits"),
            )
            for i, w in enumerate(grid)
        ]
    )
    n = F.col("_n")
    return (
        sums.select(F.inline(points))
        .withColumn("_n", total.scalar())
        .select(
            "grid_idx",
            "cooc_w",
            "category_w",
            "text_w",
            F.when(n > 0, F.col("hits") / n).otherwise(F.lit(0.0)).alias("hit"),
        )
    )


def best_weights(hits: DataFrame) -> tuple[float, float, float]:
    """Highest hit rate; the first grid point wins a tie."""
    top = hits.orderBy(F.col("hit").desc(), "grid_idx").first()
    return top["cooc_w"], top["category_w"], top["text_w"]
