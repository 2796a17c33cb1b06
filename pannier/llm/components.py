"""Connected components of a link table by alternating star contractions.

Only tables move: each round groups by node, takes the least neighbour and
joins it back; a hub's rows share one key but the joins carry two short columns
and can be split by adaptive execution. Each round is written to the shared
folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pannier.session import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours of ``u`` on its least neighbour (or itself).

    ``large``: the neighbours above ``u``; otherwise ``u`` and those below it.
    """
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if large else both.where("v < u")
    least = side.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = side.join(least, "u")
    out = joined.where("v > u") if large else joined
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node in ``links(u, v)``; the root is the least node.

    Empty links give an empty table; loops and repeated links are harmless.
    Links never leave the executors.
    Raises if the links have not settled after ``rounds``, never returns a part.
    """
    now = materialise(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .distinct(),
        "links",
    )
    before = None
    for _ in range(rounds):
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
        ).first()
        if state == before or state["n"] == 0:
            break
        before = state
        wide = _star(now, large=True)
        now = materialise(
            _star(wide, large=False).select(
                F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
            ),
            "links",
        )
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
