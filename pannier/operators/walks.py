"""Weighted random walks over the co-purchase graph, as an append-only log.

A step picks a neighbour with probability proportional to its weight. Weights are
counts, so a draw is an integer below the node's total ``W``; the neighbours in order
of their ids share out 0 .. W - 1. A node of d neighbours has about d slots of equal
width, each with the few neighbours whose shares touch it (two on average, no more
than its width + 1), so a draw is one equality join on (node, slot), also at a hub.
A neighbour's row carries its own total and width, so nothing else is looked up.

Every step appends (start, walk, step, node) to the log; no walk is ever an array
that moves. Draws are digests of start, walk, step and seed: a retry, another
partitioning or another engine walks the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pannier.operators.numbering import id_slices, running_sum, slice_of
from pannier.session import dealt, materialise


def weight_slots(edges: DataFrame) -> DataFrame:
    """(src, slot, shares): shares are (upto, dst, total, width) of the neighbours that touch the slot, in order.

    ``edges(src, dst, weight)`` is a stored table with whole weights above zero and both directions.
    """
    nodes = edges.groupBy("src").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    nodes = materialise(nodes.select("src", "total", F.ceil(F.col("total") / F.col("n")).alias("width")), "walk_nodes")
    block = slice_of("dst", id_slices(edges, "dst"))
    upto = running_sum(edges, ["src"], block, [F.col("dst")], "weight", "upto")
    theirs = nodes.select(F.col("src").alias("dst"), F.col("total").alias("dst_total"), F.col("width").alias("dst_width"))
    rows = upto.join(nodes.select("src", "width"), "src").join(theirs, "dst")
    first = F.floor((F.col("upto") - F.col("weight")) / F.col("width"))
    last = F.floor((F.col("upto") - 1) / F.col("width"))
    share = F.struct("upto", "dst", F.col("dst_total").alias("total"), F.col("dst_width").alias("width"))
    return (
        rows.select("src", F.explode(F.sequence(first, last)).alias("slot"), share.alias("share"))
        .groupBy("src", "slot")
        .agg(F.sort_array(F.collect_list("share")).alias("shares"))
    )


def draw(step: int, seed: int, below: Column) -> Column:
    """A whole number in [0, below), fixed by start, walk, step and seed."""
    text = F.concat_ws(":", F.col("start").cast("string"), F.col("walk").cast("string"), F.lit(f"{step}:{seed}"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), below)


def random_walks(
    edges: DataFrame, walk_length: int = 20, num_walks: int = 10, seed: int = 42
) -> DataFrame:
    """The log (start, walk, step, node) of ``num_walks`` first-order walks of ``walk_length`` nodes from every node."""
    edges = materialise(
        edges.select("src", "dst", F.col("weight").cast("long").alias("weight")), "walk_edges"
    )
    # stored dealt by the key of every step's join: a step moves walks, never the graph
    slots = dealt(weight_slots(edges), "weight_slots", "src", "slot")
    totals = edges.groupBy("src").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    now = materialise(
        totals.select(
            F.col("src").alias("start"),
            F.explode(F.sequence(F.lit(1), F.lit(num_walks))).alias("walk"),
            F.lit(0).alias("step"),
            F.col("src").alias("node"),
            "total",
            F.ceil(F.col("total") / F.col("n")).alias("width"),
        ),
        "walk_log",
    )
    log = [now]
    for step in range(1, walk_length):
        drawn = now.withColumn("_u", draw(step, seed, F.col("total"))).select(
            "start", "walk", "_u", F.col("node").alias("src"), F.floor(F.col("_u") / F.col("width")).alias("slot")
        )
        picked = drawn.join(slots, ["src", "slot"]).withColumn(
            "_s", F.element_at(F.filter("shares", lambda s: s["upto"] > F.col("_u")), 1)
        )
        now = materialise(
            picked.select(
                "start",
                "walk",
                F.lit(step).alias("step"),
                F.col("_s.dst").alias("node"),
                F.col("_s.total").alias("total"),
                F.col("_s.width").alias("width"),
            ),
            "walk_log",
        )
        log.append(now)
    out = log[0]
    for part in log[1:]:
        out = out.unionByName(part)
    return out.select("start", "walk", "step", "node")
