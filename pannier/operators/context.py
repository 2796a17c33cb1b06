"""Words in lines, and how often two words stand near each other.

A line is a basket in recorded order, a walk or a description. Lines stay in long
form, one row per place; a line of any length is cut into chunks of ``CHUNK`` places
that overlap by the window, so no task holds a whole line and no context is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pannier.operators.numbering import number_rows, place_rows

#: Places of a line that meet in one task.
CHUNK = 1024


def basket_words(items: DataFrame) -> DataFrame:
    """(line, at, word) of baskets: items in recorded order, places from 0."""
    order = [c for c in ("order_ts", "segment", "pos") if c in items.columns] + ["item_id"]
    rows = items.select("order_id", "size", *order)
    usual = Window.partitionBy("order_id").orderBy(*order)
    placed = rows.where(F.col("size") <= CHUNK).withColumn("at", F.row_number().over(usual) - 1)
    long = rows.where(F.col("size") > CHUNK)
    if not long.isEmpty():
        placed = placed.unionByName(place_rows(long, ["order_id"], order, "at"))
    return placed.select(
        F.col("order_id").alias("line"), F.col("at").cast("long").alias("at"), F.col("item_id").alias("word")
    )


def array_words(lines: DataFrame, line: Column, words: str) -> DataFrame:
    """(line, at, word) of an array column."""
    return lines.select(line.alias("line"), F.posexplode(words).alias("at", "word")).select(
        "line", F.col("at").cast("long").alias("at"), "word"
    )


def frequent_words(words: DataFrame, min_count: int) -> DataFrame:
    """Lines without the words seen fewer than ``min_count`` times; places close up."""
    if min_count <= 1:
        return words
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    kept = words.join(counts.select("word"), "word", "left_semi")
    return number_rows(kept, ["line"], F.floor(F.col("at") / CHUNK), [F.col("at")], "place", start=0).select(
        "line", F.col("place").alias("at"), "word"
    )


def context_pairs(words: DataFrame, window: int) -> DataFrame:
    """(u, i, weight): how often ``i`` stands within ``window`` places of ``u``, both ways, another word than it."""
    chunk = F.floor(F.col("at") / CHUNK)
    copies = F.when(
        (F.col("at") % CHUNK < window) & (F.col("at") >= CHUNK), F.array(chunk, chunk - 1)
    ).otherwise(F.array(chunk))
    if window >= CHUNK:
        raise ValueError(f"a window has fewer than {CHUNK} places")
    rows = words.select("line", "at", "word", chunk.alias("own"), F.explode(copies).alias("chunk"))
    along = Window.partitionBy("line", "chunk").orderBy("at")
    ahead = F.array(*[F.lead("word", k).over(along) for k in range(1, window + 1)])
    near = (
        rows.withColumn("next", ahead)
        .where("own = chunk")
        .select(F.col("word").alias("a"), F.explode("next").alias("b"))
        .where("b is not null and a <> b")
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    return near.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("u"), F.col("b").alias("i"), "weight"),
                F.struct(F.col("b").alias("u"), F.col("a").alias("i"), "weight"),
            )
        ).alias("p")
    ).select("p.u", "p.i", "p.weight")
