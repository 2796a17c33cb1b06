"""Row numbers for groups that may be far larger than one task should hold.

A plain ``row_number`` sends a whole group to one task. Here the rows of a group
are cut into blocks by an expression that never decreases in the wanted order;
the blocks are counted, a running sum over the counts gives the number of rows
ahead of a block, and only the rows of one block meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pannier.session import materialise


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    block: Column,
    order: Sequence[Column],
    name: str,
    start: int = 1,
    limits: DataFrame | None = None,
) -> DataFrame:
    """Add ``name`` = position of the row in its group under ``order``.

    ``block`` must be non-decreasing along ``order``. With ``limits`` (the group
    columns and ``limit``) blocks that begin behind the limit are left out before
    any row is sorted; groups without a limit go entirely.
    """
    marked = df.withColumn("_block", block)
    counts = marked.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*group).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *group, "_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")
    )
    if limits is not None:
        offsets = offsets.join(limits, [*group]).where("_ahead < limit").drop("limit")
    inside = Window.partitionBy(*group, "_block").orderBy(*order)
    return (
        marked.join(offsets, [*group, "_block"])
        .withColumn(name, F.col("_ahead") + F.row_number().over(inside) + (start - 1))
        .drop("_block", "_ahead")
    )


def place_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name`` = place of the row in its group by the columns ``order``, from 0.

    For orders that no expression cuts into blocks: rows are dealt by ranges of
    (group, order), and a range is a block. Rows equal in all these columns may
    change places among each other.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = materialise(
        df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    return number_rows(ranged, group, F.col("_part"), [F.col(c) for c in order], name, start=0).drop("_part")


def running_sum(
    df: DataFrame, group: Sequence[str], block: Column, order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Add ``name`` = sum of ``value`` up to and with the row, block by block as in ``number_rows``."""
    marked = df.withColumn("_block", block)
    sums = marked.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.join(offsets, [*group, "_block"])
        .withColumn(name, F.col("_ahead") + F.sum(value).over(inside))
        .drop("_block", "_ahead")
    )


def by_hash(hex_digest: str) -> Column:
    """Blocks for an order by a hexadecimal digest: 65536 even slices."""
    return F.substring(hex_digest, 1, 4)


def dense_index(df: DataFrame, key: str, name: str, blocks: int = 1 << 14) -> DataFrame:
    """Consecutive numbers from 0 for the distinct values of ``key``."""
    return number_rows(
        df.select(key).distinct(),
        [],
        F.pmod(F.xxhash64(key), F.lit(blocks)),
        [F.col(key)],
        name,
        start=0,
    )


def id_slices(df: DataFrame, column: str, slices: int = 64) -> list[int]:
    """Cut points of a numeric column into about equal shares (a fixed few numbers)."""
    points = [F.lit(i / slices) for i in range(1, slices)]
    row = df.agg(F.percentile_approx(column, F.array(*points), F.lit(2000)).alias("p")).first()
    return sorted(set(row["p"] or [])) if row else []


def slice_of(column: str, cuts: list[int]) -> Column:
    """Number of cut points below the value."""
    if not cuts:
        return F.lit(0)
    return F.size(
        F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col(column))
    )


def popularity_rank(counts: DataFrame, freq: str = "freq", start: int = 1) -> DataFrame:
    """Rank items by ``freq`` descending, then by id.

    Few frequencies may cover most items (the long tail), so a block is one
    frequency and one slice of the ids. ``counts`` should be a stored table: it
    is read three times.
    """
    cuts = id_slices(counts, "item_id")
    block = F.struct((-F.col(freq)).alias("f"), slice_of("item_id", cuts).alias("s"))
    return number_rows(
        counts, [], block, [F.col(freq).desc(), F.col("item_id")], "rank", start
    )
