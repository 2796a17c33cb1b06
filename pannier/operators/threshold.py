"""Best sums over ranked lists, read in blocks until nothing better can follow.

A query asks for some lists with weights; an item's score is the weighted sum of
its entries in them. A best-selling item's list holds nearly every item, so lists
are stored ranked, in blocks of ``FIRST`` entries, then twice as many and so on. In round
``r`` a query reads the blocks up to ``r`` of its lists. What an unread block can
still add is at most its first score, so with the sum ``t`` of these bounds

* an item not met so far scores at most ``t``,
* one met so far scores at least its sum, and at most that plus ``t``.

A query is settled when its k-th sum is above ``t``: only items whose sum plus ``t``
reaches the k-th sum can be among the best, and for those few the missing entries
are looked up. The result is exact for weights above zero. Rounds read a prefix
anew, which at most doubles what is read, and only for queries that are not settled.

A query's lists meet in one task: ``LISTS`` of them at most, since callers sum more than
that into a list of the query's own; when a prefix would exceed ``READ`` entries the query is
summed by the shuffle instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pannier.operators.numbering import place_rows
from pannier.operators.topk import sort_score, top_k
from pannier.session import materialise

#: Entries of a list's first block; blocks double up to ``FIRST << DOUBLED`` entries.
FIRST = 256
DOUBLED = 8
#: Lists of a query that are read side by side, and entries that a query may read.
LISTS = 1000
READ = 1 << 22
#: Items of a settled query whose missing entries are looked up.
LOOKED_UP = 1000
#: Lists longer than this are ranked over several tasks.
LONG = 10_000
#: Entries that a task sums at once, unless one query has more.
SUMMED = 1 << 19
_EPS = 2e-9
_KEY = ["kind", "list_id"]


def block_of(rank: Column) -> Column:
    """Block of an entry by its place in the list, from 0."""
    edge = FIRST * ((1 << DOUBLED) - 1)
    early = F.floor(F.log2(rank / FIRST + 1))
    return F.when(rank < edge, early).otherwise(DOUBLED + F.floor((rank - edge) / (FIRST << DOUBLED))).cast("int")


def read_upto(r: int) -> int:
    """Entries of a list in its blocks 0 .. r."""
    return FIRST * ((1 << min(r + 1, DOUBLED)) - 1) + (FIRST << DOUBLED) * max(0, r + 1 - DOUBLED)


def _edge(block: Column) -> Column:
    """Place in the list where a block begins."""
    early = (F.pow(F.lit(2), F.least(block, F.lit(DOUBLED))).cast("int") - 1) * FIRST
    return early + F.greatest(block - DOUBLED, F.lit(0)) * (FIRST << DOUBLED)


def list_blocks(entries: DataFrame, longest: int | None = None) -> DataFrame:
    """Ranked lists in blocks, from ``entries(kind, list_id, item_id, score)``.

    ``longest`` is a length that no list exceeds; where it is unknown or more than ``LONG``, entries
    are read more than once and should be a stored table.

    (kind, list_id, block, ids, scores, next): best first, then by item; ``next`` is the
    first score after the block, null at the end. A usual list is sorted and cut in one
    row; one of more than ``LONG`` entries is ranked over several tasks.
    """
    rows = entries.select(*_KEY, "item_id", "score")
    any_long = longest is None or longest > LONG
    if any_long:
        sizes = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
        long = materialise(sizes.where(F.col("n") > LONG).select(*_KEY), "long_lists")
        any_long = not long.isEmpty()
    usual = rows.join(long, _KEY, "left_anti") if any_long else rows
    # the rounded score to sort by is not shuffled along
    ordered = F.transform(
        F.collect_list(F.struct("item_id", "score")),
        lambda e: F.struct((-sort_score(e["score"])).alias("down"), e["item_id"].alias("item_id"), e["score"].alias("score")),
    )
    packed = usual.groupBy(*_KEY).agg(F.sort_array(ordered).alias("e"))
    cut = (
        packed.withColumn("block", F.explode(F.sequence(F.lit(0), block_of(F.size("e") - 1))))
        .withColumn("_from", _edge(F.col("block")))
        .withColumn("_end", _edge(F.col("block") + 1))
        .withColumn("part", F.slice("e", F.col("_from") + 1, F.col("_end") - F.col("_from")))
        .select(
            *_KEY,
            "block",
            F.col("part.item_id").alias("ids"),
            F.col("part.score").alias("scores"),
            F.try_element_at("e", F.col("_end") + 1)["score"].alias("next"),
        )
    )
    if not any_long:
        return cut
    deep_rows = rows.withColumn("down", -sort_score()).join(long, _KEY, "left_semi")
    placed = place_rows(deep_rows, _KEY, ["down", "item_id"], "rank")
    deep = placed.withColumn("block", block_of(F.col("rank")))
    parts = deep.groupBy(*_KEY, "block").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id", "score"))).alias("e"))
    heads = deep.groupBy(*_KEY, (F.col("block") - 1).alias("block")).agg(F.max_by("score", -F.col("rank")).alias("next"))
    return cut.unionByName(
        parts.join(heads, [*_KEY, "block"], "left").select(
            *_KEY, "block", F.col("e.item_id").alias("ids"), F.col("e.score").alias("scores"), "next"
        )
    )


def entries_of(blocks: DataFrame) -> DataFrame:
    """The single entries of blocks: kind, list_id, item_id, score."""
    return blocks.select(*_KEY, F.explode(F.arrays_zip("ids", "scores")).alias("e")).select(
        *_KEY, F.col("e.ids").alias("item_id"), F.col("e.scores").alias("score")
    )


def _settle(rows: pa.Table, r: int, k: int) -> pa.Table:
    """Results of whole queries after round ``r``: state ``d`` final, ``c`` to look up, ``m`` to go on."""
    names, code = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
    ids, scores = rows["ids"].combine_chunks(), rows["scores"].combine_chunks()
    lens = ids.value_lengths().to_numpy(zero_copy_only=False)
    items, place = np.unique(ids.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    weight = rows["weight"].to_numpy()
    owned = np.isnan(weight)
    key = np.repeat(code, lens) * max(1, len(items)) + place
    value = np.repeat(np.where(owned, 0.0, weight), lens) * scores.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    key, value, mine = key[order], value[order], np.repeat(owned, lens)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    sums = np.add.reduceat(value, first) if len(first) else np.empty(0)
    free = ~np.logical_or.reduceat(mine, first) if len(first) else np.empty(0, bool)
    q, item, sums = (key[first] // max(1, len(items)))[free], items[key[first] % max(1, len(items))][free], sums[free]
    best = np.lexsort((item, -np.round(sums, 9), q))
    q, item, sums = q[best], item[best], sums[best]
    counts = np.bincount(q, minlength=len(names))
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    rank = np.arange(len(q)) - starts[q]

    following = rows["next"].to_numpy()
    open_ = (rows["block"].to_numpy() == r) & ~owned & ~np.isnan(following)
    bound = np.bincount(code[open_], weights=(weight * following)[open_], minlength=len(names))
    kth = np.full(len(names), -np.inf)
    full = counts >= k
    kth[full] = sums[starts[full] + k - 1]
    final = bound <= 0
    near = sums + bound[q] + _EPS >= kth[q]
    few = np.bincount(q[near], minlength=len(names)) <= LOOKED_UP
    settled = ~final & (kth > bound + _EPS) & few
    out = (final[q] & (rank < k)) | (settled[q] & near)
    more = np.flatnonzero(~final & ~settled)
    state = np.where(final[q[out]], "d", "c")
    return pa.table(
        {
            "query_id": pa.array(np.concatenate([names[q[out]], names[more]])),
            "item_id": pa.array(np.concatenate([item[out], np.zeros(len(more), item.dtype)]), pa.int64()),
            "score": pa.array(np.concatenate([sums[out], np.zeros(len(more))])),
            "state": pa.array(np.concatenate([state, np.full(len(more), "m")]), pa.string()),
        }
    )


def _round(asks: DataFrame, owned: DataFrame, blocks: DataFrame, r: int, k: int) -> DataFrame:
    rows = asks.join(blocks.where(F.col("block") <= r), _KEY).select(
        "query_id", *_KEY, "block", "weight", "ids", "scores", "next"
    )
    own = owned.select(
        "query_id",
        F.lit(-1).alias("kind"),
        F.col("item_id").alias("list_id"),
        F.lit(-1).alias("block"),
        F.lit(float("nan")).alias("weight"),
        F.array("item_id").alias("ids"),
        F.array(F.lit(0.0)).alias("scores"),
        F.lit(None).cast("double").alias("next"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += len(batch["ids"].flatten())
            if size < SUMMED:
                continue
            whole = pa.concat_tables(held).combine_chunks()
            names = whole["query_id"].to_numpy()
            cut = int(np.searchsorted(names, names[-1]))  # the last query may go on
            if cut:
                yield from _settle(whole.slice(0, cut), r, k).to_batches()
            held = [whole.slice(cut)]
            size = len(held[0]["ids"].combine_chunks().flatten())
        if held:
            yield from _settle(pa.concat_tables(held).combine_chunks(), r, k).to_batches()

    dealt = rows.unionByName(own).repartition("query_id").sortWithinPartitions("query_id", *_KEY, "block")
    return dealt.mapInArrow(run, "query_id long, item_id long, score double, state string")


def _missing(found: DataFrame, asks: DataFrame, blocks: DataFrame, r: int) -> DataFrame:
    """Scores of the items to look up, with their entries beyond block ``r``."""
    unread = asks.where(F.col("n") > read_upto(r)).select("query_id", *_KEY, "weight")
    deep = entries_of(blocks.where(F.col("block") > r).join(unread.select(*_KEY).distinct(), _KEY, "left_semi"))
    deep = deep.withColumnRenamed("score", "more")
    extra = (
        found.select("query_id", "item_id")
        .join(unread, "query_id")
        .join(deep, [*_KEY, "item_id"])
        .groupBy("query_id", "item_id")
        .agg(F.sum(F.col("weight") * F.col("more")).alias("more"))
    )
    return found.join(extra, ["query_id", "item_id"], "left").select(
        "query_id", "item_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")
    )


def summed(asks: DataFrame, owned: DataFrame, blocks: DataFrame) -> DataFrame:
    """All scores of the queries, by multiplying out their lists."""
    return (
        asks.select("query_id", *_KEY, "weight")
        .join(entries_of(blocks), _KEY)
        .groupBy("query_id", "item_id")
        .agg(F.sum(F.col("weight") * F.col("score")).alias("score"))
        .join(owned, ["query_id", "item_id"], "left_anti")
    )


def best_sums(
    asks: DataFrame, owned: DataFrame, blocks: DataFrame, k: int, log: list | None = None
) -> DataFrame:
    """The ``k`` best items of each query: query_id, rank, item_id, score.

    asks: query_id, kind, list_id, weight (above zero, one row per query and list);
    owned: distinct (query_id, item_id) that may not be proposed; blocks as
    ``list_blocks`` makes them, stored. ``log`` collects per round how many queries
    ended in which state.
    """
    sizes = blocks.groupBy(*_KEY).agg(F.sum(F.size("ids")).alias("n"))
    asks = materialise(asks.join(sizes, _KEY), "asks")
    owned = materialise(owned.join(asks.select("query_id").distinct(), "query_id", "left_semi"), "asks_owned")
    out: DataFrame | None = None

    def add(part: DataFrame) -> None:
        nonlocal out
        out = part if out is None else out.unionByName(part)

    r = 0
    while True:
        found = materialise(_round(asks, owned, blocks, r, k), "round")
        add(found.where("state = 'd'").select("query_id", "item_id", "score"))
        states = {s["state"]: s["n"] for s in found.groupBy("state").agg(F.count_distinct("query_id").alias("n")).collect()}
        if "c" in states:
            looked = found.where("state = 'c'").select("query_id", "item_id", "score")
            add(_missing(looked, asks, blocks, r))
        if log is not None:
            log.append((r, states))
        if "m" not in states:
            return top_k(out, k)
        left = found.where("state = 'm'").select("query_id")
        asks = asks.join(left, "query_id", "left_semi")
        owned = owned.join(left, "query_id", "left_semi")
        r += 1
        reads = asks.groupBy("query_id").agg(F.sum(F.least("n", F.lit(read_upto(r)))).alias("reads"))
        big = materialise(reads.where(F.col("reads") > READ).select("query_id"), "large_reads")
        if not big.isEmpty():
            mine = lambda df: df.join(big, "query_id", "left_semi")
            add(summed(mine(asks), mine(owned), blocks))
            asks, owned = (df.join(big, "query_id", "left_anti") for df in (asks, owned))
            if asks.isEmpty():
                return top_k(out, k)
