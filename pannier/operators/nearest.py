"""Exact nearest items for many query vectors, cell by cell.

Items are dealt to cells around pivots; a cell knows its radius, the largest
distance of a member from the pivot ``c``. By the triangle inequality no member of a
cell scores above ``q.c + |q| x radius`` for a query ``q``. Each query visits cells from
the highest bound down, first one, then eight times as many a round, and stops where
the bound falls below the score of the last item it wants. What is left out cannot be
among the wanted items, so the result is that of comparing all with all.

A visit is a matrix product of a block of a cell and a block of the queries that
visit it, which returns what reaches the last item wanted so far (``_search``); a cell is replicated only to query blocks that ask for it. Pivots (at
most ``CELLS``) are the only thing that every task gets. Cosine is the product of
unit vectors; a zero vector scores 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pannier.operators.topk import sort_score
from pannier.session import materialise

BLOCK_ROWS = 65_536
#: Most cells; beyond that cells grow, and are split into blocks of ``BLOCK_ROWS``.
CELLS = 4096
#: Cells a query visits in the first round, and how many times as many in each next one.
STEP = 8
# Scores held at once inside a task.
_TILE = 4_000_000
# Queries and items of one product, and products waiting to be computed in full, inside a task.
_QUERIES = 256
_ITEMS = 2048
_WAITING = 1 << 18
_EPS = 1e-6


def _rows(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if column.null_count or len(pa.compute.unique(pa.compute.list_value_length(column))) > 1:
        raise ValueError("vectors are missing or of unequal lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=m.copy(), where=length > 0)


def _first(row: np.ndarray, col: np.ndarray, score: np.ndarray, ids: np.ndarray, wants: np.ndarray) -> tuple:
    """The first ``wants`` of each row, compared to nine decimals; the smaller id wins a tie. Rows ascend."""
    order = np.lexsort((ids[col], -np.round(score, 9), row))
    row, col, score = row[order], col[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, np.arange(len(wants)))[row] < wants[row]
    return row[kept], col[kept], score[kept]


def _search(q: np.ndarray, x: np.ndarray, ids: np.ndarray, wants: np.ndarray, last: np.ndarray) -> tuple:
    """Rows, columns and products of the first ``wants`` items of each query that reach ``last``.

    Products are screened in single precision, less the most by which they can be wrong; what passes is
    multiplied in double precision. The bar of a query rises to the last item it would keep of those met.
    Long items come first; a query is done when the next one is too short for it.
    """
    lengths, norms = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    longest = norms.max(where=~np.isnan(norms), initial=0)
    falling = np.argsort(-norms, kind="stable")
    x, ids, norms = x[falling], ids[falling], norms[falling]
    kind = np.float32 if max(most_length := lengths.max(where=~np.isnan(lengths), initial=0), longest, most_length * longest) < 1e30 else np.float64
    slack = (x.shape[1] + 8) * np.finfo(kind).eps * lengths * longest + 2e-9
    a, b = q.astype(kind), x.astype(kind)
    bars = np.where(wants > 0, np.where(np.isnan(last), -np.inf, last - slack), np.inf)
    rows, cols, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for lo in range(0, len(q), _QUERIES):
        part = slice(lo, lo + _QUERIES)
        want, bar, most = wants[part], bars[part], int(wants[part].max())
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        new: list[np.ndarray] = []
        at = waiting = 0
        due = width = max(_ITEMS, 4 * most)
        while at < len(b):
            able = np.flatnonzero(lengths[part] * norms[at] >= bar) if at else np.arange(len(want))
            if not len(able) and not waiting:
                break
            tile = a[part][able] @ b[at : at + width].T
            if not at and most < tile.shape[1] and np.isneginf(bar).any():
                kth = np.partition(tile, tile.shape[1] - most, axis=1)[:, tile.shape[1] - most]
                bar = np.maximum(bar, kth - 2 * slack[part])
            hit = np.flatnonzero(tile >= bar[able].astype(kind)[:, None])
            new.append(able[hit // tile.shape[1]] * len(b) + hit % tile.shape[1] + at)
            at, waiting = at + tile.shape[1], waiting + len(hit)
            if waiting and (at >= due or at == len(b) or waiting > _WAITING):
                r, c = np.divmod(np.concatenate(new), len(b))
                exact = np.concatenate(
                    [
                        np.einsum("ij,ij->i", q[lo + r[k : k + _WAITING]], x[c[k : k + _WAITING]])
                        for k in range(0, len(r), _WAITING)
                    ]
                )
                held = _first(*(np.concatenate(p) for p in zip(held, (r, c, exact))), ids, want)
                full = np.bincount(held[0], minlength=len(want)) >= np.maximum(want, 1)
                end = np.searchsorted(held[0], np.arange(len(want)), "right") - 1
                bar = bar.copy()
                bar[full] = np.maximum(bar[full], held[2][end[full]] - slack[part][full])
                new, waiting = [], 0
            if at >= due:
                due = 8 * at
        rows.append(held[0] + lo)
        cols.append(falling[held[1]])
        scores.append(held[2])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _block_product(cosine: bool):
    def product(queries: pa.Table, items: pa.Table) -> pa.Table:
        asks, found, values = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(queries) and len(items):
            queries = queries.sort_by("want")  # queries that want many meet in few tiles
            mine, theirs = (_rows(t["vec"].combine_chunks()) for t in (queries, items))
            if cosine:
                mine, theirs = _unit(mine), _unit(theirs)
            ids, names, wants, last = (
                t[c].combine_chunks().to_numpy(zero_copy_only=False)
                for t, c in ((items, "item_id"), (queries, "query_id"), (queries, "want"), (queries, "last"))
            )
            row, col, values = _search(mine, theirs, ids, wants, last)
            asks, found = names[row], ids[col]
        return pa.table({"query_id": asks, "item_id": found, "score": values})

    return product


def _cells(items: DataFrame, n: int, block_rows: int, cosine: bool) -> tuple[DataFrame, np.ndarray, np.ndarray, list[int]]:
    """Items with cell and block; pivots, radii and numbers of blocks by cell."""
    spark = items.sparkSession
    cells = max(1, min(CELLS, math.ceil(n / block_rows)))
    if cells == 1:
        placed = items.select("item_id", "vec", F.lit(0).alias("cell"), F.lit(0).alias("block"))
        return placed, np.zeros((1, 1)), np.array([np.inf]), [1]
    chosen = items.orderBy(F.xxhash64("item_id"), "item_id").limit(cells).collect()  # at most CELLS vectors
    pivots = np.array([r["vec"] for r in chosen], dtype=np.float64)
    if cosine:
        pivots = _unit(pivots)
    sent = spark.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch["vec"])
            x = _unit(x) if cosine else x
            cell, far = np.empty(len(x), np.int32), np.empty(len(x))
            step = max(1, _TILE // len(centres))
            for lo in range(0, len(x), step):
                part = x[lo : lo + step]
                cell[lo : lo + step] = np.argmax(part @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
                far[lo : lo + step] = np.linalg.norm(part - centres[cell[lo : lo + step]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["item_id"], batch["vec"], pa.array(cell), pa.array(far)], ["item_id", "vec", "cell", "far"]
            )

    kind = items.schema["vec"].dataType.simpleString()
    placed = materialise(
        items.select("item_id", "vec").mapInArrow(run, f"item_id long, vec {kind}, cell int, far double"), "cells"
    )
    radii, blocks = np.zeros(cells), [1] * cells
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        radii[r["cell"]], blocks[r["cell"]] = r["far"], math.ceil(r["n"] / block_rows)
    of = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("cell") + 1) if max(blocks) > 1 else F.lit(1)
    return placed.withColumn("block", F.pmod(F.xxhash64("item_id"), of).cast("int")), pivots, radii, blocks


def _visits(asks: DataFrame, pivots: np.ndarray, radii: np.ndarray, cosine: bool, lo: int, hi: int) -> DataFrame:
    """(query_id, vec, want, last, cell): cells ``lo`` .. ``hi`` in each query's order whose bound reaches ``last``."""
    sent = asks.sparkSession.sparkContext.broadcast((pivots, radii))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, far = sent.value
        step = max(1, _TILE // len(far))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                q = _rows(batch["vec"])
                q = _unit(q) if cosine else q
                bound = q @ centres.T + np.linalg.norm(q, axis=1)[:, None] * far
                order = np.argsort(-bound, axis=1, kind="stable")[:, lo:hi]
                last = batch["last"].to_numpy(zero_copy_only=False)
                reach = np.take_along_axis(bound, order, axis=1) >= np.where(np.isnan(last), -np.inf, last)[:, None] - _EPS
                row, col = np.nonzero(reach)
                if len(row):
                    picked = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [*(picked[c] for c in ("query_id", "vec", "want", "last")), pa.array(order[row, col].astype(np.int32))],
                        ["query_id", "vec", "want", "last", "cell"],
                    )

    kind = asks.schema["vec"].dataType.simpleString()
    return asks.select("query_id", "vec", "want", "last").mapInArrow(run, f"query_id long, vec {kind}, want long, last double, cell int")


def nearest(
    queries: DataFrame,
    items: DataFrame,
    metric: str = "cosine",
    block_rows: int = BLOCK_ROWS,
    log: list[int] | None = None,
) -> DataFrame:
    """Candidates query_id, item_id, score: at least the first ``want`` of each query.

    queries: query_id, vec, want (how many items); items: item_id, vec. Both should be
    stored tables. ``log`` collects the (query, cell) visits of each round.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric {metric!r}")
    cosine = metric == "cosine"
    n_items, n_queries = items.count(), queries.count()
    placed, pivots, radii, blocks = _cells(items, n_items, block_rows, cosine)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    query_blocks = max(
        math.ceil(n_queries / block_rows),
        min(math.ceil(cores / len(blocks)), math.ceil(n_queries / 256)),
        1,
    )
    asks = queries.select("query_id", "vec", F.col("want").cast("long").alias("want"))
    asks = asks.withColumn("last", F.lit(None).cast("double"))

    def scored(visits: DataFrame) -> DataFrame:
        of = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("cell") + 1) if max(blocks) > 1 else F.lit(1)
        share = F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")
        left = visits.withColumn("_qb", share).withColumn("block", F.explode(F.sequence(F.lit(0), of - 1)))
        wanted = visits.select(F.col("cell").alias("_cell"), share.alias("_share")).distinct()
        right = placed.join(wanted, F.col("cell") == F.col("_cell")).select(
            *[F.col(c).alias(n) for c, n in (("cell", "cell"), ("block", "block"), ("_share", "_qb"))],
            "item_id",
            F.col("vec").alias("vec"),
        )
        keys = ["cell", "block", "_qb"]
        return (
            left.groupBy(*keys)
            .cogroup(right.groupBy(*keys))
            .applyInArrow(_block_product(cosine), "query_id long, item_id long, score double")
        )

    if len(blocks) == 1:
        if log is not None:
            log.append(n_queries)
        return scored(asks.withColumn("cell", F.lit(0)))
    best: DataFrame | None = None
    lo, hi = 0, 1
    first = Window.partitionBy("query_id").orderBy(sort_score().desc(), F.col("item_id"))
    while lo < len(blocks):
        visits = materialise(_visits(asks, pivots, radii, cosine, lo, hi), "visits")
        n = visits.count()
        if log is not None:
            log.append(n)
        if not n:
            break
        found = scored(visits) if best is None else best.unionByName(scored(visits))
        ranks = found.withColumn("_r", F.row_number().over(first)).join(queries.select("query_id", "want"), "query_id")
        best = materialise(ranks.where("_r <= want").select("query_id", "item_id", "score"), "nearest")
        full = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
        asks = asks.drop("last").join(full, "query_id", "left").select(
            "query_id", "vec", "want", F.when(F.col("n") >= F.col("want"), F.col("low")).alias("last")
        )
        lo, hi = hi, hi * STEP
    return best
