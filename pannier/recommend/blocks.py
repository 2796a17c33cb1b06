"""Vectors from weighted pairs, trained block against block.

Left and right ids are dealt by hash to the same number of blocks, which makes a
grid of cells. A sweep has as many turns as there are blocks: in turn ``s`` a task
holds left block ``t``, right block ``t + s`` and the pairs of their cell, and takes
many steps on them; no other task holds a vector of these blocks. Only vectors
move between turns. Pairs are packed once, by turn, so a turn reads its own cells.

Neither the driver nor a task holds a whole factor table: a task's share is two
blocks of about ``BLOCK_ROWS`` vectors at most (more only beyond ``MOST_BLOCKS`` blocks, so
that a sweep has a bounded number of turns) and a cell of distinct pairs. What a step
does follows from ids, seed, sweep and cell, so the vectors do not depend on the
number of partitions or executors, and a lost task is redone alike.

Losses: ``bpr`` compares a seen item with one of its block that the left id lacks;
``skipgram`` takes pairs by weight against noise drawn by frequency ** 0.75. Every
left id meets noise in proportion to its own weight in all blocks, also in those
that hold none of its pairs. Steps are scaled by the running mean square of each
vector's gradients, so a word in a third of all pairs does not overshoot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pannier.session import discard, materialise

#: Vectors that a block should have at most, and most blocks of a side.
BLOCK_ROWS = 1 << 18
MOST_BLOCKS = 256
#: Pairs that an average cell should have at least; more than ``CELL_BLOCKS`` blocks are made for vectors only, since
#: all vectors move in every turn and a sweep has a turn for each block.
CELL_PAIRS = 1 << 14
CELL_BLOCKS = 16
#: Times that every cell is visited; the iterations are shared out among them.
SWEEPS = 4
#: Turns between two cuts of the lineage.
CUT_TURNS = 8
#: Left rows whose pairs are packed into one row.
PACK_ROWS = 1 << 11
#: Pairs of a step; noise vectors a step shares, and noise draws for each unit of weight.
STEP_PAIRS = 1024
SHARED_NOISE = 64
NOISE = 5
_STATE = "side string, block int, mass array<float>, vec binary, sq binary"


@dataclass(frozen=True)
class BlockConfig:
    factors: int = 64
    iterations: int = 20
    learning_rate: float = 0.05
    regularization: float = 0.0
    loss: str = "skipgram"
    seed: int = 42


def _index(ids: DataFrame, side: str, blocks: int) -> DataFrame:
    """(id, mass, block, row): rows count from 0 in each block."""
    inside = Window.partitionBy("block").orderBy("id")
    return materialise(
        ids.withColumn("block", F.pmod(F.xxhash64("id", F.lit(side)), F.lit(blocks)).cast("int")).withColumn(
            "row", F.row_number().over(inside) - 1
        ),
        f"index-{side}",
    )


def _cells(pairs: DataFrame, left: DataFrame, right: DataFrame, blocks: int) -> DataFrame:
    """(turn, t, l, r, w): the pairs of a cell as arrays of rows and weights, in a fixed order."""
    a = left.select(F.col("id").alias("u"), F.col("block").alias("lb"), F.col("row").alias("l"))
    b = right.select(F.col("id").alias("i"), F.col("block").alias("rb"), F.col("row").alias("r"))
    packed = (
        pairs.join(a, "u")
        .join(b, "i")
        .groupBy("lb", "rb", F.floor(F.col("l") / PACK_ROWS).alias("chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("l", "r", F.col("weight").cast("float").alias("w")))).alias("p"))
    )
    return materialise(
        packed.select(
            F.pmod(F.col("rb") - F.col("lb"), F.lit(blocks)).alias("turn"),
            F.col("lb").alias("t"),
            "chunk",
            F.col("p.l").alias("l"),
            F.col("p.r").alias("r"),
            F.col("p.w").alias("w"),
        ),
        "cells",
        ("turn",),
    )


def _first_state(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per block: the weights of its rows; vectors begin in the block's first visit."""
    sides = left.withColumn("side", F.lit("l")).unionByName(right.withColumn("side", F.lit("r")))
    return sides.groupBy("side", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("row", "mass"))), lambda x: x["mass"].cast("float")).alias("mass"),
        F.lit(None).cast("binary").alias("vec"),
        F.lit(None).cast("binary").alias("sq"),
    )


class Block:
    """Vectors of a block and the running squares of their gradients."""

    def __init__(self, side: str, block: int, mass: np.ndarray, vec: bytes | None, sq: bytes | None, cfg: BlockConfig):
        self.side, self.block, self.mass = side, block, mass
        shape = (len(mass), cfg.factors)
        if vec is None:
            rng = np.random.default_rng([cfg.seed, side == "r", block])
            self.vec = ((rng.random(shape, dtype=np.float32) - np.float32(0.5)) / cfg.factors).astype(np.float32)
            self.sq = np.zeros(len(mass), np.float32)
        else:
            self.vec = np.frombuffer(vec, np.float32).reshape(shape).copy()
            self.sq = np.frombuffer(sq, np.float32).copy()
        self.lead = np.empty(len(mass), np.int64)

    def step(self, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
        """Move the vectors of ``rows`` by their summed gradients."""
        place = np.arange(len(rows))
        self.lead[rows[::-1]] = place[::-1]  # the last assignment holds: the first place of each row
        first = self.lead[rows]
        again = first != place
        sums = grads
        if again.any():  # most rows have one gradient
            fresh = ~again
            rows, sums = rows[fresh], grads[fresh]
            np.add.at(sums, (np.cumsum(fresh) - 1)[first[again]], grads[again])
        self.sq[rows] += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
        move = np.float32(rate) * sums
        move /= np.sqrt(self.sq[rows] + np.float32(1e-8))[:, None]
        move += self.vec.take(rows, axis=0)
        self.vec[rows] = move


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of ``x``: a step's arrays fill the cache, so it makes few."""
    np.clip(x, -30, 30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.divide(1, x, out=x)


def _bpr_pass(a: Block, b: Block, l: np.ndarray, r: np.ndarray, w: np.ndarray, codes: np.ndarray, rng, cfg: BlockConfig) -> None:  # noqa: E741
    order = rng.permutation(len(l))
    reg = np.float32(cfg.regularization)
    for lo in range(0, len(order), STEP_PAIRS):
        u, i = l[order[lo : lo + STEP_PAIRS]], r[order[lo : lo + STEP_PAIRS]]
        j = rng.integers(0, len(b.mass), len(u))
        code = u * len(b.mass) + j
        unseen = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] != code
        u, i, j = u[unseen], i[unseen], j[unseen]
        if not len(u):
            continue
        n, both = len(u), np.concatenate([i, j])
        x, held = a.vec.take(u, axis=0), b.vec.take(both, axis=0)
        gap = held[:n] - held[n:]
        g = (1 - _sigmoid(np.einsum("ij,ij->i", x, gap)))[:, None]
        grads = np.empty_like(held)
        np.multiply(g, x, out=grads[:n])
        np.negative(grads[:n], out=grads[n:])
        held *= reg
        grads -= held
        gap *= g
        x *= reg
        gap -= x
        a.step(u, gap, cfg.learning_rate)
        b.step(both, grads, cfg.learning_rate)


def _skipgram_pass(a: Block, b: Block, l: np.ndarray, r: np.ndarray, w: np.ndarray, noise_total: float, rng, cfg: BlockConfig) -> None:  # noqa: E741
    noise = b.mass**0.75
    mass_at, noise_at = np.cumsum(a.mass, dtype=np.float64), np.cumsum(noise, dtype=np.float64)
    order = rng.permutation(len(l))
    steps = max(1, math.ceil(len(order) / STEP_PAIRS))
    # noise against this block: its share of all noise, for all the weight of the left rows
    each = NOISE * mass_at[-1] * noise_at[-1] / noise_total / (steps * STEP_PAIRS * SHARED_NOISE)
    for k in range(steps):
        at = order[k * STEP_PAIRS : (k + 1) * STEP_PAIRS]
        u, i = l[at], r[at]
        x, y = a.vec.take(u, axis=0), b.vec.take(i, axis=0)
        g = (w[at] * (1 - _sigmoid(np.einsum("ij,ij->i", x, y))))[:, None]
        n = np.minimum(np.searchsorted(mass_at, rng.random(STEP_PAIRS) * mass_at[-1], "right"), len(a.mass) - 1)
        m = np.minimum(np.searchsorted(noise_at, rng.random(SHARED_NOISE) * noise_at[-1], "right"), len(b.mass) - 1)
        p, q = a.vec.take(n, axis=0), b.vec.take(m, axis=0)
        away = _sigmoid(p @ q.T)
        np.multiply(away, -each, out=away, casting="same_kind")
        here, there = np.empty((len(u) + len(n), cfg.factors), np.float32), np.empty((len(u) + len(m), cfg.factors), np.float32)
        np.multiply(g, y, out=here[: len(u)])
        np.matmul(away, q, out=here[len(u) :])
        np.multiply(g, x, out=there[: len(u)])
        np.matmul(away.T, p, out=there[len(u) :])
        a.step(np.concatenate([u, n]), here, cfg.learning_rate)
        b.step(np.concatenate([i, m]), there, cfg.learning_rate)


def _visit(cfg: BlockConfig, passes: range, noise_total: float):
    """A task's turn: many passes over one cell."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["side", "block", "mass", "vec", "sq"]).filter(pa.compute.not_equal(table["side"], "c"))
        held = {
            side: Block(side, block, mass.values.to_numpy().astype(np.float32), vec.as_py(), sq.as_py(), cfg)
            for side, block, mass, vec, sq in zip(
                rows["side"].to_pylist(), rows["block"].to_pylist(), rows["mass"], rows["vec"], rows["sq"]
            )
        }
        cell = table.filter(pa.compute.equal(table["side"], "c")).sort_by("block").combine_chunks()
        if len(cell) and len(held) == 2:
            a, b = held["l"], held["r"]
            l, r, w = (cell[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("l", "r", "w"))  # noqa: E741
            l, r = l.astype(np.int64), r.astype(np.int64)  # noqa: E741
            codes = np.sort(l * len(b.mass) + r) if cfg.loss == "bpr" else None
            for number in passes:
                rng = np.random.default_rng([cfg.seed, number, a.block, b.block])
                if cfg.loss == "bpr":
                    _bpr_pass(a, b, l, r, w, codes, rng, cfg)
                else:
                    _skipgram_pass(a, b, l, r, w, noise_total, rng, cfg)
        elif len(held) == 2 and cfg.loss == "skipgram":  # no pairs, but noise
            a, b = held["l"], held["r"]
            none = np.empty(0, np.int64)
            for number in passes:
                rng = np.random.default_rng([cfg.seed, number, a.block, b.block])
                _skipgram_pass(a, b, none, none, none.astype(np.float32), noise_total, rng, cfg)
        out = list(held.values())
        return pa.table(
            {
                "side": pa.array([x.side for x in out], pa.string()),
                "block": pa.array([x.block for x in out], pa.int32()),
                "mass": pa.array([x.mass for x in out], pa.list_(pa.float32())),
                "vec": pa.array([x.vec.tobytes() for x in out], pa.binary()),
                "sq": pa.array([x.sq.tobytes() for x in out], pa.binary()),
            }
        )

    return run


def _turn(state: DataFrame, cells: DataFrame, s: int, blocks: int, visit) -> DataFrame:
    """State after all cells of turn ``s``."""
    keyed = state.withColumn(
        "t", F.when(F.col("side") == "l", F.col("block")).otherwise(F.pmod(F.col("block") - s, F.lit(blocks)))
    )
    here = cells.where(F.col("turn") == s).select(F.lit("c").alias("side"), F.col("chunk").cast("int").alias("block"), "t", "l", "r", "w")
    # a partition for each cell: by hash, or after merging small partitions, cells would wait for each other
    dealt = keyed.unionByName(here, allowMissingColumns=True).repartitionById(blocks, F.col("t").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from visit(pa.Table.from_batches(held)).to_batches()

    return dealt.mapInArrow(run, _STATE)


def blocks_for(ids: int, pairs: int) -> int:
    """Blocks of each side for so many ids of the larger side and distinct pairs."""
    cells = min(math.sqrt(pairs / CELL_PAIRS), CELL_BLOCKS)
    return min(MOST_BLOCKS, math.ceil(max(ids / BLOCK_ROWS, cells)))


def train_blocks(pairs: DataFrame, cfg: BlockConfig, side: str = "r") -> DataFrame:
    """(id, vec) of the right (``r``) or left (``l``) ids of ``pairs(u, i, weight)``; pairs are distinct.

    Empty pairs give an empty table.
    """
    if cfg.loss not in ("bpr", "skipgram"):
        raise ValueError(f"unknown loss {cfg.loss!r}")
    pairs = materialise(pairs.select("u", "i", "weight"), "pairs")
    ids = {
        "l": pairs.groupBy(F.col("u").alias("id")).agg(F.sum("weight").alias("mass")),
        "r": pairs.groupBy(F.col("i").alias("id")).agg(F.sum("weight").alias("mass")),
    }
    known = max(ids["l"].count(), ids["r"].count())
    kind = pairs.schema["i" if side == "r" else "u"].dataType.simpleString()
    if not known:
        return pairs.sparkSession.createDataFrame([], f"id {kind}, vec array<float>")
    blocks = blocks_for(known, pairs.count())
    left, right = _index(ids["l"], "l", blocks), _index(ids["r"], "r", blocks)
    noise_total = right.agg(F.sum(F.pow("mass", F.lit(0.75)))).first()[0]
    cells = _cells(pairs, left, right, blocks)
    state = stored = materialise(_first_state(left, right), "blocks")
    sweeps = min(SWEEPS, cfg.iterations) if blocks > 1 else 1
    edges = [round(k * cfg.iterations / sweeps) for k in range(sweeps + 1)]
    for lo, hi in zip(edges, edges[1:]):
        visit = _visit(cfg, range(lo, hi), noise_total)
        for s in range(blocks):
            state = _turn(state, cells, s, blocks, visit)
            if s % CUT_TURNS == CUT_TURNS - 1 or s == blocks - 1:
                state = materialise(state, "blocks")
                discard(stored)
                stored = state
    return _rows_of(state, left if side == "l" else right, side, cfg.factors)


def _rows_of(state: DataFrame, index: DataFrame, side: str, factors: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block, raw in zip(batch["block"].to_pylist(), batch["vec"].to_pylist()):
                vec = np.frombuffer(raw, np.float32).reshape(-1, factors)
                for lo in range(0, len(vec), 4096):
                    part = vec[lo : lo + 4096]
                    ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * factors)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(part), block, np.int32)),
                            pa.array(np.arange(lo, lo + len(part), dtype=np.int32)),
                            pa.ListArray.from_arrays(ends, pa.array(part.ravel())),
                        ],
                        ["block", "row", "vec"],
                    )

    rows = state.where(F.col("side") == side).select("block", "vec").mapInArrow(run, "block int, row int, vec array<float>")
    return rows.join(index.select("id", "block", "row"), ["block", "row"]).select("id", "vec")
