"""Implicit alternating least squares, block by block.

Users and items are numbered from 0 and dealt to blocks by number. A half step is
one shuffle: a block of one side sends each block of the other the vectors that its
ratings name, once each, and its share of the Gram matrix; the receiver solves for
all its rows and sends on. Only item vectors are stored, once an iteration.

A row with ``n`` ratings solves ``(G + reg n I + alpha Y'Y) x = (1 + alpha) Y'1``.
Rows of equal ``n`` share ``A = G + reg n I``, so with ``A`` inverted once a row of few
ratings is left with a system of ``n`` unknowns: ``x = (1 + alpha) A^-1 Y' (I + alpha Y A^-1 Y')^-1 1``.
The equations are those of Spark's ALS, in double precision as there; vectors are kept in single.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pannier.session import discard, materialise

#: Ratings that a block has at most on average, and blocks that are made for the cores' sake, of so many ratings at least.
BLOCK_RATINGS = 1 << 19
EVEN_BLOCKS = 48
FEW_RATINGS = 1 << 15
#: A shared matrix of a larger condition number is not inverted.
CONDITION = 1e9
#: Ratings whose vectors are widened at once inside a task.
TILE = 1 << 14
_SENT = "dest int, src int, vec binary, gram binary"


def blocks_for(ratings: int) -> int:
    return max(math.ceil(ratings / BLOCK_RATINGS), min(math.ceil(ratings / FEW_RATINGS), EVEN_BLOCKS), 1)


def solve(own: np.ndarray, y: np.ndarray, rows: int, gram: np.ndarray, alpha: float, reg: float) -> np.ndarray:
    """Vectors of ``rows`` rows from the vectors ``y`` of their ratings; ``own`` is a rating's row.

    A row without ratings is not a number.
    """
    f = len(gram)
    out = np.full((rows, f), np.nan, np.float32)
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=rows)
    starts = np.cumsum(counts) - counts
    for n in np.unique(counts[counts > 0]):
        at, base = np.flatnonzero(counts == n), gram + reg * n * np.eye(f)
        few = n <= f and np.linalg.cond(base) < CONDITION
        inverse = np.linalg.inv(base) if few else None
        step = max(1, TILE // n)
        for lo in range(0, len(at), step):
            mine = at[lo : lo + step]
            if few:
                part = y[order[starts[mine][:, None] + np.arange(n)]].astype(np.float64)
                z = (part.reshape(-1, f) @ inverse).reshape(part.shape)
                left = alpha * (z @ part.transpose(0, 2, 1)) + np.eye(n)
                c = np.linalg.solve(left, np.ones((len(mine), n, 1)))
                out[mine] = (1 + alpha) * (c.transpose(0, 2, 1) @ z)[:, 0]
                continue
            for row in mine:
                left, right = base.copy(), np.zeros(f)
                for k in range(starts[row], starts[row] + n, TILE):
                    part = y[order[k : min(k + TILE, starts[row] + n)]].astype(np.float64)
                    left += alpha * (part.T @ part)
                    right += part.sum(axis=0)
                out[row] = np.linalg.solve(left, (1 + alpha) * right)
    return out


def _block(number: int, blocks: int, factors: int, alpha: float, reg: float, send: bool):
    """A task's half step: a block's vectors from what it was sent, sent on or returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        here = table["dest"][0].as_py()
        rows = (number - here + blocks - 1) // blocks
        kind = table["kind"].to_numpy()
        src = table["src"].to_numpy(zero_copy_only=False)

        def of(what: str) -> list[int]:
            at = np.flatnonzero(kind == what)
            return list(at[np.argsort(src[at], kind="stable")])

        def ints(column: str, k: int) -> np.ndarray:
            return table[column][k].values.to_numpy()

        def floats(column: str, k: int, form=np.float32) -> np.ndarray:
            return np.frombuffer(table[column][k].as_buffer(), form)

        cells = {int(src[k]): k for k in of("cell")}
        sent, given = of("sent"), table.filter(pa.compute.equal(table["kind"], "row"))
        if sent:
            gram, own, y = np.zeros((factors, factors)), [np.empty(0, np.int32)], [np.empty((0, factors), np.float32)]
            for k in sent:
                gram += floats("gram", k, np.float64).reshape(factors, factors)
                if int(src[k]) in cells:
                    cell = cells[int(src[k])]
                    own.append(ints("own", cell))
                    y.append(floats("vec", k).reshape(-1, factors)[np.unique(ints("other", cell), return_inverse=True)[1]])
            x = solve(np.concatenate(own), np.concatenate(y), rows, gram, alpha, reg)
        elif len(given):
            x = np.full((rows, factors), np.nan, np.float32)
            x[given["row"].to_numpy()] = given["features"].combine_chunks().flatten().to_numpy().reshape(-1, factors)
        elif state := of("state"):
            x = floats("vec", state[0]).reshape(rows, factors)
        else:
            return
        if not send:
            yield pa.RecordBatch.from_pylist([{"dest": here, "vec": x.tobytes()}], schema=sent_schema)
            return
        known = x[~np.isnan(x[:, 0])].astype(np.float64)
        gram = (known.T @ known).tobytes()
        for dest in range(blocks):
            need = np.unique(ints("own", cells[dest])) if dest in cells else np.empty(0, np.int32)
            yield pa.RecordBatch.from_pylist(
                [{"dest": dest, "src": here, "vec": x[need].tobytes(), "gram": gram}], schema=sent_schema
            )

    sent_schema = pa.schema([("dest", pa.int32()), ("src", pa.int32()), ("vec", pa.binary()), ("gram", pa.binary())])
    return run


def item_factors(ratings: DataFrame, first: DataFrame, users: int, items: int, cfg) -> DataFrame:
    """(id, features) of the items of ``ratings(user, item)`` after ``cfg.iterations`` rounds from users' vectors ``first``."""
    ratings = materialise(ratings.select("user", "item"), "als_ratings")
    n = blocks_for(ratings.count())

    def at(column: str):
        return F.pmod(F.col(column), F.lit(n)), F.floor(F.col(column) / n).cast("int")

    (lb, left), (rb, right) = at("user"), at("item")
    cells = materialise(
        ratings.groupBy(lb.alias("lb"), rb.alias("rb"))
        .agg(F.sort_array(F.collect_list(F.struct(left.alias("l"), right.alias("r")))).alias("p"))
        .select("lb", "rb", F.col("p.l").alias("l"), F.col("p.r").alias("r")),
        "als_cells",
    )

    def side(dest: str, src: str, own: str, other: str) -> DataFrame:
        return cells.select(
            F.lit("cell").alias("kind"),
            F.col(dest).alias("dest"),
            F.col(src).alias("src"),
            F.col(own).alias("own"),
            F.col(other).alias("other"),
        )

    by_user, by_item = side("lb", "rb", "l", "r"), side("rb", "lb", "r", "l")

    def half(known: DataFrame, kind: str, cells: DataFrame, number: int, send: bool) -> DataFrame:
        all_columns = "kind string, dest int, src int, own array<int>, other array<int>, vec binary, gram binary, row int, features array<float>"
        empty = cells.sparkSession.createDataFrame([], all_columns)
        dealt = (
            empty.unionByName(cells, allowMissingColumns=True)
            .unionByName(known.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
            .repartitionById(n, F.col("dest"))
        )
        return dealt.mapInArrow(_block(number, n, cfg.factors, cfg.alpha, cfg.regularization, send), _SENT)

    block, row = at("id")
    start = first.select(block.alias("dest"), row.alias("row"), "features")
    state = stored = None
    for _ in range(cfg.iterations):
        if state is None:
            to_items = half(start, "row", by_user, users, True)
        else:
            to_users = half(state, "state", by_item, items, True)
            to_items = half(to_users, "sent", by_user, users, True)
        state = materialise(half(to_items, "sent", by_item, items, False), "als_state")
        if stored is not None:
            discard(stored)
        stored = state
    factors = cfg.factors

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for here, raw in zip(batch["dest"].to_pylist(), batch["vec"]):
                x = np.frombuffer(raw.as_buffer(), np.float32).reshape(-1, factors)
                known = np.flatnonzero(~np.isnan(x[:, 0]))
                for lo in range(0, len(known), 4096):
                    part = known[lo : lo + 4096]
                    ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * factors)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((part * n + here).astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(x[part].ravel()))],
                        ["id", "features"],
                    )

    return state.select("dest", "vec").mapInArrow(rows_of, "id int, features array<float>")
