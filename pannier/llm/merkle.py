"""Merkle manifest of a dataset: every row a leaf, every leaf with its witness.

A witness is what a reader needs to recompute the root from a leaf: per level the
sibling's digest and its side. Witnesses are built by streaming append:

1. Leaves of a group (language) are placed in order and cut into aligned blocks
   of ``BLOCK`` places. A task appends a block's leaves one after the other to an
   ``Appender``, whose state is the open subtrees, at most one per height. When
   two open subtrees of one height meet they complete each other's sibling: the
   partial witnesses of both sides get the other's digest, and one subtree of the
   next height stays open. What is open at the end closes from right to left.
2. The roots of the blocks are further appends: they are the leaves of the next
   round, in blocks of ``BLOCK`` again, until a group has one root. A group of n
   leaves takes log n / log ``BLOCK`` rounds, each over a table ``BLOCK`` times smaller.
3. Group roots are appended in the same way, in the order of their names.
4. Witnesses of a round are extended by those of their block's root, from the top
   down; a leaf's row meets its block's witness in a join by (group, block).

No task holds more than one block, whatever share of the rows a group has.

A digest is SHA-256 of its inputs' concatenation, inner digests as hex text. Where
a level has an odd last node, that node alone is hashed.

Edge cases: a null column is ``-`` in its leaf, also a null doc_id, which comes
first; a null lang is a group of its own, before all others (also the empty name);
rows of one doc_id follow by their leaf digest; repeated rows are separate leaves;
an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pannier.session import materialise

#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels and leaves of a block.
LEVELS = 10
BLOCK = 1 << LEVELS
#: Sides of a witness: the sibling follows, precedes, or there is none.
AFTER, BEFORE, ALONE = b"R", b"L", b"-"


def digest(*parts: bytes) -> bytes:
    """SHA-256 over the hex text of digests, or over a leaf's text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def fold(leaf: bytes, sides: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and its witness give."""
    at = 0
    for side in sides:
        if side == ALONE[0]:
            leaf = digest(leaf)
            continue
        other = siblings[at : at + 32]
        at += 32
        leaf = digest(leaf, other) if side == AFTER[0] else digest(other, leaf)
    return leaf


class Appender:
    """Append-only tree: open subtrees from left to right, and the witnesses below them."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, int, int]] = []  # height, digest, first leaf, end
        self.sides: list[bytearray] = []
        self.siblings: list[bytearray] = []

    def append(self, leaf: bytes) -> None:
        n = len(self.sides)
        self.sides.append(bytearray())
        self.siblings.append(bytearray())
        self.open.append((0, leaf, n, n + 1))
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._complete()

    def _extend(self, first: int, end: int, side: bytes, sibling: bytes) -> None:
        for k in range(first, end):
            self.sides[k] += side
            self.siblings[k] += sibling

    def _complete(self) -> None:
        """Two subtrees of one height become one."""
        height, right, mid, end = self.open.pop()
        _, left, first, _ = self.open.pop()
        self._extend(first, mid, AFTER, right)
        self._extend(mid, end, BEFORE, left)
        self.open.append((height + 1, digest(left, right), first, end))

    def _raise(self) -> None:
        """The last subtree goes up a level without a sibling."""
        height, node, first, end = self.open.pop()
        self._extend(first, end, ALONE, b"")
        self.open.append((height + 1, digest(node), first, end))

    def close(self, height: int = 0) -> bytes:
        """Complete all that is open, up to ``height`` at least; the root."""
        while len(self.open) > 1:
            if self.open[-1][0] == self.open[-2][0]:
                self._complete()
            else:
                self._raise()
        while self.open[0][0] < height:
            self._raise()
        return self.open[0][1]


def leaf_digest(n_chars: Column | None = None) -> Column:
    """Hex digest of a row's fields; ``n_chars`` in place of the column."""
    parts = []
    for name in FIELDS:
        value = F.col(name).cast("string") if name != "n_chars" or n_chars is None else n_chars.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def group_of(lang: str = "lang") -> Column:
    """A group's name, in the order of the languages: null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit(""))


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    """``pos`` of every row of ``df(g, ...)`` in its group, and the row's ``block``.

    Rows are dealt by ranges of (g, order), so that a hot group spans many tasks;
    a task counts its own rows, and a running sum over one short row per task and
    group gives the rows ahead.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            here = []
            for g in batch.column("g").to_pylist():
                n = n + 1 if g == last else 0
                last = g
                here.append(n)
            columns = [pa.array(here, pa.int64()), pa.array([part] * len(here), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "here", "part"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    rows = (
        df.repartitionByRange(parts, "g", *order)
        .sortWithinPartitions("g", *order)
        .mapInArrow(count, f"{schema}, here long, part long")
    )
    rows = materialise(rows, "placed")
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("g", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    placed = rows.join(ahead, ["g", "part"]).withColumn("pos", F.col("ahead") + F.col("here"))
    return placed.drop("here", "part", "ahead").withColumn("block", F.shiftright("pos", LEVELS))


def _appended(placed: DataFrame) -> DataFrame:
    """One round: every row with its partial ``sides`` and ``siblings``, and a row per block with its ``root``.

    ``placed`` has g, pos, block, node and other columns, which rows keep and block
    rows have as nulls. The columns ``root`` (null but in a block's row) tells them apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, rows, key, kind = Appender(), [], None, None

        def done() -> pa.RecordBatch:
            # only a group's single block may be lower than a full one
            root = tree.close(LEVELS if key[1] else 0)
            block = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            n = block.num_rows
            extra = pa.RecordBatch.from_arrays(
                [
                    pa.array([{"g": key[0], "block": key[1]}.get(f.name)], f.type)
                    for f in kind
                ],
                schema=kind,
            )
            both = pa.Table.from_batches([block, extra]).combine_chunks().to_batches()[0]
            columns = [
                pa.array([*map(bytes, tree.sides), None], pa.binary()),
                pa.array([*map(bytes, tree.siblings), None], pa.binary()),
                pa.array([None] * n + [root], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays([*both.columns, *columns], [*kind.names, "sides", "siblings", "root"])

        for batch in batches:
            kind = pa.schema([f.with_nullable(True) for f in batch.schema])
            batch = pa.RecordBatch.from_arrays(batch.columns, schema=kind)
            groups, blocks = batch.column("g").to_pylist(), batch.column("block").to_pylist()
            nodes, begin = batch.column("node").to_pylist(), 0
            for k, now in enumerate(zip(groups, blocks)):
                if now != key and key is not None:
                    if k > begin:
                        rows.append(batch.slice(begin, k - begin))
                    yield done()
                    tree, rows, begin = Appender(), [], k
                key = now
                tree.append(nodes[k])
            if batch.num_rows > begin:
                rows.append(batch.slice(begin))
        if key is not None:
            yield done()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    dealt = placed.repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    done = dealt.mapInArrow(run, f"{schema}, sides binary, siblings binary, root binary")
    return materialise(done, "appended")


def _rounds(placed: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rows of every round with their partial witnesses, and (g, node) of every group's root."""
    rounds = []
    while True:
        both = _appended(placed)
        rounds.append(both.where("root is null").drop("root"))
        roots = both.where("root is not null").select("g", F.col("block").alias("pos"), F.col("root").alias("node"))
        last = roots.agg(F.max("pos")).first()[0]
        if not last:  # every group has one root, or there is none
            return rounds, roots.select("g", "node")
        placed = roots.withColumn("block", F.shiftright("pos", LEVELS))


def _extended(rows: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose witnesses go on with those of ``above``."""
    upper = above.withColumnsRenamed({"sides": "up_sides", "siblings": "up_siblings"})
    return (
        rows.join(upper, on)
        .withColumn("sides", F.concat("sides", "up_sides"))
        .withColumn("siblings", F.concat("siblings", "up_siblings"))
        .drop("up_sides", "up_siblings")
    )


def _down(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """Rows of the lowest round with whole witnesses; ``top`` has those of the group roots, by g."""
    above, on = top, ["g"]
    for rows in reversed(rounds[1:]):
        above = _extended(rows.drop("node"), above, on)
        above = materialise(above.drop("block").withColumnRenamed("pos", "block"), "witnesses")
        on = ["g", "block"]
    return _extended(rounds[0], above, on)


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """Every row's leaf and witness: doc_id, lang's group g, leaf, sides, siblings, subroot, root (binary).

    ``changed`` is another leaf (hex) to carry along as ``other``; the tree is that of the true leaves.
    """
    other = F.unhex(changed) if changed is not None else F.lit(None).cast("binary")
    leaves = materialise(
        docs.select(
            group_of().alias("g"),
            "doc_id",
            F.unhex(leaf_digest()).alias("node"),
            other.alias("other"),
            F.monotonically_increasing_id().alias("tie"),  # deals repeated rows to several tasks
        ),
        "leaves",
    )
    rounds, roots = _rounds(_placed(leaves, ["doc_id", "node", "tie"]).drop("tie"))
    named = roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "node")
    top_rounds, root = _rounds(_placed(named, ["name"]))
    none = root.select("g", F.lit(b"").alias("sides"), F.lit(b"").alias("siblings"), F.col("node").alias("root"))
    top = _down(top_rounds, none).select(
        F.col("name").alias("g"), F.col("node").alias("subroot"), "sides", "siblings", "root"
    )
    whole = _down(rounds, materialise(top, "witnesses"))
    return whole.select("doc_id", "g", F.col("node").alias("leaf"), "other", "sides", "siblings", "subroot", "root")


def audited(docs: DataFrame) -> DataFrame:
    """Every row checked against the root, some after tampering with their n_chars.

    doc_id, leaf, subroot, root, proof_sha256, folded_root (hex) and verified. Rows
    whose CRC32 of the decimal doc_id is divisible by 7 are read with n_chars one
    higher; a null doc_id or n_chars stays as it is.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    found = manifest(docs, F.when(hit, leaf_digest(more)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, other, sides, siblings, root = (
                batch.column(c).to_pylist() for c in ("leaf", "other", "sides", "siblings", "root")
            )
            folded = [fold(o or x, s, w) for x, o, s, w in zip(leaf, other, sides, siblings)]
            text = lambda name: pa.array([x.hex() for x in batch.column(name).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    text("leaf"),
                    text("subroot"),
                    text("root"),
                    pa.array([hashlib.sha256(w.hex().encode()).hexdigest() for w in siblings], pa.string()),
                    pa.array([f.hex() for f in folded], pa.string()),
                    pa.array([f == r for f, r in zip(folded, root)], pa.bool_()),
                ],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(
        run,
        f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )
