"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size: all items of one partition have 2^c to 2^(c+1)-1
distinct shingles. For each partition a document is read in overlapping windows
of four times 2^c shingles, so a window's Jaccard similarity with an item it
holds stays above 0.15 however long the document is; a single MinHash of a whole
long document would be drowned. An item becomes a candidate when any of
``HASHES`` minima of any window equals the item's (one row per band, the tuning
for low thresholds). A shared part that is scattered over many windows is
found as surely, as its shingles are minima somewhere.

Candidates are verified at once: the share of the item's distinct shingles
that the whole document holds, exactly.

Items travel in blocks of bounded bytes (``BLOCK_BYTES``); a larger benchmark is
searched block after block, each block one pass over the documents.

Edge cases: null or word-less texts and items match nothing; an item of fewer
than five words has one shingle of all its words and is searched with shingles
of that length; repeated rows are judged each; an item id that occurs more than
once stands for each of its texts (the largest containment is reported); extra
columns pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pannier.llm.words import mix, owners, shingles, slices, words

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 48
#: Most bytes of item shingles sent to every task at once.
BLOCK_BYTES = 32_000_000


def _minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row per hash function, one column per run of ``values`` that begins at ``starts``."""
    out = np.empty((HASHES, len(starts)), np.uint64)
    for j in range(HASHES):
        out[j] = np.minimum.reduceat(mix(values ^ mix(np.uint64([j + 1]))[0]), starts)
    return out


class Index:
    """Items of one block: their shingle sets, and minima by (shingle length, size class)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        codes, at = words(pa.array([t for _, t in items], pa.string()))
        self.sets: dict[int, np.ndarray] = {}
        parts: dict[tuple[int, int], list[int]] = {}
        for p in range(len(items)):
            own = codes[at[p] : at[p + 1]]
            k = min(SHINGLE, len(own))
            if not k:
                continue
            values = np.unique(shingles(own, np.array([0, len(own)]), k)[0])
            self.sets[p] = values
            parts.setdefault((k, len(values).bit_length() - 1), []).append(p)
        self.parts = {}
        for part, members in parts.items():
            at = np.concatenate([[0], np.cumsum([len(self.sets[p]) for p in members])])
            lows = _minima(np.concatenate([self.sets[p] for p in members]), at[:-1])
            order = np.argsort(lows, axis=1, kind="stable")
            self.parts[part] = (np.array(members), np.take_along_axis(lows, order, 1), order)


def _windows(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of half windows over all texts, and the text of each."""
    counts = -(-np.diff(at) // size)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return at[:-1][owner] + (np.arange(len(owner)) - first[owner]) * size, owner


def search(texts: pa.Array, index: Index, threshold: float) -> list[tuple[int, int, int, int]]:
    """(text number, item id, shared shingles, item shingles) of verified containments."""
    codes, word_at = words(texts)
    out = []
    for k in sorted({k for k, _ in index.parts}):
        values, at = shingles(codes, word_at, k, short=False)
        if not len(values):
            continue
        found: set[tuple[int, int]] = set()
        sizes = sorted(c for kk, c in index.parts if kk == k)
        # minima over the smallest pieces once; larger pieces join whole numbers of them
        base = 2 << sizes[0]
        starts, owner = _windows(at, base)
        pieces = _minima(values, starts)
        first = np.searchsorted(owner, np.arange(len(at) - 1))
        inside = np.arange(len(owner)) - first[owner]
        for c in sizes:
            step = (2 << c) // base
            head = np.flatnonzero(inside % step == 0)
            half = np.minimum.reduceat(pieces, head, axis=1) if step > 1 else pieces
            doc = owner[head]
            joined = half.copy()
            same = doc[1:] == doc[:-1]
            joined[:, :-1][:, same] = np.minimum(half[:, :-1], half[:, 1:])[:, same]
            members, lows, order = index.parts[(k, c)]
            for j in range(HASHES):
                lo = np.searchsorted(lows[j], joined[j], "left")
                hi = np.searchsorted(lows[j], joined[j], "right")
                for w in np.flatnonzero(hi > lo):
                    found.update((int(doc[w]), int(members[order[j][i]])) for i in range(lo[w], hi[w]))
        by_doc: dict[int, list[int]] = {}
        for d, p in found:
            by_doc.setdefault(d, []).append(p)
        for d in sorted(by_doc):
            own = np.unique(values[at[d] : at[d + 1]])
            for p in sorted(by_doc[d]):
                want = index.sets[p]
                spot = np.minimum(np.searchsorted(own, want), len(own) - 1)
                shared = int((own[spot] == want).sum())
                if shared >= threshold * len(want) - 1e-9:
                    out.append((d, index.ids[p], shared, len(want)))
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``BLOCK_BYTES`` of shingles, fetched one block at a time."""
    rows = items.select("item_id", "text").where("text is not null").distinct()
    total = rows.agg(F.sum(F.length("text") * 8)).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    for b in range(n):
        mine = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        block = [(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()]
        if block:
            yield block


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) for every item that a document holds."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, shared long, item_shingles long"
    parts = []
    for block in _blocks(items):
        data = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], data=data) -> Iterator[pa.RecordBatch]:
            index = Index(data.value)
            for batch in batches:
                for part in slices(batch, "text"):
                    hits = search(part.column("text"), index, threshold)
                    doc = part.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64()))
                    rest = [pa.array([h[i] for h in hits]) for i in (1, 2, 3)]
                    if hits:
                        yield pa.RecordBatch.from_arrays(
                            [doc, *rest], ["doc_id", "item_id", "shared", "item_shingles"]
                        )

        parts.append(docs.select("doc_id", "text").mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema).withColumn("containment", F.lit(0.0))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return (
        found.withColumn("containment", F.col("shared") / F.col("item_shingles"))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("containment", "shared", "item_shingles")).alias("b"))
        .select("doc_id", "item_id", "b.shared", "b.item_shingles", "b.containment")
    )


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, all columns as they came.

    Decided while the text is read, so no document is shuffled: the search marks
    rows in the scan. With several item blocks the passes follow each other.
    """
    spark = docs.sparkSession
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs
    for block in _blocks(items):
        data = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], data=data) -> Iterator[pa.RecordBatch]:
            index = Index(data.value)
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[h[0] for h in search(part.column("text"), index, threshold)]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(run, fields)
    return out
