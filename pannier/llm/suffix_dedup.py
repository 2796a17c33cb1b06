"""Suffix-array dedup: removes every byte inside a string of ``LENGTH`` bytes that starts elsewhere too.

1. Windows are dealt by content. The key of a window is the least hash of the 32-byte
   strings in it, so equal windows, and only they need to meet, have equal keys. Successive
   windows of one key form a segment (at most 169 windows), which is a row of two hashes.
2. Segments whose key occurs once hold no repeat and go. A segment whose whole content
   occurs twice is repeated throughout; copies, however many, combine before the shuffle.
3. What is left, the different segments of a shared key, is compared by suffix order. A
   task takes whole keys, cuts their segments into shards, builds each shard's
   Burrows-Wheeler transform, and merges the transforms by interleave refinement: the suffixes
   of all shards, in order by their first h bytes, are carried to h + 1 by
   one stable distribution of the transforms' symbols (the last-to-first step of each
   shard), and a boundary between two neighbours appears in the round that is
   their common prefix. Suffixes alone between boundaries can meet nobody any more and
   leave. After ``LENGTH`` rounds the intervals that remain are the repeated strings; no suffix
   is sorted again.
4. A key with more than ``MERGED`` different segments (a common line in many surroundings) is
   dealt once more, by the 178 bytes that the windows of a piece have in common. Pieces
   are counted and compared like segments. Where even those have more than ``MERGED`` kinds, single
   windows are counted by a 128-bit hash: exact as well, and without a hot task.
5. Covered windows become byte spans of documents.

Edge cases: a null text is an empty one; texts below ``LENGTH`` bytes lose nothing; a document of
which every byte is covered keeps the empty string; repeated rows are copies of each
other; a repeat inside one document counts, its occurrences may overlap; matches never
cross documents; an empty table gives an empty one; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pannier.llm.words import mix, slices, utf8
from pannier.session import materialise

LENGTH = 200
GRAM = 32
#: Different segments of one key that a task compares by suffix order.
MERGED = 1024
#: Windows of one piece of a key with more of them.
STRIDE = 23
#: Bytes of one shard, and of the segments merged at once.
SHARD_BYTES = 128_000
CHUNK_BYTES = 512_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA24BAED4963EE407))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _gram_hashes(values: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place, by doubling."""
    h, width, factor = values, 1, _BASE
    while width < GRAM:
        h = h[: len(h) - width] * _U(factor) + h[width:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        width *= 2
    return mix(h)


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    low, span = h, 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    shift = width - span
    return np.minimum(low[: len(low) - shift], low[shift:]) if shift else low


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, start in the text, windows, key, content hash) of every segment.

    A segment also ends behind the place of its least string, so the windows of one
    segment stand at different distances from it and none equals another.
    """
    empty = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty, empty
    values = _table()[data]
    h = _gram_hashes(values)
    low = _window_min(h, LENGTH - GRAM + 1)
    n = np.maximum(np.diff(at) - LENGTH + 1, 0)
    ok = np.zeros(len(low) + 1, np.int8)
    np.add.at(ok, at[:-1][n > 0], 1)
    np.add.at(ok, (at[:-1] + n)[n > 0], -1)
    inside = np.cumsum(ok)[: len(low)] > 0
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1])
    fresh[at[:-1][n > 0]] = True
    fresh[1:] |= ~inside[:-1]
    starts = np.flatnonzero(fresh & inside)
    stops = np.flatnonzero(fresh | ~inside)
    following = np.searchsorted(stops, starts, "right")
    ends = np.append(stops, len(low))[following]
    count = ends - starts
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, len(values)), dtype=np.uint64)])
    back = _powers(_INVERSE, len(values))
    content = (sums[ends + LENGTH - 1] - sums[starts]) * back[starts]
    content = mix(content ^ mix(count.astype(np.uint64)))
    text = np.searchsorted(at, starts, "right") - 1
    return text, starts - at[text], count, low[starts].view(np.int64), content.view(np.int64)


def _segment_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = utf8(part.column("text"))
                text, start, count, key, content = segments(data, at)
                pick = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pick),
                        part.column("tag").take(pick),
                        pa.array(start.astype(np.int64)),
                        pa.array(count.astype(np.int32)),
                        pa.array(key),
                        pa.array(content),
                    ],
                    ["doc_id", "tag", "start", "windows", "key", "content"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, tag long, start long, windows int, key long, content long")


# ---- suffix order of a few segments -------------------------------------------------------


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a shard: (symbol before each suffix, its place, last-to-first).

    Suffixes of all strings, each ended by a mark of its own below every byte; symbol 0
    stands for "begins its string". Prefix doubling over ranks.
    """
    sizes = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(sizes) - 1
    n = int(sizes.sum())
    text = np.zeros(n, np.int64)
    body = np.ones(n, bool)
    body[ends] = False
    text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + len(strings)
    text[ends] = np.arange(len(strings))
    bits = int(text.max(initial=1)).bit_length()
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(width):  # as many symbols as fit, then doubling
        key <<= bits
        key[: n - j] |= text[j:] if j < n else 0
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if rank[order[-1]] == n - 1:
            break
        key = rank * np.int64(n + 1)
        if width < n:
            key[: n - width] += rank[width:] + 1
        width *= 2
    before = np.where(order > 0, text[order - 1], 0)
    first = np.zeros(n, bool)
    first[np.concatenate([[0], ends[:-1] + 1])] = True
    symbol = np.where(first[order], 0, before - len(strings) + 1).astype(np.uint8)  # no byte of UTF-8 is 255
    return symbol, order.astype(np.int32), rank[np.maximum(order - 1, 0)].astype(np.int32)


def repeated_windows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(string number, place) of every ``LENGTH``-byte window that occurs more than once."""
    shards: list[list[bytes]] = [[]]
    size = 0
    for s in strings:
        if size > SHARD_BYTES:
            shards.append([])
            size = 0
        shards[-1].append(s)
        size += len(s)
    symbols, places, steps, base = [], [], [], np.int32(0)
    for shard in shards:
        symbol, place, step = transform(shard)
        symbols.append(symbol)
        places.append(place + base)
        steps.append(step + base)
        base += np.int32(len(symbol))
    symbol, place, step = map(np.concatenate, (symbols, places, steps))
    starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])])
    inside = place - starts[np.searchsorted(starts, place, "right") - 1]
    # by their first 0 bytes all suffixes form one interval; those with fewer than
    # LENGTH bytes before them begin no window and take no part
    at = np.flatnonzero(inside >= LENGTH).astype(np.int32)
    group = np.zeros(len(at), np.int32)
    for _ in range(LENGTH):
        if not len(at):
            break
        before = symbol[at]
        order = np.argsort(before, kind="stable")
        at, group, before = step[at[order]], group[order], before[order]
        edge = np.ones(len(at) + 1, bool)
        edge[1:-1] = (before[1:] != before[:-1]) | (group[1:] != group[:-1])
        shared = ~(edge[:-1] & edge[1:])
        group = np.cumsum(edge[:-1], dtype=np.int32)
        if not shared.all():
            at, group = at[shared], group[shared]
    found = np.sort(place[at])
    owner = np.searchsorted(starts, found, "right") - 1
    return owner, found - starts[owner]


def _runs(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Successive places of one owner as (owner, first, behind the last)."""
    if not len(owner):
        return owner, place, place
    cut = np.flatnonzero((owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(owner)]])
    return owner[lo], place[lo], place[hi - 1] + 1


_COVER = "key long, content long, low int, high int"


def _cover_batch(keys, contents, low, high) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(contents, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32())],
        ["key", "content", "low", "high"],
    )


def _merged(texts: DataFrame) -> DataFrame:
    """Covered windows (low <= window < high) of segments, whole keys per task, in chunks."""

    def work(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        owner, place = repeated_windows([r[2] for r in rows])
        who, low, high = _runs(owner, place)
        return _cover_batch([rows[i][0] for i in who], [rows[i][1] for i in who], low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "content", "bytes")]):
                if size > CHUNK_BYTES and row[0] != held[-1][0]:
                    yield work(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield work(held)

    return texts.repartition("key").sortWithinPartitions("key", "content").mapInArrow(run, _COVER)


def _counted(texts: DataFrame) -> DataFrame:
    """The same for keys with very many segments: each window by its hash, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content, data in zip(*[batch.column(c).to_pylist() for c in ("key", "content", "bytes")]):
                n = len(data) - LENGTH + 1
                each = [hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * n, pa.int64()), pa.array([content] * n, pa.int64()),
                        pa.array(range(n), pa.int32()), pa.array(each, pa.binary()),
                    ],
                    ["key", "content", "low", "digest"],
                )

    windows = texts.mapInArrow(run, "key long, content long, low int, digest binary")
    windows = materialise(windows, "windows")
    twice = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    return windows.join(twice, "digest").select("key", "content", "low", (F.col("low") + 1).alias("high"))


def _pieces(texts: DataFrame) -> DataFrame:
    """Segments of hot keys cut in pieces of at most ``STRIDE`` windows.

    Pieces are aligned to the key's string, so equal windows lie in pieces of equal number,
    and all windows of a piece hold the same ``LENGTH - STRIDE + 1`` bytes; their hash is
    the piece's key. Only windows that agree in that much meet again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, content, data in zip(*[batch.column(c).to_pylist() for c in ("key", "content", "bytes")]):
                last = len(data) - LENGTH
                h = _gram_hashes(_table()[np.frombuffer(data, np.uint8)])
                place = last + int(np.argmin(h[last : last + LENGTH - GRAM + 1]))
                for b in range((place - last) // STRIDE, place // STRIDE + 1):
                    low, high = max(0, place - STRIDE * b - STRIDE + 1), min(last, place - STRIDE * b)
                    core = place - STRIDE * b
                    name = data[core : core - STRIDE + 1 + LENGTH] + key.to_bytes(8, "big", signed=True) + bytes([b])
                    piece = data[low : high + LENGTH]
                    out.append((key, content, low, high - low + 1, _hash(name), _hash(piece), piece))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["of_key", "of_content", "shift", "windows", "key", "content", "bytes"],
            )

    return texts.mapInArrow(
        run,
        "of_key long, of_content long, shift int, windows int, key long, content long, bytes binary",
    )


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def _split_again(texts: DataFrame) -> DataFrame:
    """Covered windows of hot keys: pieces take the way of segments once more."""
    pieces = materialise(_pieces(texts), "pieces")
    shared = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    live = pieces.join(shared, "key")
    kinds = materialise(
        live.groupBy("key", "content").agg(
            F.count(F.lit(1)).alias("n"), F.first("windows").alias("windows"), F.first("bytes").alias("bytes")
        ),
        "kinds",
    )
    many = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    left = kinds.join(many, "key")
    found = _merged(left.where(F.col("kinds") <= MERGED)).unionByName(_counted(left.where(F.col("kinds") > MERGED)))
    ranges = _ranges(kinds, found)
    return pieces.join(ranges, ["key", "content"]).select(
        F.col("of_key").alias("key"),
        F.col("of_content").alias("content"),
        (F.col("shift") + F.col("low")).alias("low"),
        (F.col("shift") + F.col("high")).alias("high"),
    )


def _ranges(kinds: DataFrame, found: DataFrame) -> DataFrame:
    """All windows of content that occurs twice, else the windows found."""
    twice = kinds.where("n > 1")
    whole = twice.select("key", "content", F.lit(0).alias("low"), F.col("windows").alias("high"))
    parts = found.join(twice.select("key", "content"), ["key", "content"], "left_anti")
    return whole.unionByName(parts.select("key", "content", "low", "high"))


def covers(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, spans): covered byte spans of each document that has any, as (start, end).

    ``docs`` has doc_id, tag (a hash of the text, which tells rows of one id apart) and text.
    """
    rows = materialise(_segment_rows(docs), "segments")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    live = materialise(rows.join(shared, "key"), "live")
    kinds = materialise(
        live.groupBy("key", "content").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("windows").alias("windows"),
            F.min(F.struct("doc_id", "tag", "start")).alias("at"),
        ),
        "kinds",
    )
    many = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    asked = (
        kinds.join(many, "key")
        .select("key", "content", "windows", "kinds", "at.doc_id", "at.tag", "at.start")
        .groupBy("doc_id", "tag")
        .agg(F.collect_list(F.struct("start", "windows", "key", "content", "kinds")).alias("asked"))
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
                data = (text or "").encode()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["key"] for w in wanted], pa.int64()),
                        pa.array([w["content"] for w in wanted], pa.int64()),
                        pa.array([w["kinds"] for w in wanted], pa.int64()),
                        pa.array([data[w["start"] : w["start"] + w["windows"] + LENGTH - 1] for w in wanted], pa.binary()),
                    ],
                    ["key", "content", "kinds", "bytes"],
                )

    named = asked.withColumnsRenamed({"doc_id": "a_id", "tag": "a_tag"})
    texts = materialise(
        docs.join(named, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("tag") == F.col("a_tag")))
        .select("text", "asked")
        .mapInArrow(fetch, "key long, content long, kinds long, bytes binary"),
        "texts",
    )
    found = _merged(texts.where(F.col("kinds") <= MERGED))
    found = found.unionByName(_split_again(texts.where(F.col("kinds") > MERGED)))
    ranges = materialise(_ranges(kinds, found), "ranges")
    return (
        live.join(ranges, ["key", "content"])
        .select(
            "doc_id", "tag",
            F.struct((F.col("start") + F.col("low")).alias("a"), (F.col("start") + F.col("high") + (LENGTH - 1)).alias("b")).alias("s"),
        )
        .groupBy("doc_id", "tag")
        .agg(F.collect_list("s").alias("spans"))
    )


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def deduplicated(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes kept."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("tag"), text.alias("text"))
    named = covers(rows).withColumnsRenamed({"doc_id": "c_id", "tag": "c_tag"})
    joined = rows.join(named, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tag") == F.col("c_tag")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data, gone, at, kept = text.encode(), 0, 0, []
                spans = _union(spans or [])
                for a, b in spans:
                    kept.append(data[at:a])
                    gone += b - a
                    at = b
                left = b"".join([*kept, data[at:]])
                out.append((len(data), gone, len(spans), hashlib.sha256(left).hexdigest(), left if keep_text else None))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = joined.select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return out if keep_text else out.drop("kept")
