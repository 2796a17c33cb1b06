"""SimHash near-duplicates by multi-index hashing.

1. A text's fingerprint has a bit for each of 64 places, set where more than half
   of its word shingles' XXH64 values have it set. Texts are lower-cased (A-Z only)
   and split at blanks; shingles are ranges of one byte buffer, hashed by numpy.
2. Distinct fingerprints are cut into ``distance // 2 + 1`` segments. Of two
   fingerprints that differ in at most ``distance`` bits, one segment differs in at
   most one (else every segment would add two). So each segment value is entered in
   a table, and each fingerprint looks up the Hamming ball of radius one around its
   own values. Of two values that differ in one bit one has a 0 there: a ball holds
   the value itself and those with one more bit set, and each pair meets once a segment.
3. Matches are verified on the complete fingerprints inside the join, so that only
   links are ever rows, never the candidates of a bucket.
4. Links are closed to components by star contractions; a component is named by the
   least doc_id that it holds.

Fingerprints of 64 bits with segments of 32 stay selective up to billions of texts; a
fingerprint has about 17 lookups a segment. Texts are not shuffled.

Edge cases: a null text is an empty one; a text of 1 or 2 words has one shingle, all its
words; a text without words has fingerprint zero and is linked as any other; repeated rows
are linked by their equal fingerprints; null doc_ids get a component but do not name one
(null if it has no other); an empty table gives an empty table; extra columns are not read.
A text above ``PART_BYTES`` is worked on in parts that overlap by two words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pannier.llm.components import components
from pannier.llm.words import owners, slices, utf8
from pannier.session import materialise

BITS = 64
SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Bytes of one text, and shingles, that are worked on at once.
PART_BYTES = 4_000_000
PART_SHINGLES = 1 << 17

_U = np.uint64
#: The primes of XXH64.
_P1 = _U(0x9E3779B185EBCA87)
_P2 = _U(0xC2B2AE3D27D4EB4F)
_P3 = _U(0x165667B19E3779F9)
_P4 = _U(0x85EBCA77C2B2AE63)
_P5 = _U(0x27D4EB2F165667C5)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of a buffer on, as a number."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray(len(data) + 8, "<u8", padded, strides=(1,)).copy()


def xxh64(data: np.ndarray, eight: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the ranges ``start``, ``size`` of a byte buffer with its ``eights``.

    Ranges below 32 bytes, nearly all shingles, are hashed together; longer ones by xxhash.
    """
    import xxhash

    out = np.uint64(seed) + _P5 + size.astype(np.uint64)
    for step in range(3):
        at = np.flatnonzero((size >= 8 * step + 8) & (size < 32))
        word = _turned(eight[start[at] + 8 * step] * _P2, 31) * _P1
        out[at] = _turned(out[at] ^ word, 27) * _P1 + _P4
    place = start + (size & ~7)
    at = np.flatnonzero((size & 4 > 0) & (size < 32))
    word = eight[place[at]] & _U(0xFFFFFFFF)
    out[at] = _turned(out[at] ^ (word * _P1), 23) * _P2 + _P3
    place = place + (size & 4)
    for step in range(3):
        at = np.flatnonzero((size & 3 > step) & (size < 32))
        out[at] = _turned(out[at] ^ ((eight[place[at] + step] & _U(0xFF)) * _P5), 11) * _P1
    out ^= out >> _U(33)
    out *= _P2
    out ^= out >> _U(29)
    out *= _P3
    out ^= out >> _U(32)
    long = np.flatnonzero(size >= 32)
    if len(long):
        raw = data.tobytes()
        digest = xxhash.xxh64_intdigest
        out[long] = np.fromiter(
            (digest(raw[a : a + n], seed) for a, n in zip(start[long].tolist(), size[long].tolist())),
            np.uint64,
            len(long),
        )
    return out


def spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one blank after each: bytes, start and end of every word, word offsets per text."""
    inside = ~_BLANK[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = ~inside[:-1]
    fresh[at] = True
    start = inside & fresh[:-1]
    begins = np.flatnonzero(start)
    place = np.cumsum(inside) + np.cumsum(start) - 2  # a blank after each word before
    first = place[begins]
    out = np.full(np.count_nonzero(inside) + len(begins), 32, np.uint8)
    out[place[inside]] = _LOWER[data[inside]]
    offsets = np.searchsorted(begins, at)
    ends = np.concatenate([first[1:], [len(out)]])[: len(first)] - 1
    return out, first, ends, offsets


def _counts(data: np.ndarray, at: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per text how many shingles have each bit set, and how many shingles there are."""
    out, first, ends, offsets = spaced(data, at)
    words = np.diff(offsets)
    n = np.maximum(words - SHINGLE + 1, np.minimum(words, 1) if short else 0)
    set_ = np.zeros((len(n), BITS), np.int64)
    edges = np.concatenate([[0], np.cumsum(n)])
    owner = owners(edges)
    begin = np.arange(edges[-1]) - edges[:-1][owner] + offsets[:-1][owner]
    end = np.minimum(begin + SHINGLE, offsets[1:][owner]) - 1
    eight = eights(out)
    for lo in range(0, len(begin), PART_SHINGLES):
        b, e, o = (x[lo : lo + PART_SHINGLES] for x in (begin, end, owner))
        hashes = xxh64(out, eight, first[b], ends[e] - first[b])
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        set_[o[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.uint32)
    return set_, n


def _parts(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut at blanks, that hold each shingle once; a part has more words than the overlap."""
    lo, most = 0, PART_BYTES
    while len(text) - lo > most:
        pieces = text[lo : lo + most].rsplit(None, SHINGLE)
        if len(pieces) <= SHINGLE:  # too few words: look further
            most *= 2
            continue
        # the last word may be cut and begins the overlap's successor
        part = text[lo : lo + most - len(pieces[-1])] if not text[lo + most - 1 : lo + most].isspace() else text[lo : lo + most]
        yield part
        head = part.rsplit(None, SHINGLE - 1)[0]
        lo, most = lo + len(head), PART_BYTES
    yield text[lo:]


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Fingerprints of whole texts."""
    data, at = utf8(texts)
    long = np.flatnonzero(np.diff(at) > PART_BYTES)
    if not len(long):
        set_, n = _counts(data, at, True)
    else:
        sizes = []
        for text in range(len(at) - 1):
            set_t, n_t = np.zeros(BITS, np.int64), 0
            here = data[at[text] : at[text + 1]].tobytes()
            parts = list(_parts(here)) if text in long else [here]
            for part in parts:
                raw = np.frombuffer(part, np.uint8)
                s, c = _counts(raw, np.array([0, len(raw)]), len(parts) == 1)
                set_t, n_t = set_t + s[0], n_t + int(c[0])
            sizes.append((set_t, n_t))
        set_, n = np.array([s for s, _ in sizes]), np.array([c for _, c in sizes])
    bits = (2 * set_ > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = fingerprints(part.column("text")).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _segment(fp: Column, k: int, n: int) -> Column:
    """Value of segment ``k`` of ``n``, from the low end."""
    lo, hi = BITS * k // n, BITS * (k + 1) // n
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < BITS else -1).cast("long"))


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints ``fp`` that differ in at most ``distance`` bits; a pair may come several times."""
    n = distance // 2 + 1
    widths = [BITS * (k + 1) // n - BITS * k // n for k in range(n)]
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("segment"), F.lit(w).alias("width"), _segment(F.col("fp"), k, n).alias("value"))
            for k, w in enumerate(widths)
        ]
    )
    entered = distinct.select("fp", F.explode(entries).alias("e")).select("fp", "e.*")
    table = entered.select("segment", "value", F.col("fp").alias("v"))
    one = F.expr("shiftleft(1L, bit)")
    ball = (
        entered.select("fp", "segment", "value", F.explode(F.expr("sequence(-1, width - 1)")).alias("bit"))
        .where((F.col("bit") < 0) | (F.col("value").bitwiseAND(one) == 0))
        .select(
            "segment",
            F.when(F.col("bit") < 0, F.col("value")).otherwise(F.col("value").bitwiseOR(one)).alias("value"),
            (F.col("bit") < 0).alias("centre"),
            F.col("fp").alias("u"),
        )
    )
    same = (ball["segment"] == table["segment"]) & (ball["value"] == table["value"])
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    once = ~F.col("centre") | (F.col("u") < F.col("v"))
    return ball.join(table, same & near & once).select("u", "v")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Every row with its fingerprint (16 hex digits) and its component: doc_id, fingerprint, component_id."""
    rows = materialise(fingerprinted(docs), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct, distance))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
