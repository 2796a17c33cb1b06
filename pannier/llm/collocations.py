"""Phrase collocations: frequent phrases of 2 to 5 words that hold together, per language.

1. Words' bytes, lower-cased (A-Z), get Rabin-Karp fingerprints from prefix polynomials
   modulo 2**64: with P the running sum of value x base**place, a range's fingerprint is
   (P[end] - P[start]) / base**start. The same over the words' fingerprints gives every
   n-gram's, mixed with its length and language. All of it is numpy over flat arrays.
2. In two levels - words and pairs, then 3 to ``LONGEST`` words - tasks count fingerprints
   of their texts and the shuffle sums them. Those seen ``least`` times enter a filter of
   ``FILTER_BITS`` bits; the second level counts only n-grams whose pairs are all in it,
   since a phrase is never more frequent than its parts. The filter is the one thing
   broadcast and has that fixed size: a fuller one lets more n-grams pass, never fewer.
3. A last scan groups the occurrences that pass the filter by fingerprint. An
   occurrence pointer - place and length in the task's bytes - stands for each group;
   all its occurrences are compared with it byte by byte, and one that differs (a
   collision) stands for itself. Only then phrases become text. The shuffle sums
   counts by (fingerprint, language, text) and keeps the least document as a pointer.
   So counts are by text, and exact whatever the fingerprints do.
4. Scores, the covering rule and ranks are joins and windows over frequent phrases only.
   Products are decimals of 38 digits.

Pieces end at ``. , ; : ! ?`` and line breaks, words at blanks and tabs; phrases lie in
one piece, and overlapping occurrences all count.

Edge cases: a null text is an empty one; a null lang is ``und``; texts without words add
nothing; repeated rows count each; ties in score go to the higher count, then the lesser
phrase by bytes; an empty table gives an empty table; extra columns are not read; a text
above ``PART_BYTES`` is worked on in parts that overlap by ``LONGEST`` - 1 words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pannier.llm.words import mix, owners, slices, utf8
from pannier.session import materialise

LONGEST = 5
LEAST = 100
TOP = 2000
#: Percent of a phrase's count at which a longer one covers it.
COVER = 100
#: Bits of the filter of frequent fingerprints, two for each.
FILTER_BITS = 1 << 26
#: Bytes of one text that are worked on at once; fingerprints that a task holds before it sends them.
PART_BYTES = 4_000_000
HELD = 1 << 21

_U = np.uint64
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n + 1, _U(base))
    out[0] = 1
    return np.cumprod(out)


def ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial fingerprints of ranges of a sequence, from its prefix sums."""
    prefix = np.concatenate([[_U(0)], np.cumsum(values * _powers(len(values))[:-1])])
    return (prefix[end] - prefix[start]) * _powers(len(values), pow(_BASE, -1, 1 << 64))[start]


class Words:
    """The words of some texts: bytes with one blank after each word, their places, pieces and fingerprints."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        low = _LOWER[data]
        inside = ~_GAP[low]
        edge = np.zeros(len(low) + 1, bool)  # texts begin and end here
        edge[at] = True
        before = np.concatenate([[True], ~inside[:-1]]) | edge[:-1]
        start = inside & before
        place = np.cumsum(inside) + np.cumsum(start) - 2
        begins = np.flatnonzero(start)
        self.first = place[begins]
        self.bytes = np.full(np.count_nonzero(inside) + len(begins), 32, np.uint8)
        self.bytes[place[inside]] = low[inside]
        self.end = np.append(self.first[1:], len(self.bytes))[: len(begins)] - 1
        self.text = owners(np.searchsorted(begins, at))
        self.piece = np.cumsum(_BREAK[low])[begins] + self.text
        codes = ranges(self.bytes.astype(np.uint64) + _U(1), self.first, self.end)
        self.codes = mix(codes + (self.end - self.first).astype(np.uint64))

    def grams(self, n: int, langs: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the n-grams that begin at each of the first ``count`` words, and which of them lie in one piece."""
        m = max(0, min(count, len(self.codes) - n + 1))
        at = np.arange(m)
        found = mix(ranges(self.codes, at, at + n) + mix(langs[self.text[:m]] + _U(n)))
        return found, self.piece[:m] == self.piece[n - 1 : n - 1 + m]


def _parts(data: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """Parts of a long text and whether the text ends there; n-grams that begin in a part's last ``LONGEST`` - 1 words are the next one's."""
    lo, most = 0, PART_BYTES
    while len(data) - lo > most:
        inside = ~_GAP[data[lo : lo + most]]
        begins = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        if len(begins) <= LONGEST:
            most *= 2
            continue
        yield data[lo : lo + begins[-1]], False
        lo, most = lo + int(begins[-LONGEST]), PART_BYTES
    yield data[lo:], True


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, int]]:
    """Words of some rows, the rows' numbers in the batch, and how many words n-grams may begin at."""
    data, at = utf8(batch.column("text"))
    long = np.flatnonzero(np.diff(at) > PART_BYTES)
    edges = np.unique(np.concatenate([[0], long, long + 1, [len(at) - 1]]))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        here = data[at[lo] : at[hi]]
        if hi - lo > 1 or lo not in long:
            words = Words(here, at[lo : hi + 1] - at[lo])
            yield words, np.arange(lo, hi), len(words.codes)
            continue
        for part, last in _parts(here):
            words = Words(part, np.array([0, len(part)]))
            yield words, np.array([lo]), len(words.codes) - (0 if last else LONGEST - 1)


def _passing(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which fingerprints the filter holds, or may hold."""
    width = int(len(bits) * 64).bit_length() - 1
    out = np.ones(len(keys), bool)
    for place in (keys >> _U(64 - width), keys & _U((1 << width) - 1)):
        out &= (bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) == 1
    return out


def _wanted(
    words: Words, langs: np.ndarray, count: int, lengths: range, bits: np.ndarray | None
) -> Iterator[np.ndarray]:
    """Fingerprints of n-grams; with a filter only of those whose word pairs all pass it."""
    if bits is not None:
        keys, whole = words.grams(2, langs, len(words.codes))
        frequent = whole & _passing(bits, keys)
    for n in lengths:
        keys, whole = words.grams(n, langs, count)
        for j in range(n - 1 if bits is not None else 0):  # its pairs
            whole = whole & frequent[j : j + len(whole)]
        yield keys[whole]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _lang_codes(batch: pa.RecordBatch) -> np.ndarray:
    return mix(pd.util.hash_array(batch.column("lang").to_numpy(zero_copy_only=False), categorize=True))


def _count(batches: Iterator[pa.RecordBatch], lengths: range, filter_: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """(key, n) sums of a task; what it holds is sent when it grows beyond ``HELD``."""
    bits = filter_.value if filter_ else None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def packed() -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            codes = _lang_codes(part)
            for words, of, count in _texts(part):
                for keys in _wanted(words, codes[of], count, lengths, bits):
                    if len(keys):
                        held.append(_summed(keys, np.ones(len(keys), np.int64)))
                        size += len(held[-1][0])
            if size > HELD:
                held = [packed()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield rows(*held[0])
                    held, size = [], 0
    if held:
        yield rows(*packed())


def _filter(counted: DataFrame, least: int, bits: np.ndarray) -> np.ndarray:
    """The filter with the fingerprints of ``counted(key, n)`` seen ``least`` times added.

    Bits are set by the executors; the driver gets the filter's words, ``FILTER_BITS`` / 64 at most.
    """
    width = FILTER_BITS.bit_length() - 1
    places = F.array(F.shiftrightunsigned("key", 64 - width), F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1)))
    words = (
        counted.groupBy("key")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least)
        .select(F.explode(places).alias("place"))
        .select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, int(place & 63))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = bits.copy()
    out[words["word"].to_numpy()] |= words["bits"].to_numpy().view(np.uint64)
    return out


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which ranges ``a`` of the bytes equal the ranges ``b``."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,)).copy()
    same = size_a == size_b
    at, step = np.flatnonzero(same), 0
    while len(at):
        left = np.minimum(size_a[at] - step, 8)
        differ = (eight[a[at] + step] ^ eight[b[at] + step]) << ((8 - left) * 8).astype(np.uint64)
        same[at[differ != 0]] = False
        step += 8
        at = at[(differ == 0) & (size_a[at] > step)]
    return same


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Ranges of the bytes as strings."""
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]
    return pa.Array.from_buffers(pa.large_string(), len(size), buffers).cast(pa.string())


def _materialise(batches: Iterator[pa.RecordBatch], filter_: Broadcast, longest: int) -> Iterator[pa.RecordBatch]:
    """Frequent phrases of a task as text, and each language's number of words (n = 0)."""
    bits = filter_.value
    names = ["lang", "n", "key", "phrase", "f", "doc"]

    for batch in batches:
        for part in slices(batch, "text"):
            codes, langs, ids = _lang_codes(part), part.column("lang"), part.column("doc_id")
            by_id = pc.sort_indices(ids).to_numpy()
            rank = np.empty(len(by_id), np.int64)
            rank[by_id] = np.arange(len(by_id))
            for words, of, count in _texts(part):
                row = of[words.text]
                rows_, total = np.unique(row[:count], return_counts=True)
                none = pa.nulls(len(rows_))
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.take(pa.array(rows_)),
                        pa.array(np.zeros(len(rows_), np.int32)),
                        none.cast(pa.int64()),
                        none.cast(pa.string()),
                        pa.array(total),
                        none.cast(ids.type),
                    ],
                    names,
                )
                for n in range(1, longest + 1):
                    keys, whole = words.grams(n, codes[of], count)
                    at = np.flatnonzero(whole)
                    at = at[_passing(bits, keys[at])]
                    if not len(at):
                        continue
                    at = at[np.argsort(keys[at], kind="stable")]
                    key = keys[at]
                    fresh = np.concatenate([[True], key[1:] != key[:-1]])
                    pointer = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]  # of each occurrence's group
                    start, size = words.first, words.end[n - 1 :] - words.first[: len(words.first) - n + 1]
                    alike = _same(words.bytes, start[at], start[pointer], size[at], size[pointer])
                    alike &= codes[row[at]] == codes[row[pointer]]
                    first = np.flatnonzero(fresh)
                    sums = np.add.reduceat(alike.astype(np.int64), first)
                    least = np.minimum.reduceat(rank[row[at]], first)
                    odd = ~alike  # collisions stand for themselves
                    place = np.concatenate([at[first], at[odd]])
                    yield pa.RecordBatch.from_arrays(
                        [
                            langs.take(pa.array(row[place])),
                            pa.array(np.full(len(place), n, np.int32)),
                            pa.array(np.concatenate([key[first], key[odd]]).view(np.int64)),
                            _cut(words.bytes, start[place], size[place]),
                            pa.array(np.concatenate([sums, np.ones(odd.sum(), np.int64)])),
                            ids.take(pa.array(by_id[np.concatenate([least, rank[row[at[odd]]]])])),
                        ],
                        names,
                    )


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """Phrases of 1 to ``longest`` words seen ``least`` times, with f and the least doc; one row a language with n = 0 and its words."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    sent = None
    for lengths in (range(1, min(longest, 2) + 1), range(3, longest + 1)):
        if not lengths:
            continue
        counted = rows.select("lang", "text").mapInArrow(partial(_count, lengths=lengths, filter_=sent), "key long, n long")
        bits = _filter(counted, least, bits)
        sent = spark.sparkContext.broadcast(bits)
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(
        partial(_materialise, filter_=sent, longest=longest),
        f"lang string, n int, key long, phrase string, f long, doc {kind}",
    )
    return (
        found.groupBy("lang", "n", "key", "phrase")
        .agg(F.sum("f").alias("f"), F.min("doc").alias("doc"))
        .where((F.col("n") == 0) | (F.col("f") >= least))
        .drop("key")
    )


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, first_doc."""
    found = materialise(phrases(docs, least, longest), "phrases")
    totals = found.where("n = 0").select("lang", F.col("f").alias("total"))
    counts = found.where("n > 0").select("lang", "phrase", "f")
    long = found.where("n > 1").withColumn("words", F.split("phrase", " "))
    cuts = long.select("lang", "phrase", "words", "n", F.explode(F.expr("sequence(1, n - 1)")).alias("k")).select(
        "lang",
        "phrase",
        "k",
        F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("right"),
    )
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = "decimal(18,0)"
    scored = (
        cuts.join(long.select("lang", "phrase", F.col("f").alias("a"), F.col("doc").alias("first_doc")), ["lang", "phrase"])
        .join(totals, "lang")
        .withColumn("score", F.expr(f"(cast(a as {wide}) * (cast(total as {wide}) * 1000)) div (cast(l as {wide}) * cast(r as {wide}))"))
    )
    best = scored.groupBy("lang", "phrase", "a", "total", "first_doc").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = long.where("n > 2").select("lang", "words", "n", "f", F.explode(F.expr("sequence(2, n - 1)")).alias("m"))
    inner = inner.select("lang", "words", "f", "m", F.explode(F.expr("sequence(1, n - m + 1)")).alias("i"))
    over = (
        inner.select("lang", F.expr("array_join(slice(words, i, m), ' ')").alias("phrase"), "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("over"))
    )
    held = best.join(over, ["lang", "phrase"], "left").where(
        F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * cover)
    )
    order = Window.partitionBy("lang").orderBy(F.col("c.score").desc(), F.col("a").desc(), "phrase")
    return (
        held.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select(
            "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r",
            F.col("total").alias("n"), "c.score", "first_doc",
        )
    )
