"""Words, shingles and occurrence numbers of a batch of texts as flat arrays.

Everything works on whole texts; a null text is an empty one. Words are maximal
runs of letters and digits of the lower-cased text. Arrays are flat over all
documents of a slice, with offsets per document, so numpy does the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once inside a task; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``SLICE_BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def filled(texts: pa.Array) -> pa.Array:
    """Nulls become empty texts."""
    return pc.fill_null(texts.cast(pa.large_string()), "")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each."""
    texts = filled(texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def plain(texts: pa.Array) -> pa.Array:
    """Lower case, letters and digits only, one blank between words."""
    lowered = pc.utf8_lower(filled(texts))
    return pc.ascii_trim_whitespace(
        pc.replace_substring_regex(lowered, r"[^\pL\pN]+", " ")
    )


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces between blanks over all texts, and offsets per text; empty pieces go."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        offsets, flat = before[offsets], flat.filter(pa.array(full))
    return flat, offsets


def hashed(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash per string, computed once per distinct string."""
    if not len(flat):
        return np.empty(0, np.uint64)
    coded = flat.dictionary_encode()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return known[coded.indices.to_numpy(zero_copy_only=False)]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes over all texts and offsets per text."""
    flat, offsets = split(plain(texts))
    return hashed(flat), offsets


def owners(offsets: np.ndarray) -> np.ndarray:
    """Text number of every element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(
    codes: np.ndarray, offsets: np.ndarray, k: int, short: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` successive words, and offsets per text.

    With ``short`` a text of 1 to k-1 words has one shingle, all its words.
    """
    counts = np.diff(offsets)
    n = np.maximum(counts - k + 1, np.minimum(counts, 1) if short else 0)
    out = np.concatenate([[0], np.cumsum(n)])
    owner = owners(out)
    at = np.arange(out[-1]) - out[:-1][owner] + offsets[:-1][owner]
    acc = np.zeros(len(at), np.uint64)
    if not len(at):
        return acc, out
    end = offsets[1:][owner]
    for j in range(k):
        here = at + j
        step = codes[np.minimum(here, len(codes) - 1)]
        acc = acc * _U(0x9E3779B97F4A7C15) + np.where(here < end, step, _U(j))
    return mix(acc), out


def occurrences(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0 for the first place of a value in its text, 1 for the second, and so on."""
    if not len(values):
        return np.empty(0, np.int64)
    key = values ^ mix(owners(offsets).astype(np.uint64) + _U(1))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    place = np.arange(len(key))
    out = np.empty(len(key), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return out


def group_min(values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """Least value per text; ``empty`` for a text without values."""
    out = np.full(len(offsets) - 1, empty, values.dtype)
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = np.minimum.reduceat(values, offsets[:-1][full])
    return out


def group_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum per text, 0 for a text without values."""
    out = np.zeros(len(offsets) - 1)
    full = np.diff(offsets) > 0
    if full.any():
        kind = np.float64 if values.dtype.kind == "f" else np.int64
        raw = values.view(np.uint8) if values.dtype == bool else values
        out[full] = np.add.reduceat(raw, offsets[:-1][full], dtype=kind)
    return out
