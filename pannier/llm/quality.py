"""Quality classifier: a factorisation machine over hashed words and structure.

score(x) = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),
so all pairwise interactions cost time linear in the features of a text.

Features of a text: hashed words (sublinear counts, unit length), structure
statistics (repetition, punctuation, capitals, lines, ...) and the length of the
text as metadata, the latter two both as numbers and as bins. Label, language, source and id
are never features.

Edge cases: a null text is an empty one and is scored like any text (it has
structure features only); labels that are null do not take part; a document
labelled more than once counts as good only if all its labels say so; without
any labelled row every score is 0.5. Ids may be of any type; a null id takes no part in the
fit. Repeated rows are scored each; extra columns pass untouched, but for one with the
name that ``score`` is to add, which gives way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pannier.llm.words import filled, group_sum, hashed, mix, owners, slices, split, utf8


@dataclass(frozen=True)
class FmConfig:
    buckets: int = 1 << 15
    rank: int = 6
    epochs: int = 6
    rate: float = 0.08
    decay: float = 1e-5
    batch: int = 256
    #: Fewest steps of a fit: few labelled rows are gone through more often.
    least_steps: int = 400
    seed: int = 17
    #: Most labelled documents used to fit; taken in hash order of their ids.
    max_train_rows: int = 20_000


STATS = (
    "log_words", "log_chars", "word_length", "distinct_words", "adjacent_equal",
    "top_word", "capitals", "digits", "symbols", "exclaims", "bars",
    "words_per_line", "repeated_lines", "ends_plain", "non_ascii",
)
BINS = 12


def _char_classes() -> dict[str, np.ndarray]:
    b = np.arange(256)
    upper = (b >= 65) & (b <= 90)
    lower = (b >= 97) & (b <= 122)
    digit = (b >= 48) & (b <= 57)
    mild = np.isin(b, [ord(c) for c in " \n\t\r.,"])
    return {
        "upper": upper,
        "letter": upper | lower,
        "digit": digit,
        "symbol": (b < 128) & ~(upper | lower | digit | mild),
        "exclaim": b == ord("!"),
        "bar": b == ord("|"),
        "line": b == ord("\n"),
        "high": b >= 192,
    }


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _structure(texts: pa.Array, flat: pa.Array, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text, one column per entry of ``STATS``, each within 0 and 1."""
    n = len(texts)
    chars, at = utf8(texts)
    size = np.diff(at).astype(float)
    count = {k: group_sum(lut[chars], at) for k, lut in _char_classes().items()}
    n_words = np.diff(offsets).astype(float)

    adjacent = np.zeros(len(codes))
    if len(codes) > 1:
        adjacent[1:] = codes[1:] == codes[:-1]
        starts = offsets[:-1][np.diff(offsets) > 0]
        adjacent[starts] = 0
    doc = owners(offsets)
    order = np.lexsort((codes, doc))
    first = np.ones(len(codes), bool)
    if len(codes) > 1:
        same = (codes[order][1:] == codes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        first[1:] = ~same
    groups = np.flatnonzero(first)
    times = np.diff(np.append(groups, len(codes)))
    of = doc[order][groups] if len(codes) else np.empty(0, int)
    distinct = np.bincount(of, minlength=n).astype(float)
    top = np.zeros(n)
    np.maximum.at(top, of, times)

    tail = pc.utf8_slice_codeunits(flat, -1).cast(pa.large_string()) if len(flat) else flat
    plain_end = (
        pc.utf8_is_alnum(tail).to_numpy(zero_copy_only=False).astype(float) if len(flat) else np.empty(0)
    )

    lists = pc.split_pattern(texts, "\n")
    line_at = np.asarray(lists.offsets, dtype=np.int64)
    lines = hashed(lists.values.slice(line_at[0], line_at[-1] - line_at[0]))
    line_at = line_at - line_at[0]
    line_doc = owners(line_at)
    n_lines = np.diff(line_at).astype(float)
    pairs = np.unique(mix(lines) ^ mix(line_doc.astype(np.uint64) + np.uint64(7)), return_index=True)[1]
    distinct_lines = np.bincount(line_doc[pairs], minlength=n).astype(float)

    out = np.stack(
        [
            np.log1p(n_words) / 12,
            np.log1p(size) / 16,
            _ratio(count["letter"] + 2 * count["high"], n_words) / 20,
            _ratio(distinct, n_words),
            _ratio(group_sum(adjacent, offsets), n_words),
            _ratio(top, n_words),
            _ratio(count["upper"], count["letter"]),
            _ratio(count["digit"], size) * 4,
            _ratio(count["symbol"], size) * 4,
            _ratio(count["exclaim"], n_words),
            _ratio(count["bar"], n_words) * 2,
            np.log1p(_ratio(n_words, n_lines)) / 8,
            1 - _ratio(distinct_lines, n_lines),
            _ratio(group_sum(plain_end, offsets), n_words),
            _ratio(count["high"], size) * 4,
        ],
        axis=1,
    )
    return np.clip(out, 0, 1)


def features(texts: pa.Array, cfg: FmConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids, values and offsets of a slice of texts (compressed rows)."""
    texts = filled(texts)
    n = len(texts)
    flat, offsets = split(texts)
    codes = hashed(flat)
    stats = _structure(texts, flat, codes, offsets)

    bucket = (mix(codes) % np.uint64(cfg.buckets)).astype(np.int64)
    keys, times = np.unique(owners(offsets) * cfg.buckets + bucket, return_counts=True)
    row, word = np.divmod(keys, cfg.buckets)
    value = 1 + np.log(times)
    norm = np.sqrt(np.bincount(row, value**2, minlength=n))
    value = value / np.where(norm > 0, norm, 1)[row]

    width = len(STATS)
    numbers = np.tile(cfg.buckets + np.arange(width), (n, 1))
    bins = cfg.buckets + width + np.arange(width) * BINS + np.minimum(stats * BINS, BINS - 1).astype(int)
    rows = np.concatenate([row, np.repeat(np.arange(n), 2 * width)])
    ids = np.concatenate([word, np.hstack([numbers, bins]).ravel()])
    values = np.concatenate([value, np.hstack([stats, np.full((n, width), 0.5)]).ravel()])
    order = np.argsort(rows, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return ids[order], values[order].astype(np.float32), at


def width_of(cfg: FmConfig) -> int:
    return cfg.buckets + len(STATS) * (1 + BINS)


class Machine:
    """Weights of a factorisation machine; its size depends on the settings alone."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    @classmethod
    def empty(cls, cfg: FmConfig) -> Machine:
        rng = np.random.default_rng(cfg.seed)
        size = width_of(cfg)
        return cls(0.0, np.zeros(size, np.float32), rng.normal(0, 0.03, (size, cfg.rank)).astype(np.float32))

    def raw(self, ids: np.ndarray, values: np.ndarray, at: np.ndarray):
        """Sum before the sigmoid, and the factor sums that its gradient needs.

        Every row has structure features, so no row is empty.
        """
        starts = at[:-1]
        linear = np.add.reduceat(self.weights[ids] * values, starts)
        scaled = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(scaled, starts)
        squares = np.add.reduceat(scaled**2, starts)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(1), sums, scaled

    def score(self, ids: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, values, at)[0].astype(float), -35, 35)))

    def fit(self, ids, values, at, labels, cfg: FmConfig) -> None:
        """AdaGrad over mini-batches in a seeded order, ``least_steps`` of them at the least."""
        rng = np.random.default_rng(cfg.seed)
        epochs = max(cfg.epochs, -(-cfg.least_steps // max(1, len(labels) // cfg.batch)))
        seen_w = np.full(len(self.weights), 1e-2, np.float32)
        seen_v = np.full(self.factors.shape, 1e-2, np.float32)
        seen_b = 1e-2
        n, counts = len(labels), np.diff(at)
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(n), max(1, n // cfg.batch)):
                local = np.concatenate([[0], np.cumsum(counts[rows])])
                owner = owners(local)
                pick = np.arange(local[-1]) - local[:-1][owner] + at[:-1][rows][owner]
                i, x = ids[pick], values[pick]
                raw, sums, scaled = self.raw(i, x, local)
                error = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[rows]) / len(rows)
                used, back = np.unique(i, return_inverse=True)
                each = (error[owner] * x).astype(np.float32)
                grad = np.bincount(back, each) + cfg.decay * self.weights[used]
                seen_w[used] += grad**2
                self.weights[used] -= cfg.rate * grad / np.sqrt(seen_w[used])
                cross = sums[owner] - scaled
                for f in range(cfg.rank):
                    grad = np.bincount(back, each * cross[:, f]) + cfg.decay * self.factors[used, f]
                    seen_v[used, f] += grad**2
                    self.factors[used, f] -= cfg.rate * grad / np.sqrt(seen_v[used, f])
                step = float(error.sum())
                seen_b += step**2
                self.bias -= cfg.rate * step / seen_b**0.5

    def to_bytes(self) -> bytes:
        parts = [np.float32([self.bias]), self.weights, self.factors.ravel()]
        return zlib.compress(np.concatenate(parts).astype("<f4").tobytes(), 1)

    @classmethod
    def from_bytes(cls, data: bytes, cfg: FmConfig) -> Machine:
        numbers = np.frombuffer(zlib.decompress(data), "<f4")
        size = width_of(cfg)
        return cls(float(numbers[0]), numbers[1 : 1 + size], numbers[1 + size :].reshape(size, cfg.rank))


def training_ids(labels: DataFrame, label: str, cfg: FmConfig, held_out=None) -> DataFrame:
    """At most ``max_train_rows`` (doc_id, label), the first in hash order of the ids."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if held_out is not None:
        known = known.where(~held_out)
    return (
        known.groupBy("doc_id")
        .agg(F.min(F.col(label).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(cfg.max_train_rows)
        .select(F.col("doc_id").alias("_train_id"), "_label")
    )


def fit(docs: DataFrame, labels: DataFrame, label: str, cfg: FmConfig | None = None, held_out=None) -> Machine:
    """Fit on a bounded sample of labelled documents; features are made in parallel.

    ``held_out`` is a condition on ``doc_id``; such rows never take part. The
    id list is broadcast, its size is bounded by ``max_train_rows``.
    """
    cfg = cfg or FmConfig()
    chosen = training_ids(labels, label, cfg, held_out)
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_train_id"))
        .select(F.xxhash64("doc_id").alias("place"), "text", "_label")
    )

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, values, at = features(part.column("text"), cfg)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("place"),
                        part.column("_label").cast(pa.int32()),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.float32())),
                    ],
                    ["place", "label", "ids", "vals"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        machine = Machine.empty(cfg)
        if not tables:
            return
        table = pa.concat_tables(tables).combine_chunks()
        lists = table.column("ids").chunk(0)
        at = np.asarray(lists.offsets, dtype=np.int64)
        ids = lists.values.to_numpy().astype(np.int64)
        values = table.column("vals").chunk(0).values.to_numpy()
        labels_ = table.column("label").to_numpy().astype(float)
        machine.fit(ids[at[0] : at[-1]], values[at[0] : at[-1]], at - at[0], labels_, cfg)
        yield pa.RecordBatch.from_arrays([pa.array([machine.to_bytes()], pa.binary())], ["model"])

    made = (
        rows.mapInArrow(featurise, "place long, label int, ids array<int>, vals array<float>")
        .repartition(1)
        .sortWithinPartitions("place", "label", F.size("ids"), F.xxhash64("ids", "vals"))
        .mapInArrow(learn, "model binary")
        .first()
    )
    if made is None:  # nothing learned: every score is 0.5
        blank = Machine.empty(cfg)
        return Machine(0.0, blank.weights, blank.factors * 0)
    return Machine.from_bytes(made["model"], cfg)


def score(docs: DataFrame, machine: Machine, cfg: FmConfig | None = None, text: str = "text", name: str = "score") -> DataFrame:
    """Add ``name``, the probability that a text is good; all other columns stay.

    A column that is already called ``name`` gives way to the new one.
    """
    narrow = docs.drop(name)
    names = narrow.columns
    numbered, at = _numbered(narrow, text)

    def add(part: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, "score"])

    schema = StructType([*numbered.schema.fields, StructField("score", DoubleType())])
    return numbered.mapInArrow(_judge(docs, machine, cfg, at, add), schema).toDF(*names, name)


def kept(docs: DataFrame, machine: Machine, cfg: FmConfig | None = None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents with a score of at least ``least``, all columns as they came, whatever their names."""
    numbered, at = _numbered(docs, text)

    def choose(part: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        return part.filter(pa.array(scores >= least))

    return numbered.mapInArrow(_judge(docs, machine, cfg, at, choose), numbered.schema).toDF(*docs.columns)


def _numbered(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """Columns under plain names, since a name with a dot cannot go to a batch function, and the text's."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index(text)]


def _judge(docs: DataFrame, machine: Machine, cfg: FmConfig | None, text: str, then):
    """A function of batches that hands every part and its scores to ``then``."""
    cfg = cfg or FmConfig()
    data = docs.sparkSession.sparkContext.broadcast(machine.to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.from_bytes(data.value, cfg)
        for batch in batches:
            for part in slices(batch, text):
                yield then(part, machine.score(*features(part.column(text), cfg)))

    return run
