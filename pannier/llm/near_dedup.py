"""MinHash near-dedup by Order MinHash, verified by banded alignment.

1. Equal texts collapse to one node (their MD5); all further work is on nodes.
2. A node's five-word shingles are numbered by occurrence. For each of
   ``tables`` hash functions the ``TUPLE`` least of them, in text order, give one
   key. Reordered text has the same shingles but other keys.
   Scattered edits leave few five-word shingles, so a second set of keys serves
   the last comparison: the least three-word shingle by each of ``SINGLES``
   hash functions and, for texts of up to ``BRIEF`` words, an exact prefix filter
   (edits of a fifth of the words cannot reach all shingles of the prefix).
3. Nodes that share a key form a bucket. Its members are aligned with one
   leader. In ``ROUNDS`` further rounds the members outside of a bucket's largest class
   are aligned with a member of that class, another one in every bucket and round,
   so a family of n versions settles in a few times n pairs. What is then still in different classes is
   compared exactly: every two members of a bucket of either set, block against block, are
   bounded by length and counts. Members with partners left are aligned with the bucket's member that has most;
   those still apart are bounded once more by finer counts, which leave them in the first bucket that a pair shares,
   then aligned with each other inside the task that holds their blocks: only links leave it.
   So classes are what aligning all pairs of all buckets would give.
4. A pair counts if the word edit distance is at most ``1 - threshold`` of the
   longer text. Counts of words and of word pairs bound the distance from below before
   any text is fetched. Alignment runs in a band that doubles until the distance fits,
   after common ends are cut off; a column of the band is one number's bits.
5. Links are closed to classes by star contractions.

Edge cases: a null text is an empty one; a text without words is compared by its
characters that are not blank, and texts without any form one class; texts of 1 to 4 words have a single shingle;
repeated rows are exact copies; a class is named by its least doc_id (null if
it has none); extra columns pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pannier.llm.components import components
from pannier.llm.words import (
    filled,
    group_min,
    hashed,
    mix,
    occurrences,
    owners,
    plain,
    shingles,
    slices,
    split,
)
from pannier.session import dealt, discard, materialise, settings

SHINGLE = 5
TABLES = 32
TUPLE = 2
THRESHOLD = 0.8
#: Words of a shingle of the second keys, their hash functions, and most words of a text with prefix keys.
GRAM = 3
SINGLES = 24
BRIEF = 40
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Columns of an alignment whose words are looked up together, and the first width of a band.
_COLUMNS = 1024
_WIDTH = 256
#: Rows of counts and of block members are wide; batches of the default size, twice over, are much of an executor's memory.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: Rounds in which members left apart follow a member of the largest class.
ROUNDS = 2
#: Counters of a text's words and of its word pairs; members of a bucket that are compared at once with as many others.
_WORDS = 256
_PAIRS = 256
_BINS = _WORDS + _PAIRS
_BLOCK = 256
#: Words of a block whose texts are aligned, its finer counters, and pairs whose counts are compared at once.
_BLOCK_WORDS = 100_000
_FINE = 4096
_TESTS = 4096
#: Blocks of a bucket that a task keeps ready.
_KEPT = 16
_FOUND = "key long, node binary, n_words long, partners long"
_MEMBER = np.dtype([("node", "V16"), ("root", ">u8", 2), ("n", ">i8"), ("counts", "u1", _BINS)])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes over all texts and offsets per text; for a text without words, hashes of its characters that are not blank."""
    cleaned = plain(texts)
    bare = pc.equal(pc.binary_length(cleaned), 0)
    if pc.any(bare).as_py():
        spaced = pc.replace_substring_regex(filled(texts), r"(\S)", r"\1 ")
        cleaned = pc.if_else(bare, spaced, cleaned)
    flat, offsets = split(cleaned)
    return hashed(flat), offsets


def order_minhash(values: np.ndarray, offsets: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """Keys, one row per text and one column per table.

    ``values`` are shingle hashes made distinct by occurrence. A text without
    shingles has keys of its own kind, equal for all such texts.
    """
    n = len(offsets) - 1
    out = np.empty((n, tables), np.uint64)
    lengths = np.diff(offsets)
    for j in range(tables):
        rank = values * (mix(np.uint64([j + 1]))[0] | np.uint64(1))  # another order of well mixed values
        least, at = [], []
        for _ in range(TUPLE):
            low = group_min(rank, offsets, _TOP)
            hit = np.flatnonzero(rank == np.repeat(low, lengths))
            where = np.full(n, len(values))
            owner = np.searchsorted(offsets, hit, "right") - 1
            where[owner[::-1]] = hit[::-1]  # the first one of a text stays
            least.append(low)
            at.append(np.where(low == _TOP, len(values) + 1, where))
            rank[hit] = _TOP
        turn = at[0] > at[1]
        first = np.where(turn, least[1], least[0])
        second = np.where(turn, least[0], least[1])
        out[:, j] = mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(second) + np.uint64(j))
    return out


def _prefixes(threshold: float) -> np.ndarray:
    """For texts of 0 to ``BRIEF`` words: so many of their shingles, in any fixed order, hold one of every similar text's.

    Of two texts, the longer of L words and at most d edits apart, L - GRAM + 1 - GRAM x d
    shingles are common. Where that is none, all are taken; texts of 4 and 5 words take word pairs too.
    """
    out = np.zeros(BRIEF + 1, np.int64)
    for n in range(GRAM, BRIEF + 1):
        longest = range(n, int(n / threshold + 1e-9) + 1)
        common = min(m - GRAM + 1 - GRAM * int((1 - threshold) * m + 1e-9) for m in longest)
        out[n] = n - GRAM + 1 - max(common, 1) + 1
    return out


def second_keys(codes: np.ndarray, at: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Keys for scattered edits and short texts, and offsets per text."""
    n_words = np.diff(at)
    keys, of = [], []

    def numbered(k: int) -> tuple[np.ndarray, np.ndarray]:
        values, offsets = shingles(codes, at, k)
        times = occurrences(values, offsets).astype(np.uint64)
        return mix(values + times * np.uint64(0x2545F4914F6CDD1D) + np.uint64(k)), offsets

    values, offsets = numbered(GRAM)
    for j in range(SINGLES):
        low = group_min(values * (mix(np.uint64([j + 101]))[0] | np.uint64(1)), offsets, _TOP)
        keys.append(mix(low + np.uint64(j + 101)))
        of.append(np.arange(len(n_words)))
    owner = owners(offsets)
    order = np.lexsort((values, owner))
    place = np.arange(len(values)) - offsets[:-1][owner]
    within = place < np.where(n_words > BRIEF, 0, _prefixes(threshold)[np.minimum(n_words, BRIEF)])[owner]
    keys.append(mix(values[order][within] ^ np.uint64(0xA5A5)))
    of.append(owner[within])
    values, offsets = numbered(2)
    owner = owners(offsets)
    within = (n_words[owner] == 4) | (n_words[owner] == 5)
    keys.append(mix(values[within] ^ np.uint64(0x5A5A)))
    of.append(owner[within])
    of_ = np.concatenate(of)
    ends = np.concatenate([[0], np.cumsum(np.bincount(of_, minlength=len(n_words)))])
    return np.concatenate(keys)[np.argsort(of_, kind="stable")], ends


def _kinds(values: np.ndarray, kinds: int) -> np.ndarray:
    return ((values >> np.uint64(40)) % np.uint64(kinds)).astype(np.int64)


def counts_of(codes: np.ndarray, offsets: np.ndarray, words: int = _WORDS, pairs: int = _PAIRS) -> np.ndarray:
    """How often a text has words of ``words`` kinds, then word pairs of ``pairs`` kinds, 255 at most; one row per text."""
    n = len(offsets) - 1
    sides = []
    for bins, (values, at) in ((words, (codes, offsets)), (pairs, shingles(codes, offsets, 2, short=False))):
        kind = owners(at) * bins + _kinds(values, bins)
        sides.append(np.minimum(np.bincount(kind, minlength=n * bins), 255).astype(np.uint8).reshape(n, bins))
    return np.hstack(sides)


def within_counts(a: np.ndarray, b: np.ndarray, limits: np.ndarray, words: int = _WORDS) -> np.ndarray:
    """Which rows of counts leave a distance of ``limits`` possible.

    An edit changes one word for another, adds one or takes one away, so what one text
    has more of any words is a lower bound of the distance. It changes two word pairs at most, so
    what it has more of any pairs is at most twice the distance.
    """
    ok = np.ones(len(a), bool)
    for side, most in ((slice(words, None), 2 * limits), (slice(0, words), limits)):
        at = np.flatnonzero(ok)
        x, y = a[at, side], b[at, side]
        high = np.maximum(x, y)
        more = np.maximum((high - x).sum(axis=1, dtype=np.int64), (high - y).sum(axis=1, dtype=np.int64))
        ok[at] = more <= most[at]
    return ok


def signatures(texts: DataFrame, tables: int = TABLES, threshold: float = THRESHOLD) -> DataFrame:
    """(node, first_id, copies, n_words, counts, keys, others) of every row of ``texts(node, text, first_id, copies)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                codes, at = tokens(part.column("text"))
                values, offsets = shingles(codes, at, SHINGLE)
                times = occurrences(values, offsets).astype(np.uint64)
                values = mix(values + times * np.uint64(0x2545F4914F6CDD1D))
                keys = order_minhash(values, offsets, tables).view(np.int64)
                ends = pa.array(np.arange(len(keys) + 1) * tables, pa.int32())
                others, ends_ = second_keys(codes, at, threshold)
                counts = pa.array([row.tobytes() for row in counts_of(codes, at)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"),
                        part.column("first_id"),
                        part.column("copies"),
                        pa.array(np.diff(at)),
                        counts,
                        pa.ListArray.from_arrays(ends, pa.array(keys.ravel())),
                        pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), pa.array(others.view(np.int64))),
                    ],
                    ["node", "first_id", "copies", "n_words", "counts", "keys", "others"],
                )

    kind = texts.schema["first_id"].dataType.simpleString()
    return texts.select("node", "text", "first_id", "copies").mapInArrow(
        run, f"node binary, first_id {kind}, copies long, n_words long, counts binary, keys array<long>, others array<long>"
    )


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def _couples(a: np.ndarray) -> np.ndarray:
    return np.sort(a[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[1:])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the common part of two sorted multisets."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    if not len(both):
        return 0
    values = both[np.concatenate([[True], both[1:] != both[:-1]])]
    count = lambda x: np.searchsorted(x, values, "right") - np.searchsorted(x, values, "left")
    return int(np.minimum(count(a), count(b)).sum())


def _rows(a: np.ndarray, lo: int, hi: int, wanted: set[int]) -> dict[int, int]:
    """For every wanted word the rows in ``lo`` .. ``hi`` that hold it, as a bit set with row ``lo`` at bit 0.

    Row ``r`` holds word ``r - 1`` of ``a``; rows outside of ``a`` hold none.
    """
    size = (hi - lo) // 8 + 1
    found: dict[int, bytearray] = {}
    start = max(lo, 1)
    for bit, word in enumerate(a[start - 1 : max(hi, 0)].tolist(), start - lo):
        if word in wanted:
            row = found.get(word)
            if row is None:
                row = found[word] = bytearray(size)
            row[bit >> 3] |= 1 << (bit & 7)
    return {word: int.from_bytes(row, "little") for word, row in found.items()}


def banded(a: np.ndarray, b: np.ndarray, width: int, limit: int) -> int:
    """Edit distance inside a band of ``width`` on either side of the diagonal.

    A value of at most ``width`` is the true distance; a value above ``limit`` may
    be returned early. A column of the band is kept as bits: ``up`` and ``down``
    say where the distance grows or falls by one from row to row, bit 0 being
    the row ``width`` above the diagonal. Cells outside the band count as one
    more than their neighbour, which never makes a distance too small. Work is
    columns x band / word size; memory is one block of columns.
    """
    rows, columns = len(a), len(b)
    slant = abs(rows - columns)
    if slant > width:
        return max(rows, columns)
    full = (1 << (2 * width + 1)) - 1
    down = (1 << (width + 1)) - 1  # row 0 and those above it, which mirror the column number
    up = full ^ down
    centre, top = 1 << width, 1 << (2 * width)
    distance = 0
    for start in range(0, columns, _COLUMNS):
        block = b[start : start + _COLUMNS].tolist()
        held = _rows(a, start + 1 - width, start + len(block) + width, set(block))
        for shift, word in enumerate(block):
            same = (held.get(word, 0) >> shift) & full
            up = (up >> 1) | top  # the band moves down by a row
            down >>= 1
            level = ((((same & up) + up) ^ up) | same | down) & full  # no growth along the diagonal
            right = ((down | (full & ~(level | up))) << 1) | 1
            left = (level & up) << 1
            up = (left | ~(level | right)) & full
            down = right & level
            if not level & centre:
                distance += 1
                if distance > limit + slant:
                    return distance
    between = ((1 << slant) - 1) << (width + 1 if rows > columns else width + 1 - slant)
    rise = (up & between).bit_count() - (down & between).bit_count()
    return distance + (rise if rows > columns else -rise)


def edit_within(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """Which pairs of word sequences have an edit distance of at most their limit."""
    ok = np.zeros(len(pairs), bool)
    for p, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > limits[p]:
            continue
        a, b = _trim(a, b)
        if not len(a) or not len(b):
            ok[p] = max(len(a), len(b)) <= limits[p]
            continue
        # an edit destroys at most two word pairs, so missing pairs bound the distance from below
        least = (max(len(a), len(b)) - 1 - _shared(_couples(a), _couples(b))) / 2
        if least > limits[p]:
            continue
        limit = int(limits[p])
        width = min(limit, max(_WIDTH, int(least * 1.25)))
        distance = banded(a, b, width, limit)
        while distance > width and width < limit:
            width = min(2 * width, limit)
            distance = banded(a, b, width, limit)
        ok[p] = distance <= limit
    return ok


def aligned(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (u, v) whose texts have an edit similarity of at least ``threshold``; ``texts`` is dealt by node."""
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(
        texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "a"):
                a, a_at = tokens(part.column("a"))
                b, b_at = tokens(part.column("b"))
                each = [(a[a_at[p] : a_at[p + 1]], b[b_at[p] : b_at[p + 1]]) for p in range(part.num_rows)]
                limits = _limits(np.maximum(np.diff(a_at), np.diff(b_at)), threshold)
                ok = pa.array(edit_within(each, limits))
                yield pa.RecordBatch.from_arrays(
                    [part.column("u").filter(ok), part.column("v").filter(ok)], ["u", "v"]
                )

    return both.select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def likely(pairs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (u, v) that lengths and counts do not rule out; ``nodes`` is dealt by node."""
    side = lambda node, n, c: nodes.select(F.col("node").alias(node), F.col("n_words").alias(n), F.col("counts").alias(c))
    both = pairs.join(side("u", "n", "a"), "u").join(side("v", "m", "b"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, _BINS) for c in ("a", "b"))
            limits = _limits(np.maximum(batch.column("n").to_numpy(), batch.column("m").to_numpy()), threshold)
            ok = pa.array(within_counts(a, b, limits))
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(ok), batch.column("v").filter(ok)], ["u", "v"])

    return both.select("u", "v", "n", "m", "a", "b").mapInArrow(run, "u binary, v binary")


def _limits(longest: np.ndarray, threshold: float) -> np.ndarray:
    """Most edits between similar texts of which the longer has so many words."""
    return np.floor((1 - threshold) * longest + 1e-9).astype(np.int64)


def _bucketed(nodes: DataFrame, keys: str) -> DataFrame:
    """(key, node, n_words) for every key that several nodes hold."""
    keyed = nodes.select("node", "n_words", F.explode(keys).alias("key")).repartition("key")  # one shuffle for count and join
    ends = [end(c).alias(f"{end.__name__}_{c}") for c in ("hash", "n_words") for end in (F.min, F.max)]
    # all columns are in use, so that the join reads the same shuffle
    single = F.col("min_hash").eqNullSafe(F.col("max_hash")) & F.col("min_n_words").eqNullSafe(F.col("max_n_words"))
    shared = keyed.withColumn("hash", F.xxhash64("node")).groupBy("key").agg(*ends).where(~single).select("key")
    return keyed.join(shared, "key").select("key", "node", "n_words")


def _led(buckets: DataFrame) -> DataFrame:
    """Every member of a bucket but its leader, the least node, with the leader's node."""
    leaders = (
        buckets.groupBy("key")
        .agg(F.min(F.struct("node", "n_words")).alias("l"))
        .select("key", F.col("l.node").alias("u"), F.col("l.n_words").alias("u_words"))
    )
    return buckets.join(leaders, "key").where("node <> u")


def _rooted(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The members with their classes, in one shuffle for all that goes by key."""
    return buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).repartition("key")


def _apart(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The buckets that hold several classes; classes only grow, so the others are settled."""
    members = _rooted(buckets, roots)
    open_ = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return members.join(open_, "key").select("key", "node", "n_words")


def _outside(buckets: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Every member outside of its bucket's largest class, with a member of that class: another one by bucket and ``turn``."""
    members = _rooted(buckets, roots)
    chosen = F.min(F.struct(F.xxhash64("key", "node", F.lit(turn)).alias("o"), "node", "n_words"))
    largest = (
        members.groupBy("key", "root")
        .agg(F.count(F.lit(1)).alias("n"), chosen.alias("l"))
        .groupBy("key")
        .agg(F.max(F.struct("n", "root", "l")).alias("m"), F.count(F.lit(1)).alias("classes"))
        .where("classes > 1")
        .select("key", F.col("m.root").alias("u_root"), F.col("m.l.node").alias("u"), F.col("m.l.n_words").alias("u_words"))
    )
    return members.join(largest, "key").where("root <> u_root")


def _close(led: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs whose lengths alone do not rule them out."""
    return (
        led.where(F.least("n_words", "u_words") >= F.greatest("n_words", "u_words") * threshold - 1e-9)
        .select("u", F.col("node").alias("v"))
        .distinct()
    )


def _between(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of members of different classes that may be similar."""
    limits = _limits(np.maximum(a["n"][:, None], b["n"][None, :]), threshold)
    open_ = (a["root"][:, None, :] != b["root"][None, :, :]).any(axis=2)
    open_ &= np.abs(a["n"][:, None] - b["n"][None, :]) <= limits
    i, j = np.nonzero(np.triu(open_, 1) if same else open_)
    near = np.zeros(len(i), bool)
    for lo in range(0, len(i), _TESTS):
        x, y = i[lo : lo + _TESTS], j[lo : lo + _TESTS]
        near[lo : lo + _TESTS] = within_counts(a["counts"][x], b["counts"][y], limits[x, y])
    return i[near], j[near]


def _tally(found: dict[tuple[int, bytes], list[int]], key: int, *sides: np.ndarray) -> None:
    """Add to the partners of each member of pairs, whose ends are ``sides``."""
    for side in sides:
        for member in side[["node", "n"]].tolist():
            found.setdefault((key, bytes(member[0])), [member[1], 0])[1] += 1


def _tallied(found: dict[tuple[int, bytes], list[int]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key for key, _ in found], pa.int64()),
                pa.array([node for _, node in found], pa.binary()),
                pa.array([n for n, _ in found.values()], pa.int64()),
                pa.array([n for _, n in found.values()], pa.int64()),
            ],
            ["key", "node", "n_words", "partners"],
        )


def _summed(found: DataFrame) -> DataFrame:
    return found.groupBy("key", "node", "n_words").agg(F.sum("partners").alias("partners"))


def _across(blocks: DataFrame) -> DataFrame:
    """Every two blocks of a bucket, and each with itself (``b`` null), of ``blocks(key, block, members, blocks)``.

    Rows are grouped by ``blocks`` too, so the two kinds of buckets are told apart before their members are gathered.
    """
    many = materialise(blocks.where("blocks > 1").drop("blocks"), "blocks")
    others = many.select("key", F.col("block").alias("other"), F.col("members").alias("b"))
    pairs = many.join(others, "key").where("block < other").select("key", F.col("members").alias("a"), "b")
    alone = blocks.where("blocks = 1").select("key", "members").union(many.select("key", "members"))
    none = F.lit(None).cast(blocks.schema["members"].dataType)
    return alone.select("key", F.col("members").alias("a"), none.alias("b")).union(pairs)


def _partners(buckets: DataFrame, nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(key, node, n_words, partners): members that length and counts leave similar to others of their bucket in other
    classes, and to how many. The rows grow with the members, not with their pairs.
    """
    members = _rooted(buckets, roots)
    split = (
        members.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        .where("lo <> hi")
        .select("key", F.ceil(F.col("n") / _BLOCK).cast("long").alias("blocks"))
    )
    by_length = Window.partitionBy("key", "block").orderBy("n_words", "node")
    shorter = F.lag("n_words").over(by_length) >= F.col("n_words") * threshold - 1e-6
    longer = F.col("n_words") >= F.lead("n_words").over(by_length) * threshold - 1e-6
    members = (  # in a bucket of one block, members without another one of about their length go
        members.join(split, "key")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("near", shorter | longer)
        .where("blocks > 1 or near")
        .drop("near")
    )
    length = F.unhex(F.lpad(F.hex("n_words"), 16, "0"))
    blocks = (
        materialise(members, "members")
        .join(nodes.select("node", "counts"), "node")
        .groupBy("key", "block", "blocks")
        .agg(F.collect_list(F.concat("node", "root", length, "counts")).alias("members"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, bytes], list[int]] = {}
            for row, key in enumerate(batch.column("key").to_pylist()):
                a = np.frombuffer(b"".join(batch.column("a")[row].as_py()), _MEMBER)
                other = batch.column("b")[row].as_py()
                b = a if other is None else np.frombuffer(b"".join(other), _MEMBER)
                i, j = _between(a, b, other is None, threshold)
                _tally(found, key, a[i], b[j])
            yield from _tallied(found)

    return _summed(_across(blocks).mapInArrow(run, _FOUND))


def _fine(texts: DataFrame) -> DataFrame:
    """(node, keys, counts) of ``texts(node, text, keys)``: words and word pairs by ``_FINE`` kinds each.

    The kinds of all of them, as 16-bit numbers, or once these are not shorter, the counts by kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                codes, at = tokens(part.column("text"))
                counts = []
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = codes[lo:hi]
                    pairs = shingles(own, np.array([0, len(own)]), 2, short=False)[0]
                    if len(own) + len(pairs) < _FINE:
                        kinds = [_kinds(own, _FINE), _kinds(pairs, _FINE) + _FINE]
                        counts.append(np.concatenate(kinds).astype("<u2").tobytes())
                    else:
                        counts.append(counts_of(own, np.array([0, len(own)]), _FINE, _FINE).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("keys"), pa.array(counts, pa.binary())], ["node", "keys", "counts"]
                )

    return texts.select("node", "text", "keys").mapInArrow(run, "node binary, keys array<long>, counts binary")


def _unpacked(counts: list[bytes]) -> np.ndarray:
    """Counts by kind, one row per text, of what ``_fine`` keeps."""
    out = np.empty((len(counts), 2 * _FINE), np.uint8)
    for row, kept in zip(out, counts):
        if len(kept) == 2 * _FINE:
            row[:] = np.frombuffer(kept, np.uint8)
        else:
            row[:] = np.minimum(np.bincount(np.frombuffer(kept, "<u2"), minlength=2 * _FINE), 255)
    return out


def _coarser(fine: np.ndarray) -> np.ndarray:
    """The counts of several kinds as one, which bound the distance as well."""
    sides = np.split(fine, 2, axis=1)
    return np.hstack([np.minimum(x.reshape(len(x), -1, n).sum(axis=1), 255).astype(np.uint8) for x, n in zip(sides, (_WORDS, _PAIRS))])


def _narrowed(partners: DataFrame, texts: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Of such members those that finer counts leave similar to others of another class, in the first bucket that the two share.

    Their texts are then needed in few buckets; counts are shorter than texts and are made once for each text.
    """
    members = _rooted(partners, roots)
    split = (
        members.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        .where("lo <> hi")
        .select("key", F.ceil(F.col("n") / _BLOCK).cast("long").alias("blocks"))
    )
    members = materialise(members.join(split, "key").select("key", "node", "root", "n_words", "blocks"), "members")
    keys = members.groupBy("node").agg(F.collect_list("key").alias("keys"))
    fine = dealt(_fine(texts.join(keys, "node")), "fine", "node")
    blocks = (
        members.join(fine, "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        .groupBy("key", "block", "blocks")
        .agg(F.collect_list(F.struct("node", "root", "n_words", "counts", "keys")).alias("members"))
    )

    def side(members: pa.StructArray) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        fine = _unpacked(members.field("counts").to_pylist())
        out = np.zeros(len(members), _MEMBER)
        out["node"] = np.frombuffer(b"".join(members.field("node").to_pylist()), "V16")
        out["root"] = np.frombuffer(b"".join(members.field("root").to_pylist()), ">u8").reshape(-1, 2)
        out["n"], out["counts"] = members.field("n_words").to_numpy(), _coarser(fine)
        return out, fine, [set(k) for k in members.field("keys").to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, bytes], list[int]] = {}
            for row, key in enumerate(batch.column("key").to_pylist()):
                a, a_fine, a_keys = side(batch.column("a")[row].values)
                other = batch.column("b")[row]
                b, b_fine, b_keys = side(other.values) if other.is_valid else (a, a_fine, a_keys)
                i, j = _between(a, b, not other.is_valid, threshold)
                for lo in range(0, len(i), _TESTS // 8):
                    x, y = i[lo : lo + _TESTS // 8], j[lo : lo + _TESTS // 8]
                    limits = _limits(np.maximum(a["n"][x], b["n"][y]), threshold)
                    near = within_counts(a_fine[x], b_fine[y], limits, _FINE)
                    x, y = x[near], y[near]
                    here = np.array([min(a_keys[p] & b_keys[q]) == key for p, q in zip(x.tolist(), y.tolist())], bool)
                    _tally(found, key, a[x[here]], b[y[here]])
            yield from _tallied(found)

    return _summed(_across(blocks).mapInArrow(run, _FOUND))


def _centred(partners: DataFrame, roots: DataFrame) -> DataFrame:
    """Every such member with the one of its bucket that has most partners."""
    members = partners.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    centres = (
        members.groupBy("key")
        .agg(F.max(F.struct("partners", "node", "n_words", "root")).alias("c"))
        .select("key", F.col("c.node").alias("u"), F.col("c.n_words").alias("u_words"), F.col("c.root").alias("u_root"))
    )
    return members.join(centres, "key").where("root <> u_root")


def _side(members: pa.StructArray) -> tuple[np.ndarray, list[np.ndarray], list[set[int]]]:
    """Members of a block with their counts, words and keys."""
    codes, at = tokens(members.field("text"))
    out = np.zeros(len(members), _MEMBER)
    out["node"] = np.frombuffer(b"".join(members.field("node").to_pylist()), "V16")
    out["root"] = np.frombuffer(b"".join(members.field("root").to_pylist()), ">u8").reshape(-1, 2)
    out["n"], out["counts"] = np.diff(at), counts_of(codes, at)
    return out, [codes[lo:hi] for lo, hi in zip(at, at[1:])], [set(k) for k in members.field("keys").to_pylist()]


def _finer(
    a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float
) -> Iterator[tuple[int, int]]:
    """Of the pairs of texts ``a[i]`` and ``b[j]`` those that counters of many more kinds leave similar."""
    counts: dict[tuple[int, int], np.ndarray] = {}

    def of(side: int, texts: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        for k in np.unique(at).tolist():
            if (side, k) not in counts:
                counts[side, k] = counts_of(texts[k], np.array([0, len(texts[k])]), _FINE, _FINE)[0]
        return np.stack([counts[side, k] for k in at.tolist()])

    for lo in range(0, len(i), _TESTS // 8):
        x, y = i[lo : lo + _TESTS // 8], j[lo : lo + _TESTS // 8]
        longest = np.array([max(len(a[k]), len(b[m])) for k, m in zip(x.tolist(), y.tolist())])
        near = within_counts(of(0, a, x), of(1, b, y), _limits(longest, threshold), _FINE)
        yield from zip(x[near].tolist(), y[near].tolist())


def _rest(partners: DataFrame, texts: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) that join all classes which aligning every two such members of a bucket would join.

    Pairs are aligned where their blocks meet, in the first bucket they share, unless links
    found there have joined them already; so only links leave a task, fewer than its members.
    """
    members = partners.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = F.greatest(F.ceil(F.col("n") / _BLOCK), F.ceil(F.col("words") / _BLOCK_WORDS))
    split = (
        members.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        .where("lo <> hi")
        .select("key", parts.cast("long").alias("blocks"))
    )
    members = materialise(members.join(split, "key").select("key", "node", "root", "blocks"), "members")
    keys = members.groupBy("node").agg(F.collect_list("key").alias("keys"))
    blocks = (
        members.join(texts.join(keys, "node"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        .groupBy("key", "block", "blocks")
        .agg(F.collect_list(F.struct("node", "root", "text", "keys")).alias("members"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, bytes], tuple] = {}  # sides of the bucket at hand

        def side(key: int, members: pa.StructArray) -> tuple:
            name = key, members.field("node")[0].as_py()
            if name not in kept:
                if len(kept) >= _KEPT or any(k != key for k, _ in kept):
                    kept.clear()
                kept[name] = _side(members)
            return kept[name]

        for batch in batches:
            for row, key in enumerate(batch.column("key").to_pylist()):
                a, a_words, a_keys = side(key, batch.column("a")[row].values)
                other = batch.column("b")[row]
                b, b_words, b_keys = side(key, other.values) if other.is_valid else (a, a_words, a_keys)
                over: dict[bytes, bytes] = {}

                def top(root: bytes) -> bytes:
                    while root in over:
                        root = over[root]
                    return root

                links = []
                i, j = _between(a, b, not other.is_valid, threshold)
                here = np.array([min(a_keys[x] & b_keys[y]) == key for x, y in zip(i.tolist(), j.tolist())], bool)
                for i, j in _finer(a_words, b_words, i[here], j[here], threshold):
                    x, y = top(a["root"][i].tobytes()), top(b["root"][j].tobytes())
                    limit = _limits(np.array([max(a["n"][i], b["n"][j])]), threshold)
                    if x != y and edit_within([(a_words[i], b_words[j])], limit)[0]:
                        over[y] = x
                        links.append((a["node"][i].tobytes(), b["node"][j].tobytes()))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(end, pa.binary()) for end in zip(*links)], ["u", "v"])

    return _across(blocks).mapInArrow(run, "u binary, v binary")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after further links, which are closed between classes."""
    if links.isEmpty():
        return roots
    named = roots.select("node", F.col("root").alias("of"))
    ends = links.join(named.withColumnsRenamed({"node": "u", "of": "__u"}), "u", "left").join(
        named.withColumnsRenamed({"node": "v", "of": "__v"}), "v", "left"
    )
    merged = components(ends.select(F.coalesce("__u", "u").alias("u"), F.coalesce("__v", "v").alias("v")))
    merged = materialise(merged, "merged")
    moved = named.join(merged.withColumnsRenamed({"node": "of", "root": "to"}), "of", "left")
    fresh = merged.join(named.select("node"), "node", "left_anti").select("node", "root")
    return materialise(moved.select("node", F.coalesce("to", "of").alias("root")).union(fresh), "roots")


def node_of(text: str = "text") -> Column:
    """Identity of a text: its MD5 (null: that of the empty text)."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def classes(docs: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES) -> DataFrame:
    """One row per distinct text: node, root, first_id, class_id, class_rows.

    ``first_id`` is the least doc_id with exactly this text, ``class_id`` that of
    the class, ``class_rows`` the number of documents in it.
    """
    with settings(docs.sparkSession, _BATCHES):
        nodes, roots = _closed(docs, threshold, tables)
    named = nodes.select("node", "first_id", "copies").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_rows"))
    return named.drop("copies").join(ids, "root")


def _closed(docs: DataFrame, threshold: float, tables: int) -> tuple[DataFrame, DataFrame]:
    """The distinct texts, and (node, root) of those with a partner; both stored."""
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", node_of())
    texts = dealt(
        marked.groupBy("node").agg(
            F.first("text").alias("text"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
        ),
        "texts",
        "node",
        compression="zstd",
    )
    nodes = dealt(signatures(texts, tables, threshold), "nodes", "node")
    texts = texts.select("node", "text")
    buckets = dealt(_bucketed(nodes, "keys"), "buckets", "key")
    more = materialise(_bucketed(nodes, "others"), "buckets")

    def links(pairs: DataFrame) -> DataFrame:
        return materialise(aligned(pairs, texts, threshold), "found")

    first = materialise(likely(_close(_led(buckets), threshold), nodes, threshold), "pairs")
    roots = materialise(components(links(first)), "roots")
    buckets = materialise(_apart(buckets, roots), "apart")
    for turn in range(ROUNDS):  # members left apart follow another one
        more_pairs = materialise(likely(_close(_outside(buckets, roots, turn), threshold), nodes, threshold), "pairs")
        roots = _joined(roots, links(more_pairs))
    # whatever is still apart is compared in full
    partners = materialise(_partners(buckets.union(more), nodes, roots, threshold), "partners")
    discard(more)
    if not partners.isEmpty():
        centred = likely(_close(_centred(partners, roots), threshold), nodes, threshold)
        roots = _joined(roots, links(materialise(centred, "pairs")))
        partners = materialise(_narrowed(partners, texts, roots, threshold), "partners")
        roots = _joined(roots, materialise(_rest(partners, texts, roots, threshold), "found"))
    return nodes, roots


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every document with its class: doc_id, class_id, class_rows."""
    found = materialise(classes(docs, threshold), "classes")
    return (
        docs.select("doc_id", node_of().alias("node"))
        .join(found.select("node", "class_id", "class_rows"), "node")
        .select("doc_id", "class_id", "class_rows")
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, all columns as they came: the one with the least doc_id.

    Of several rows with that doc_id and text one stays, chosen by the hash of its columns.
    """
    found = classes(docs, threshold)
    chosen = (
        found.where(F.col("first_id").eqNullSafe(F.col("class_id")))
        .groupBy("root", "class_id")
        .agg(F.min("node").alias("__node"))
        .select("__node", F.col("class_id").alias("__id"))
    )
    rows = docs.withColumn("__of", node_of())
    kept = rows.join(
        chosen, F.col("__of").eqNullSafe(F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    )
    once = Window.partitionBy("__node").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return (
        kept.withColumn("__n", F.row_number().over(once))
        .where("__n = 1")
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
