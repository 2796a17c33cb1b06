"""Merkle manifest, SimHash and collocations against plain Python, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pannier.llm import collocations, merkle, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, fp string, node int, key int, n int, `a.b` int"
LOWER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows):
    """Rows (doc_id, text, lang, source, n_chars) with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, la, s, n, "x", "y", 1, 2, 3, 4) for i, t, la, s, n in rows], SCHEMA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Levels from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_leaf(row, n_chars):
    i, text, lang, source, _ = row
    out = ""
    for v in (i, source, lang, n_chars, text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def plain_audit(rows):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, plain_leaf(row, row[4]), row))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = plain_tree([x[2] for x in groups[name]])
    top = plain_tree([trees[name][-1][0] for name in names]) if names else []
    out = []
    for g, name in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(groups[name]):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None
            now, seen = plain_leaf(row, row[4] + 1) if hit else leaf, ""
            for levels, place in ((trees[name], at), (top, g)):
                for level in levels[:-1]:
                    pair = level[place // 2 * 2 : place // 2 * 2 + 2]
                    seen += "".join(x for k, x in enumerate(pair) if k != place % 2)
                    pair[place % 2] = now
                    now, place = h(*pair), place // 2
            root = top[-1][0]
            out.append((row[0], leaf, trees[name][-1][0], root, h(seen), now, now == root))
    return out


def merkle_rows(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en"] * 12 + ["de", "fr", None, "", "Ünü"])
        text = rng.choice([None, "", "é" * rng.randrange(9), "a" * 50 + str(i)])
        rows.append((rng.choice([i, i, i, None]), text, lang, rng.choice([None, "s1"]), rng.choice([None, i])))
    return rows + rows[:5] * 3


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_merkle_equals_plain_tree(spark, monkeypatch, levels):
    """Blocks of 2 and 4 leaves need many rounds; the trees are the same."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = merkle_rows(14 if levels == 1 else 60)
    got = merkle.audited(frame(spark, rows)).collect()
    assert order(got) == order(plain_audit(rows))
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


def test_merkle_single_rows_and_empty_table(spark):
    for rows in ([(7, "x", "en", None, None)], [(7, "x", "en", "s", 1), (8, None, None, None, 2)]):
        assert order(merkle.audited(frame(spark, rows)).collect()) == order(plain_audit(rows))
    assert merkle.audited(frame(spark, [])).collect() == []


def test_merkle_positions_across_partitions(spark):
    """A hot group spans tasks; its places are consecutive."""
    rows = [(i // 3, "t", "en", None, i // 3) for i in range(3000)]
    got = merkle.audited(frame(spark, rows).repartition(7)).collect()
    assert order(got) == order(plain_audit(rows))


def test_witness_folds_to_root():
    for n in (1, 2, 3, 7, 64, 100):
        tree = merkle.Appender()
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        for x in leaves:
            tree.append(x)
        root = tree.close()
        assert root.hex() == plain_tree([x.hex() for x in leaves])[-1][0]
        for x, sides, siblings in zip(leaves, tree.sides, tree.siblings):
            assert merkle.fold(x, bytes(sides), bytes(siblings)) == root
            assert merkle.fold(b"\0" * 32, bytes(sides), bytes(siblings)) != root


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def prose(rng, n):
    return " ".join(rng.choice(["Ka", "lO", "mi", "ÜN", "straße", "x" * 40, "e"]) + str(rng.randrange(90)) for _ in range(n))


def simhash_rows():
    rng = random.Random(8)
    texts = [None, "", "  \n ", "one", "One  two", "ONE\ttwo\x0bthree", "a" * 700, "ab " * 500, "Ä" * 33 + " é\xa0b c d"]
    for n in (3, 30, 200, 900):
        base = prose(rng, n).split()
        texts.append(" ".join(base))
        for _ in range(12):  # a family around a text
            w = list(base)
            w[rng.randrange(n)] = "changed"
            texts.append("\n".join(w))
            base = w if rng.random() < 0.3 else base
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return rows + [(None, texts[20], None, None, None), (5, texts[9], None, None, None), (None, "alone here now", None, None, None)]


def plain_components(ids, prints, distance):
    over = list(range(len(ids)))

    def top(i):
        while over[i] != i:
            i = over[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                over[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i, x in enumerate(ids):
        groups[top(i)].append(x)
    return [min((x for x in groups[top(i)] if x is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 7])
def test_simhash_equals_all_pairs(spark, distance):
    rows = simhash_rows()
    got = simhash.near_duplicates(frame(spark, rows), distance).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    named = plain_components([r[0] for r in rows], prints, distance)
    assert order(got) == order([(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, named)])


def test_simhash_links_at_exact_distances(spark):
    """Fingerprints laid 0 to 4 bits apart in one and in both segments."""
    rng = random.Random(4)
    prints = []
    for d in range(6):
        for _ in range(30):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), d):
                b ^= 1 << bit
            prints += [a, b]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in set(signed)], "fp long")
    got = {frozenset((r["u"], r["v"])) for r in simhash.links(df).collect()}
    want = {
        frozenset((a, b)) for a in set(signed) for b in set(signed) if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    }
    assert got == want and want


def test_simhash_long_texts_in_parts(monkeypatch):
    rng = random.Random(6)
    texts = [prose(rng, n) for n in (1, 2, 3, 50, 400)] + ["x" * 300, "a\n\n  b   " * 40, "", None]
    want = [plain_fingerprint(t) for t in texts]
    for size in (5, 30, 1000, 10**6):
        monkeypatch.setattr(simhash, "PART_BYTES", size)
        assert simhash.fingerprints(pa.array(texts)).tolist() == want


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def plain_collocations(rows, least, top, longest=5, cover=100):
    f, total, first = collections.Counter(), collections.Counter(), {}
    for i, text, lang, _, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for k in range(len(w) - m + 1):
                    phrase = lang, tuple(w[k : k + m])
                    f[phrase] += 1
                    if i is not None:
                        first[phrase] = min(first.get(phrase, i), i)
    cand = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        score, _, l, r = min(
            (1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
            for k in range(1, len(w))
        )
        inside = lambda x: any(x[j : j + len(w)] == w for j in range(len(x) - len(w) + 1))
        if not any(la == lang and len(x) > len(w) and 100 * b >= cover * a and inside(x) for (la, x), b in cand.items()):
            out[lang].append((-score, -a, " ".join(w).encode(), a, l, r, score, first.get((lang, w))))
    return [
        (lang, k, p.decode(), a, l, r, total[lang], score, doc)
        for lang, found in out.items()
        for k, (_, _, p, a, l, r, score, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)
    ]


def phrase_rows():
    rng = random.Random(2)
    words = ["Der", "die", "das", "ÜBER", "x", "new york", "a b c d e f", "zwei\tdrei", "end.", "so,", "\n", "l\x0bm"]
    rows = [
        (rng.choice([i, None]), " ".join(rng.choice(words) for _ in range(rng.randrange(60))), rng.choice(["de", "en", None, "und", ""]), None, None)
        for i in range(120)
    ]
    return rows + [(200, None, "de", None, None), (201, "", None, None, None), (202, " .,\n", "xx", None, None), *rows[:3]]


@pytest.mark.parametrize("least,top", [(3, 2000), (12, 4)])
def test_collocations_equal_plain_counts(spark, least, top):
    rows = phrase_rows()
    got = collocations.collocations(frame(spark, rows).repartition(3), least=least, top=top).collect()
    assert order(got) == order(plain_collocations(rows, least, top))


def test_collocations_survive_colliding_fingerprints(spark, monkeypatch):
    """With fingerprints of a few bits nearly all phrases collide; counts are by text all the same."""
    rows = phrase_rows()
    grams = collocations.Words.grams

    def weak(self, n, langs, count):
        keys, whole = grams(self, n, langs, count)
        return keys & np.uint64(7), whole

    small = pa.RecordBatch.from_pydict(
        {"doc_id": [r[0] for r in rows], "lang": [r[2] or "und" for r in rows], "text": [r[1] for r in rows]}
    )
    full = np.full(collocations.FILTER_BITS // 64, np.uint64(0xFFFFFFFFFFFFFFFF))
    bits = type("Sent", (), {"value": full})

    def counts():
        out = collections.Counter()
        for batch in collocations._materialise(iter([small]), bits, 5):
            for r in batch.to_pylist():
                out[r["lang"], r["n"], r["phrase"]] += r["f"]
        return out

    want = counts()
    monkeypatch.setattr(collocations.Words, "grams", weak)
    assert counts() == want


def test_collocations_with_a_full_filter(spark, monkeypatch):
    """A filter too small to tell phrases apart lets all pass and loses none."""
    monkeypatch.setattr(collocations, "FILTER_BITS", 128)
    monkeypatch.setattr(collocations, "HELD", 50)
    rows = phrase_rows()
    got = collocations.collocations(frame(spark, rows), least=5).collect()
    assert order(got) == order(plain_collocations(rows, 5, 2000))


def test_collocations_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PART_BYTES", 40)
    rows = phrase_rows()
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": list(range(len(rows))), "lang": [r[2] or "und" for r in rows], "text": [r[1] for r in rows]}
    )
    full = type("Sent", (), {"value": np.full(4, np.uint64(0xFFFFFFFFFFFFFFFF))})
    out = collections.Counter()
    for part in collocations._materialise(iter([batch]), full, 5):
        for r in part.to_pylist():
            out[r["lang"], r["phrase"]] += r["f"]
    want = collections.Counter()
    for _, text, lang, _, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 6):
                for k in range(len(w) - m + 1):
                    want[lang or "und", " ".join(w[k : k + m])] += 1
            want[lang or "und", None] += len(w)
    assert +out == +want


def test_collocations_empty_table(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
