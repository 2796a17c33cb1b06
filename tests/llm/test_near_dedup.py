"""op9 against brute force on families that one leader does not settle."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa

from pannier.llm import components, near_dedup
from pannier.llm.words import mix, occurrences, shingles, words


def distance(a: list[str], b: list[str]) -> int:
    """Word edit distance by the whole table, row by row."""
    b_ = np.array(b)
    row = np.arange(len(b) + 1)
    for k, word in enumerate(a, 1):
        step = np.concatenate([[k], np.minimum(row[:-1] + (b_ != word), row[1:] + 1)])
        row = np.minimum.accumulate(step - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(row[-1])


def similar(a: list[str], b: list[str]) -> bool:
    return distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9


def edited(rng: random.Random, base: list[str], n: int) -> list[str]:
    out = list(base)
    for k, at in enumerate(rng.sample(range(len(base)), n)):
        out[at] = f"new{rng.randrange(10**9)}x{k}"
    return out


def partition(texts: list[list[str]], linked) -> set[frozenset[int]]:
    over = list(range(len(texts)))

    def top(i: int) -> int:
        while over[i] != i:
            i = over[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if top(i) != top(j) and linked(i, j):
            over[top(j)] = top(i)
    classes: dict[int, set[int]] = {}
    for i in range(len(texts)):
        classes.setdefault(top(i), set()).add(i)
    return {frozenset(c) for c in classes.values()}


def found(spark, texts: list[list[str]]) -> set[frozenset[int]]:
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    classes: dict[int, set[int]] = {}
    for r in near_dedup.near_duplicates(rows).collect():
        classes.setdefault(r["class_id"], set()).add(r["doc_id"])
    return {frozenset(c) for c in classes.values()}


def keys_of(texts: list[list[str]]) -> list[set[int]]:
    codes, at = words(pa.array([" ".join(t) for t in texts]))
    values, offsets = shingles(codes, at, near_dedup.SHINGLE)
    times = occurrences(values, offsets).astype(np.uint64)
    return [set(r) for r in near_dedup.order_minhash(mix(values + times * np.uint64(0x2545F4914F6CDD1D)), offsets).tolist()]


def hubs() -> list[list[str]]:
    rng = random.Random(11)
    texts = []
    for size in (200, 40):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        texts += [base] + [edited(rng, base, 24) for _ in range(size)]
    return texts


def test_hub_families_equal_brute_force_in_buckets(spark):
    texts = hubs()
    keys = keys_of(texts)
    want = partition(texts, lambda i, j: bool(keys[i] & keys[j]) and similar(texts[i], texts[j]))
    got = found(spark, texts)
    assert max(map(len, want)) > 190  # the versions hang together by their base alone
    whole = {i: c for c in got for i in c}
    assert all(c <= whole[min(c)] for c in want)


def test_components_equal_plain_closure(spark):
    rng = random.Random(2)
    links = [(bytes([a]), bytes([b])) for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(50))]
    rows = spark.createDataFrame(links, "u binary, v binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in components.components(rows).collect()}
    want = {n: n for link in links if link[0] != link[1] for n in link}
    for _ in links:
        for u, v in links:
            if u != v:
                want[u] = want[v] = min(want[u], want[v])
    assert got == want


def scattered(rng: random.Random, n: int, share: float) -> tuple[list[str], list[str]]:
    base = [f"w{rng.randrange(3000)}" for _ in range(n)]
    return base, edited(rng, base, int(share * n + 1e-9))


def test_short_texts_and_scattered_edits_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [["red", "big", word, "dogs", "run"] for word in ("old", "new", "shy")]
    texts += [["one", "old", "man", "sat"], ["one", "old", "man", "sat", "down"]]
    for n in (*range(5, 41), *([300] * 20)):
        for share in (0.2, 0.18):
            texts += scattered(rng, n, share)
    want = partition(texts, lambda i, j: similar(texts[i], texts[j]))
    assert sum(len(c) > 1 for c in want) > 90
    assert found(spark, texts) == want


def test_prefix_keys_meet_for_every_similar_pair():
    rng = random.Random(4)
    for n in range(5, 41):
        for _ in range(30):
            base = [f"w{rng.randrange(9)}" for _ in range(n)]
            other = list(base)
            for _ in range(n // 5):
                at = rng.randrange(len(other))
                other[at : at + rng.randrange(2)] = [f"v{rng.randrange(9)}"] * rng.randrange(2)
            if len(other) <= near_dedup.BRIEF and similar(base, other):
                keys, ends = near_dedup.second_keys(*words(pa.array([" ".join(base), " ".join(other)])))
                a, b = keys[: ends[1]], keys[ends[1] :]
                assert set(a[near_dedup.SINGLES :]) & set(b[near_dedup.SINGLES :]) or base == other


def test_texts_without_words_are_compared_by_their_characters(spark):
    texts = ["!!! ???", "--- *** ---", "\U0001f600\U0001f601", "", " \t ", "!!! ???", "a b", "! ! ! ? ? ?"]
    assert found(spark, [t.split(" ") for t in texts]) == {
        frozenset(c) for c in ({0, 5, 7}, {1}, {2}, {3, 4}, {6})
    }


def test_counts_never_rule_out_a_similar_pair():
    rng = random.Random(5)
    for n in (5, 12, 40, 300, 1500):
        pairs = [scattered(rng, n, share) for share in (0.0, 0.1, 0.2, 0.2)]
        pairs += [(base, base[n // 6 :]) for base, _ in pairs] + [([f"x{rng.random()}" for _ in base], base) for base, _ in pairs]
        limits = np.array([int(0.2 * max(map(len, p)) + 1e-9) for p in pairs])
        counted = [
            near_dedup.counts_of(*near_dedup.tokens(pa.array([" ".join(p[side]) for p in pairs]))) for side in (0, 1)
        ]
        passed = near_dedup.within_counts(*counted, limits)
        assert all(ok for ok, pair in zip(passed, pairs) if similar(*pair))
        assert not passed[-4:].any()


def test_members_left_apart_leave_a_task_once_not_by_pairs(spark, monkeypatch):
    rng = random.Random(12)
    chunks = [[f"w{rng.randrange(3000)}" for _ in range(5)] for _ in range(24)]
    texts = [sum(rng.sample(chunks, len(chunks)), []) for _ in range(150)]  # same words and few other word pairs, another order
    texts += [edited(rng, texts[7], 20), edited(rng, texts[90], 20)]
    monkeypatch.setattr(near_dedup, "_BLOCK", 16)
    stored = []
    keep = near_dedup.materialise

    def counted(df, name, *by):
        out = keep(df, name, *by)
        stored.append((name, out.count()))
        return out

    monkeypatch.setattr(near_dedup, "materialise", counted)
    got = found(spark, texts)
    assert {c for c in got if len(c) > 1} == {frozenset({7, 150}), frozenset({90, 151})}
    assert max(n for name, n in stored if "buckets" not in name) < len(texts) * (near_dedup.TABLES + near_dedup.SINGLES)


def test_texts_and_keys_are_shuffled_once(spark):
    rows = spark.createDataFrame([(bytes([i]) * 16, f"one two three {i}", 4, [7, i % 3]) for i in range(9)], "node binary, text string, n_words long, keys array<long>")
    nodes = near_dedup.dealt(rows, "test_nodes", "node")
    pairs = spark.createDataFrame([(bytes([1]) * 16, bytes([2]) * 16)], "u binary, v binary")
    with near_dedup.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        plan = near_dedup.aligned(pairs, nodes)._jdf.queryExecution().executedPlan().toString()
        buckets = near_dedup._bucketed(nodes, "keys")
        keyed = buckets._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # pairs to the first text, then to the second one
    assert "ReusedExchange" in keyed
    assert {tuple(r) for r in buckets.select("key", "n_words").collect()} == {(7, 4), (0, 4), (1, 4), (2, 4)}
    assert buckets.count() == 18


def test_finer_counts_narrow_members_to_the_first_bucket_they_share(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    texts = [base, edited(rng, base, 200), *([f"v{rng.randrange(10**6)}" for _ in range(1500)] for _ in range(4))]
    node = [bytes([i]) * 16 for i in range(len(texts))]
    stored = near_dedup.dealt(
        spark.createDataFrame([(n, " ".join(t)) for n, t in zip(node, texts)], "node binary, text string"), "test_texts", "node"
    )
    partners = spark.createDataFrame(
        [(key, n, 1500, 5) for key in (3, 9) for n in node], "key long, node binary, n_words long, partners long"
    )
    none = spark.createDataFrame([], "node binary, root binary")
    kept = near_dedup._narrowed(partners, stored, none, 0.8).collect()
    assert {(r["key"], bytes(r["node"]), r["partners"]) for r in kept} == {(3, node[0], 1), (3, node[1], 1)}


def test_packed_counts_are_the_counts():
    words_ = np.random.default_rng(3).integers(0, 1 << 63, 300, dtype=np.uint64)
    codes = mix(np.concatenate([words_, words_[:1].repeat(400)]))
    at = np.array([0, len(codes)])
    kinds = near_dedup._kinds(codes, near_dedup._FINE).astype("<u2")
    fine = near_dedup._unpacked([kinds.tobytes()])
    assert (fine[:, : near_dedup._FINE] == near_dedup.counts_of(codes, at, near_dedup._FINE, near_dedup._FINE)[:, : near_dedup._FINE]).all()
    assert near_dedup._coarser(fine).shape == (1, near_dedup._BINS)
