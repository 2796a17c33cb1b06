"""Sums over ranked lists against plain addition; how much of the lists is read."""

from __future__ import annotations

import collections
import math
import random

import pytest

from pannier.operators import threshold
from pannier.recommend import cooccurrence


def lists_table(spark, lists):
    rows = [(0, i, item, float(s)) for i, entries in lists.items() for item, s in entries.items()]
    return threshold.list_blocks(spark.createDataFrame(rows, "kind int, list_id long, item_id long, score double")).cache()


def plain(lists, asks, owned, k):
    out = {}
    for q, wanted in asks.items():
        sums = collections.defaultdict(float)
        for i, w in wanted.items():
            for item, s in lists.get(i, {}).items():
                sums[item] += w * s
        free = [(-round(s, 9), item) for item, s in sums.items() if item not in owned.get(q, ())]
        out[q] = [item for _, item in sorted(free)[:k]]
    return {q: items for q, items in out.items() if items}


def run(spark, lists, asks, owned, k, log=None):
    blocks = lists_table(spark, lists)
    rows = [(q, 0, i, float(w)) for q, wanted in asks.items() for i, w in wanted.items()]
    a = spark.createDataFrame(rows, "query_id long, kind int, list_id long, weight double")
    o = spark.createDataFrame([(q, i) for q, items in owned.items() for i in items], "query_id long, item_id long")
    got = collections.defaultdict(list)
    for r in threshold.best_sums(a, o, blocks, k, log).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["item_id"])
    return dict(got)


def skewed(rng, n_lists, n_items):
    """Lists whose scores fall fast, ties among them."""
    return {
        i: {item: round(10 / (1 + place) ** rng.choice([0.3, 1.5]), 2) + 0.01 for place, item in enumerate(rng.sample(range(n_items), n_items))}
        for i in range(n_lists)
    }


@pytest.mark.parametrize("first", [5, 256])
def test_best_sums_equal_plain_addition(spark, monkeypatch, first):
    monkeypatch.setattr(threshold, "FIRST", first)
    monkeypatch.setattr(threshold, "DOUBLED", 2)
    rng = random.Random(first)
    lists = skewed(rng, 12, 90)
    lists[20] = {i: 1.0 for i in range(90)}  # all tied
    lists[21] = {5: 3.0}
    asks = {q: {i: rng.choice([0.3, 1, 2]) for i in rng.sample([*range(12), 20, 21, 99], rng.randint(1, 6))} for q in range(40)}
    owned = {q: rng.sample(range(90), rng.randint(0, 30)) for q in range(40)}
    asks[50], owned[50] = {99: 1.0}, [1]  # an unknown list
    owned[60] = [1, 2]  # asks for nothing
    log = []
    assert run(spark, lists, asks, owned, 5, log) == plain(lists, asks, owned, 5)
    assert first == 256 or any("c" in states for _, states in log)


def test_rounds_and_blocks_that_are_read(spark, monkeypatch):
    """A steep list settles its queries in the first block; a flat one is read to the end, and only by its own."""
    monkeypatch.setattr(threshold, "FIRST", 8)
    steep = {i: 1000.0 / 2**i + i * 1e-6 for i in range(200)}
    flat = {i: 1.0 for i in range(200)}
    lists = {1: steep, 2: flat}
    asks = {q: {1: 1.0} for q in range(5)} | {10: {2: 1.0}}
    log = []
    got = run(spark, lists, asks, {}, 3, log)
    assert got == plain(lists, asks, {}, 3)
    assert log[0] == (0, {"c": 5, "m": 1})
    assert all(sum(states.values()) == 1 for _, states in log[1:])
    assert len(log) == 1 + math.ceil(math.log2(200 / 8 + 1)) - 1
    read = sum(min(200, threshold.read_upto(r)) * sum(s.values()) for r, s in log)
    assert read < 2 * 200 + 6 * 8 + 200  # not 6 x 200 for the first five


def test_too_long_a_prefix_is_summed_by_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(threshold, "FIRST", 4)
    monkeypatch.setattr(threshold, "READ", 10)
    rng = random.Random(1)
    lists = {i: {j: 1.0 + (i * j) % 3 / 100 for j in range(60)} for i in range(5)}
    asks = {q: {i: 1.0 for i in rng.sample(range(5), 3)} for q in range(9)}
    owned = {q: rng.sample(range(60), 4) for q in range(9)}
    log = []
    assert run(spark, lists, asks, owned, 4, log) == plain(lists, asks, owned, 4)
    assert len(log) == 1 and log[0][1]["m"] > 0


def test_a_task_sums_in_pieces(spark, monkeypatch):
    """Queries that begin in one piece and end in the next are summed once."""
    monkeypatch.setattr(threshold, "SUMMED", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(4)
        lists = skewed(rng, 9, 40)
        asks = {q: {i: 1.0 for i in rng.sample(range(9), 7)} for q in range(30)}
        owned = {q: rng.sample(range(40), 5) for q in range(30)}
        assert run(spark, lists, asks, owned, 6) == plain(lists, asks, owned, 6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("long", [10, 10_000])
def test_lists_are_ranked_in_one_row_or_over_tasks(spark, monkeypatch, long):
    monkeypatch.setattr(threshold, "LONG", long)
    monkeypatch.setattr(threshold, "FIRST", 8)
    rng = random.Random(3)
    lists = {1: {i: float(rng.randint(1, 5)) for i in range(100)}, 2: {7: 1.0, 3: 1.0}}
    blocks = lists_table(spark, lists)
    for i, scores in lists.items():
        mine = blocks.where(f"list_id = {i}").orderBy("block").collect()
        order = sorted(scores, key=lambda x: (-scores[x], x))
        assert [item for b in mine for item in b["ids"]] == order
        assert [b["next"] for b in mine] == [scores[c["ids"][0]] for c in mine[1:]] + [None]
    single = threshold.entries_of(blocks).collect()
    assert {(r["list_id"], r["item_id"]): r["score"] for r in single} == {(i, j): s for i, e in lists.items() for j, s in e.items()}


def test_blocks_cover_a_list_in_order(spark, monkeypatch):
    monkeypatch.setattr(threshold, "FIRST", 2)
    monkeypatch.setattr(threshold, "DOUBLED", 2)
    blocks = lists_table(spark, {1: {i: 100.0 - i for i in range(31)}})
    rows = blocks.orderBy("block").collect()
    assert [len(r["ids"]) for r in rows] == [2, 4, 8, 8, 8, 1]
    assert [i for r in rows for i in r["ids"]] == list(range(31))
    assert [r["next"] for r in rows] == [98.0, 94.0, 86.0, 78.0, 70.0, None]
    assert [threshold.read_upto(r) for r in range(5)] == [2, 6, 14, 22, 30]


def test_no_asks_give_nothing(spark):
    assert run(spark, {1: {1: 1.0}}, {}, {}, 3) == {}


def test_lists_known_to_be_short_are_cut_in_one_reading(spark, monkeypatch):
    """No table of lengths is made, and the blocks are those of lists of unknown length."""
    stored = []
    kept = threshold.materialise
    monkeypatch.setattr(threshold, "materialise", lambda df, name, *by: stored.append(name) or kept(df, name, *by))
    monkeypatch.setattr(threshold, "FIRST", 4)
    rows = [(0, i, j, 1.0 + (i * j) % 5) for i in range(6) for j in range(30)]
    entries = spark.createDataFrame(rows, "kind int, list_id long, item_id long, score double")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    short = key(threshold.list_blocks(entries, 30))
    assert not stored
    assert short == key(threshold.list_blocks(entries))
    monkeypatch.setattr(threshold, "LONG", 20)
    assert short == key(threshold.list_blocks(entries, 30)) and stored


@pytest.mark.parametrize("baskets, most", [([[1, 2, 3], [1, 4], [5, 6]], 3), ([], 0)])
def test_partners_have_a_bound(spark, baskets, most):
    from conftest import items_of

    assert cooccurrence._most_partners(items_of(spark, baskets), "order_id") == most
