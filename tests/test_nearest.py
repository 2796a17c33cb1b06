"""Nearest items by cells against comparing all with all, and the cells that are skipped."""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
import pytest

from pannier.operators import nearest as near
from pannier.operators.topk import top_k


def tables(spark, q, v, want):
    wants = want if isinstance(want, list) else [want] * len(q)
    queries = spark.createDataFrame(
        [(i, x.tolist(), w) for i, (x, w) in enumerate(zip(q, wants))], "query_id long, vec array<double>, want long"
    )
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vec array<double>")
    return queries, items


def lists(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append(r["item_id"])
    return out


def plain(q, v, k, metric):
    s = q @ v.T
    if metric == "cosine":
        norm = lambda m: np.where((n := np.linalg.norm(m, axis=1)) > 0, n, 1)
        s = s / norm(q)[:, None] / norm(v)
    s = np.round(s, 9)
    return {i: sorted(range(len(v)), key=lambda j: (-s[i, j], j))[:k] for i in range(len(q))}


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_cells_equal_all_pairs(spark, metric):
    rng = np.random.default_rng(0)
    q, v = rng.normal(size=(30, 6)), rng.normal(size=(90, 6))
    v[7], v[20], q[3] = v[8], 0, 0  # a tie, a zero item and a zero query
    log = []
    queries, items = tables(spark, q, v, 4)
    got = lists(top_k(near.nearest(queries, items, metric, block_rows=16, log=log), 4))
    assert got == plain(q, v, 4, metric)
    assert log[0] == 30 and sum(log) <= 30 * 6


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_far_cells_are_skipped(spark, metric):
    """Tight groups of items: a query visits few of the cells, and finds what all pairs find."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 12))
    v = np.concatenate([c + rng.normal(size=(25, 12)) * 0.01 for c in centres])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    q = centres[rng.integers(0, 8, 40)] + rng.normal(size=(40, 12)) * 0.01
    log = []
    queries, items = tables(spark, q, v, 3)
    got = lists(top_k(near.nearest(queries, items, metric, block_rows=10, log=log), 3))
    assert got == plain(q, v, 3, metric)
    cells = 20
    assert sum(log) < 40 * cells / 2  # of all (query, cell) pairs


def test_large_cells_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "CELLS", 3)
    rng = np.random.default_rng(2)
    q, v = rng.normal(size=(12, 4)), rng.normal(size=(80, 4))
    queries, items = tables(spark, q, v, 5)
    assert lists(top_k(near.nearest(queries, items, "dot", block_rows=7), 5)) == plain(q, v, 5, "dot")


def test_more_wanted_than_a_cell_or_the_table_has(spark):
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(4, 3)), rng.normal(size=(20, 3))
    queries, items = tables(spark, q, v, [1, 12, 20, 50])
    got = lists(top_k(near.nearest(queries, items, "cosine", block_rows=5), 50))
    want = plain(q, v, 50, "cosine")
    for i, n in enumerate([1, 12, 20, 50]):
        assert got[i][:n] == want[i][:n] and len(got[i]) >= min(n, 20)


def test_one_cell_is_one_round(spark):
    rng = np.random.default_rng(4)
    q, v = rng.normal(size=(5, 3)), rng.normal(size=(9, 3))
    log = []
    queries, items = tables(spark, q, v, 2)
    assert lists(top_k(near.nearest(queries, items, "dot", log=log), 2)) == plain(q, v, 2, "dot")
    assert log == [5]
    assert near.nearest(queries, items.limit(0), "dot").collect() == []


def products(q, v, want, last=None):
    last = np.full(len(q), np.nan) if last is None else last
    out = collections.defaultdict(list)
    for i, j, s in zip(*near._search(q, v, np.arange(len(v)), np.asarray(want), last)):
        assert np.isclose(s, q[i] @ v[j], rtol=1e-12, atol=1e-12)
        out[i].append(j)
    return out


@pytest.mark.parametrize("tiles", [(256, 2048, 1 << 18), (3, 4, 5)])
@pytest.mark.parametrize("size", [1e-6, 1.0, 1e3])
def test_screened_products_equal_all_products(monkeypatch, tiles, size):
    for name, n in zip(("_QUERIES", "_ITEMS", "_WAITING"), tiles):
        monkeypatch.setattr(near, name, n)
    rng = np.random.default_rng(6)
    q, v = rng.normal(size=(17, 5)), rng.normal(size=(300, 5)) * rng.choice([0.1, 1, 3], (300, 1)) * size
    v[50:90], v[100:140] = v[3], 0  # many equal items, many zero items
    want = rng.integers(0, 9, 17)
    want[2] = 400
    got, all_ = products(q, v, want), plain(q, v, 400, "dot")
    assert all(got[i] == all_[i][: want[i]] for i in range(17))


def test_a_block_returns_only_what_reaches_the_last_item_wanted():
    rng = np.random.default_rng(7)
    q, v = rng.normal(size=(20, 6)), rng.normal(size=(200, 6))
    s = q @ v.T
    last = np.sort(s, axis=1)[:, -3]
    got = products(q, v, np.full(20, 8), last)
    assert all(got[i] == plain(q, v, 3, "dot")[i] for i in range(20))
    assert not products(q, v, np.full(20, 8), s.max(axis=1) + 1)


def test_missing_and_unequal_vectors_are_refused():
    for wrong in ([[1.0, 2.0], None], [[1.0], [1.0, 2.0, 3.0]]):
        with pytest.raises(ValueError):
            near._rows(pa.array(wrong, pa.list_(pa.float64())))
    assert near._rows(pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32()))).tolist() == [[1, 2], [3, 4]]
