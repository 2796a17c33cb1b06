"""A pair store advanced by batches equals mining everything at once."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest

from pannier.operators import pairs as pr
from pannier.streaming.pairs import PairStore

SCHEMA = "order_id long, item_id long"


def counted(rows):
    baskets = {}
    for o, i in rows:
        if o is not None and i is not None:
            baskets.setdefault(o, set()).add(i)
    out = Counter()
    for b in baskets.values():
        out.update(combinations(sorted(b), 2))
    return dict(out)


def as_dict(df):
    return {(r["item_a"], r["item_b"]): r["pair_count"] for r in df.collect()}


def test_batches_add_up_to_the_whole(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(25), rng.randrange(15)) for _ in range(150)] + [(None, 3), (3, None)]
    store = PairStore(spark, str(tmp_path / "store"))
    assert as_dict(store.pairs()) == {}
    seen = []
    for k in range(4):  # lines of an order arrive in several batches, some twice
        batch = rows[k * 38 : (k + 1) * 38] + rng.sample(rows, 10)
        seen += batch
        store.add(spark.createDataFrame(batch, SCHEMA), k)
        if k in (0, 3):
            assert as_dict(store.pairs()) == counted(seen)
    whole = spark.createDataFrame(sorted({r for r in seen if None not in r}), SCHEMA)
    want = pr.association_table(whole, pr.item_counts(whole), pr.basket_total(whole), "npmi", 2).collect()
    got = store.associations("npmi", 2).collect()
    key = lambda r: (r["item_id"], r["other_id"], r["pair_count"])
    assert sorted(map(key, got)) == sorted(map(key, want))
    scores = {key(r): r["score"] for r in want}
    assert all(r["score"] == pytest.approx(scores[key(r)]) for r in got)


def test_a_repeated_batch_counts_once(spark, tmp_path):
    store = PairStore(spark, str(tmp_path / "store"))
    first = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], SCHEMA)
    second = spark.createDataFrame([(1, 3), (2, 5)], SCHEMA)
    for batch, k in ((first, 0), (second, 1), (second, 1)):
        store.add(batch, k)
    assert as_dict(store.pairs()) == {(1, 2): 1, (1, 3): 1, (2, 3): 1}
    store.add(spark.createDataFrame([], SCHEMA), 2)
    assert as_dict(store.pairs(2)) == {}
    assert store.items().count() == 4
