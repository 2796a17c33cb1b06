import math
import random
from collections import Counter
from itertools import combinations

import pytest
from conftest import TOY, items_of

from pannier.operators import pairs as pr


def brute(baskets):
    c = Counter()
    for b in baskets:
        c.update(combinations(sorted(set(b)), 2))
    return c


def as_dict(df):
    return {(r["item_a"], r["item_b"]): r["pair_count"] for r in df.collect()}


def test_toy_values(spark, toy):
    counts = pr.item_counts(toy)
    assert {r["item_id"]: r["freq"] for r in counts.collect()} == {
        1: 2, 2: 6, 3: 3, 4: 2, 5: 6, 6: 2, 7: 3, 8: 1, 9: 4, 10: 2
    }
    got = as_dict(pr.pair_counts(toy))
    assert got == dict(brute(TOY))
    assert got[2, 5] == 4 and got[5, 9] == 3 and got[3, 7] == 2
    total = pr.basket_total(toy)
    for metric, want in (("lift", 0.4 / 0.36), ("pmi", math.log2(0.4 / 0.36)), ("npmi", -math.log2(0.4 / 0.36) / math.log2(0.4))):
        table = pr.association_table(toy, counts, total, metric, 1)
        rows = {(r["item_id"], r["other_id"]): r["score"] for r in table.collect()}
        assert rows[2, 5] == pytest.approx(want) and rows[5, 2] == rows[2, 5]
        assert all(v > 0 and rows[b, a] == v for (a, b), v in rows.items())


def test_unknown_metric(spark, toy):
    with pytest.raises(ValueError, match="cosine"):
        pr.association_table(toy, pr.item_counts(toy), pr.basket_total(toy), "cosine")


def test_pair_in_every_basket_has_no_npmi(spark):
    items = items_of(spark, [[1, 2], [1, 2]])
    table = pr.association_table(items, pr.item_counts(items), pr.basket_total(items), "npmi", 1)
    assert table.count() == 0


@pytest.mark.parametrize("support", [1, 2, 3])
@pytest.mark.parametrize("large", [3, 10, 1000])
def test_large_baskets_take_an_exact_route(spark, support, large, monkeypatch):
    monkeypatch.setattr(pr, "PAIR_BLOCK", 8)
    rng = random.Random(support * 100 + large)
    baskets = [rng.sample(range(60), rng.randint(1, 6)) for _ in range(60)]
    baskets.append(list(range(55)))  # one basket with a large share of all rows
    baskets.append(rng.sample(range(80), 40))
    want = {p: c for p, c in brute(baskets).items() if c >= support}
    got = as_dict(pr.pair_counts(items_of(spark, baskets), min_support=support, large=large))
    assert got == want


@pytest.mark.parametrize("large", [3, 20, 1000])
def test_partner_counts(spark, large, monkeypatch):
    monkeypatch.setattr(pr, "PAIR_BLOCK", 8)
    rng = random.Random(large)
    baskets = [rng.sample(range(70), rng.randint(1, 6)) for _ in range(50)]
    baskets += [list(range(50)), rng.sample(range(40, 90), 30), [95]]
    want = {}
    for b in baskets:
        for i in b:
            want.setdefault(i, set()).update(b)
    got = {r["item_id"]: r["partners"] for r in pr.partner_counts(items_of(spark, baskets), large=large).collect()}
    assert got == {i: len(s) - 1 for i, s in want.items() if len(s) > 1}
    stored = pr.pair_counts(items_of(spark, baskets), large=large)
    assert {r["item_id"]: r["partners"] for r in pr.pair_partners(stored).collect()} == got


def test_sizes_are_counted_when_missing(spark, toy):
    assert as_dict(pr.pair_counts(toy.drop("size"), min_support=2)) == {
        p: c for p, c in brute(TOY).items() if c >= 2
    }


def test_category_affinity(spark, toy, catalog):
    rows = {
        (r["cat_a"], r["cat_b"]): r["affinity"]
        for r in pr.category_affinity(toy, catalog, pr.basket_total(toy)).collect()
    }
    assert rows["Сыры", "Сыры"] == 1.5
    # 6 baskets with item 2, 6 with item 5, 4 with both, of 10
    assert rows["Сыры", "Хлеб"] == pytest.approx(0.4 / 0.36)
    assert all(rows[b, a] == v for (a, b), v in rows.items())
