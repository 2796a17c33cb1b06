import random

import pytest
from conftest import items_of, lists_of, queries_of
from pyspark.sql import functions as F

from pannier.operators import numbering as nb
from pannier.operators import threshold, topk
from pannier.recommend import cooccurrence
from pannier.recommend.cooccurrence import CooccurrenceLift, SessionCooccurrence
from pannier.recommend.popular import TopPopular


def test_number_rows_matches_a_sort(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 1, 2]), i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, id long, v int")
    out = nb.number_rows(df, ["g"], -F.col("v"), [F.col("v").desc(), F.col("id")], "n").collect()
    for g in (0, 1, 2):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        got = sorted((r["n"], r["id"]) for r in out if r["g"] == g)
        assert got == [(i + 1, r[1]) for i, r in enumerate(want)]


def test_number_rows_with_limits_keeps_the_head(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    limits = spark.createDataFrame([(0, 10)], "g long, limit long")
    out = nb.number_rows(df, ["g"], F.floor(F.col("id") / 16), [F.col("id")], "n", limits=limits)
    rows = out.collect()
    assert {r["g"] for r in rows} == {0} and len(rows) < 30
    assert {r["n"] for r in rows} >= set(range(1, 11))


def test_popularity_rank_breaks_ties_by_id(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 1, 2, 3])) for i in rng.sample(range(10**6), 500)]
    got = nb.popularity_rank(spark.createDataFrame(rows, "item_id long, freq long")).collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r["item_id"] for r in sorted(got, key=lambda r: r["rank"])] == [r[0] for r in want]


def test_dense_index_has_no_gaps(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    got = [r["n"] for r in nb.dense_index(df.union(df), "k", "n").collect()]
    assert sorted(got) == list(range(df.count()))


@pytest.mark.parametrize("packed", [True, False])
def test_first_unowned(spark, packed):
    rng = random.Random(3)
    n = 400
    owned = {0: [], 1: list(range(1, 301)), 2: rng.sample(range(1, n + 1), 150), 3: [2, 4, 6], 4: [n]}
    lists = spark.range(1, n + 1).select(F.lit(0).alias("list_id"), F.col("id").alias("rank"), F.col("id").alias("item_id"))
    asks = spark.createDataFrame([(q, 0) for q in owned], "query_id long, list_id int")
    own = spark.createDataFrame([(q, i) for q, b in owned.items() for i in b], "query_id long, item_id long")
    sizes = spark.createDataFrame([(q, len(b)) for q, b in owned.items()], "query_id long, size long")
    got = {}
    for r in topk.first_unowned(lists, asks, own, 7, sizes, packed).collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    for q, b in owned.items():
        assert sorted(got[q]) == [i for i in range(1, n + 1) if i not in b][:7]


def assoc_of(baskets, support):
    from test_pairs import brute

    n = len(baskets)
    freq = {}
    for b in baskets:
        for i in set(b):
            freq[i] = freq.get(i, 0) + 1
    out = {}
    for (a, b), c in brute(baskets).items():
        if c >= support:
            s = (c / n) / ((freq[a] / n) * (freq[b] / n))
            out.setdefault(a, {})[b] = s
            out.setdefault(b, {})[a] = s
    return out


def best(scores, k):
    return sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:k]


@pytest.mark.parametrize("first,lists,shared", [(256, 1000, 100_000), (3, 1000, 50), (2, 3, 0)])
def test_session_equals_the_direct_sum_with_one_dominant_profile(spark, monkeypatch, first, lists, shared):
    monkeypatch.setattr(threshold, "FIRST", first)
    monkeypatch.setattr(threshold, "LISTS", lists)
    monkeypatch.setattr(cooccurrence, "SHARED", shared)
    rng = random.Random(11)
    baskets = [rng.sample(range(40), rng.randint(2, 5)) for _ in range(120)]
    past = {1: list(range(0, 35)), 2: [3, 4], 3: []}
    owner = [1] * 20 + [2, 3, None]
    queries = [rng.sample(range(42), rng.randint(1, 4)) for _ in owner]
    # repeated items, in and out of the history, and an empty basket with one
    queries += [[3, 3, 5], [], [7, 7], [38, 38]]
    owner += [2, 2, 1, 1]
    hist = spark.createDataFrame([(p, i) for p, h in past.items() for i in h], "profile_id long, item_id long")
    model = SessionCooccurrence.fit(items_of(spark, baskets), hist, 0.3, 1)
    got = lists_of(model.recommend(queries_of(spark, queries, profiles=owner), 6))
    assoc = assoc_of(baskets, 1)
    for q, basket in enumerate(queries):
        scores = {}
        sources = [(i, 1.0) for i in basket]
        sources += [(i, 0.3) for i in past.get(owner[q], []) if i not in basket]
        for i, w in sources:
            for other, s in assoc.get(i, {}).items():
                if other not in basket:
                    scores[other] = scores.get(other, 0) + w * s
        assert got.get(q, []) == best(scores, 6), q


@pytest.mark.parametrize("first,lists", [(2, 1000), (2, 4)])
def test_cooccurrence_equals_the_direct_sum(spark, first, lists, monkeypatch):
    monkeypatch.setattr(threshold, "FIRST", first)
    monkeypatch.setattr(threshold, "LISTS", lists)
    rng = random.Random(2)
    baskets = [rng.sample(range(30), rng.randint(2, 5)) for _ in range(80)]
    baskets += [[0, i] for i in range(1, 30) for _ in range(2)]  # item 0 is tied to all
    queries = [[1, 2], [5], [29, 5, 5], [999], [0], [0, 0, 3], [0, 4, 7], list(range(25))]
    model = CooccurrenceLift.fit(items_of(spark, baskets), 2, "lift")
    got = lists_of(model.recommend(queries_of(spark, queries), 5))
    assoc = assoc_of(baskets, 2)
    for q, basket in enumerate(queries):
        scores = {}
        for i in basket:  # a repeated item counts twice
            for other, s in assoc.get(i, {}).items():
                if other not in basket:
                    scores[other] = scores.get(other, 0) + s
        assert got.get(q, []) == best(scores, 5)


def test_popular_for_baskets_that_own_the_whole_head(spark):
    baskets = [[i, i + 1] for i in range(0, 60)]
    model = TopPopular.fit(items_of(spark, baskets))
    order = [r["item_id"] for r in model.ranks.orderBy("rank").collect()]
    queries = [[], order[:50], order[5:20], [12345]]
    got = lists_of(model.recommend(queries_of(spark, queries), 5))
    for q, basket in enumerate(queries):
        assert got[q] == [i for i in order if i not in basket][:5]
