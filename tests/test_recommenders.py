import math

import numpy as np
import pytest
from conftest import TOY, items_of, lists_of, queries_of

from pannier.config import BoostConfig, EmbeddingConfig, FactorConfig, GraphConfig, RankerConfig
from pannier.operators import nearest as near
from pannier.operators import walks
from pannier.recommend import factors, ranker
from pannier.recommend.boost import ContentBoost, DenseBoost
from pannier.recommend.cooccurrence import CooccurrenceLift
from pannier.recommend.embedding import Item2Vec, ItemGraphNode2Vec, graph_edges
from pannier.recommend.factors import ImplicitALS, ImplicitBPR
from pannier.recommend.fusion import EnsembleRRF, PopularityRerank
from pannier.recommend.popular import TopPopular
from pannier.recommend.ranker import LambdaRanker
from pannier.session import settings

BASKETS = [[2, 9], [5, 4], [7, 3]]
SMALL = EmbeddingConfig(vector_size=8, min_count=1, epochs=2)


@pytest.fixture(scope="module")
def pop(toy):
    return TopPopular.fit(toy)


@pytest.fixture(scope="module")
def cooc(toy):
    return CooccurrenceLift.fit(toy, 1, "lift")


def sane(lists, k, baskets=BASKETS):
    for q, items in lists.items():
        assert len(items) <= k and len(set(items)) == len(items)
        assert not set(items) & set(baskets[q])


def test_every_model_proposes_only_new_items(toy, catalog, toy_queries, pop, cooc):
    models = [
        pop,
        cooc,
        Item2Vec.fit(toy, SMALL),
        ImplicitALS.fit(toy, FactorConfig(factors=4, iterations=2)),
        ImplicitBPR.fit(toy, FactorConfig(factors=4, iterations=1)),
        ItemGraphNode2Vec.fit(toy, GraphConfig(1, 5, 2, SMALL)),
        ContentBoost.fit(toy, catalog, BoostConfig(min_support=1)),
        PopularityRerank.fit(cooc, toy),
        EnsembleRRF.of([(pop, 1.0), (cooc, 1.2)]),
    ]
    for model in models:
        lists = lists_of(model.recommend(toy_queries, 5))
        assert lists, model.name
        sane(lists, 5)


def test_unknown_items_give_nothing_but_the_popular(spark, toy, pop, cooc):
    q = queries_of(spark, [[9999]])
    assert lists_of(cooc.recommend(q, 5)) == {}
    assert len(lists_of(pop.recommend(q, 5))[0]) == 5
    assert lists_of(Item2Vec.fit(toy, SMALL).recommend(q, 5)) == {}


def test_vectors_of_too_rare_items_are_an_empty_model(toy, toy_queries):
    model = Item2Vec.fit(toy, EmbeddingConfig(vector_size=8, min_count=99))
    assert lists_of(model.recommend(toy_queries, 5)) == {}


def test_without_catalog_only_associations_count(toy, toy_queries):
    cfg = BoostConfig(score_metric="lift", min_support=1)
    plain = lists_of(CooccurrenceLift.fit(toy, 1).recommend(toy_queries, 5))
    for kind in (ContentBoost, DenseBoost):
        model = kind.fit(toy, None, cfg=cfg)
        assert lists_of(model.recommend(toy_queries, 5)) == plain


def test_dense_boost_prefers_the_similar_vector(spark, toy, catalog, toy_queries):
    vecs = [(i, [1.0, 0.0] if i in (2, 9, 10) else [0.0, 1.0]) for i in range(1, 11)]
    vectors = spark.createDataFrame(vecs, "item_id long, vec array<float>")
    model = DenseBoost.fit(toy, catalog.fillna("x").replace("", "x"), vectors, BoostConfig(0.0, 0.0, 1.0, 1, "lift"))
    assert lists_of(model.recommend(toy_queries, 5))[0][0] == 10


def test_pool_size_is_explicit(toy, catalog, toy_queries):
    model = ContentBoost.fit(toy, catalog, BoostConfig(min_support=1))
    assert model.recommend(toy_queries, 5, pool_size=2).groupBy("query_id").count().agg({"count": "max"}).first()[0] == 2


def test_rerank_and_fusion_scores(toy, toy_queries, pop, cooc):
    freq = {r["item_id"]: r["freq"] for r in pop.ranks.collect()}
    base = lists_of(cooc.recommend(toy_queries, 50))
    score = {(r["query_id"], r["item_id"]): r["score"] for r in PopularityRerank.fit(cooc, toy).recommend(toy_queries, 5).collect()}
    for (q, i), s in score.items():
        assert s == pytest.approx(1 / (base[q].index(i) + 1) + 0.2 * math.log1p(freq[i]))
    p, c = lists_of(pop.recommend(toy_queries, 30)), lists_of(cooc.recommend(toy_queries, 30))
    fused = EnsembleRRF.of([(pop, 1.0), (cooc, 1.2)]).recommend(toy_queries, 5)
    for r in fused.collect():
        want = sum(w / (l[r["query_id"]].index(r["item_id"]) + 1)
                   for w, l in ((1.0, p), (1.2, c)) if r["item_id"] in l.get(r["query_id"], []))
        assert r["score"] == pytest.approx(want)


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_nearest_blocks_equal_brute_force(spark, metric):
    rng = np.random.default_rng(0)
    q, v = rng.normal(size=(30, 6)), rng.normal(size=(50, 6))
    v[7] = v[8]  # a tie
    queries = spark.createDataFrame([(i, x.tolist(), 4) for i, x in enumerate(q)], "query_id long, vec array<double>, want long")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vec array<double>")
    s = q @ v.T
    if metric == "cosine":
        s = s / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(v, axis=1)
    s = np.round(s, 9)
    from pannier.operators.topk import top_k

    got = lists_of(top_k(near.nearest(queries, items, metric, block_rows=16), 4))
    for i in range(30):
        assert got[i] == sorted(range(50), key=lambda j: (-s[i, j], j))[:4]
    with pytest.raises(ValueError):
        near.nearest(queries, items, "manhattan")


def paths(log):
    out = {}
    for r in log.collect():
        out.setdefault((r["start"], r["walk"]), {})[r["step"]] = r["node"]
    return {w: [nodes[k] for k in sorted(nodes)] for w, nodes in out.items()}


def test_walks_follow_edges_by_weight(spark, toy):
    edges = graph_edges(toy, 2).cache()
    allowed = {(r["src"], r["dst"]) for r in edges.collect()}
    out = paths(walks.random_walks(edges, 6, 3, 42))
    starts = {a for a, _ in allowed}
    assert set(out) == {(a, w) for a in starts for w in (1, 2, 3)}
    for (start, _), nodes in out.items():
        assert nodes[0] == start and len(nodes) == 6
        assert all(step in allowed for step in zip(nodes, nodes[1:]))
    assert paths(walks.random_walks(edges.repartition(5), 6, 3, 42)) == out


def test_steps_move_walks_and_not_the_graph(spark, toy, monkeypatch):
    plans = []

    def seen(df, name, plain=walks.materialise):
        if name == "walk_log":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(walks, "materialise", seen)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        walks.random_walks(graph_edges(toy, 2), 4, 2, 42)
    assert [p.count("Exchange hashpartitioning") for p in plans[1:]] == [1, 1, 1]


def test_walk_frequencies_match_weights(spark):
    edges = spark.createDataFrame(
        [(0, 1, 6), (0, 2, 3), (0, 3, 3), (1, 0, 6), (2, 0, 3), (3, 0, 3)], "src long, dst long, weight long"
    )
    rows = walks.random_walks(edges, 2, 4000, 1).where("start = 0 and step = 1").collect()
    share = np.bincount([r["node"] for r in rows], minlength=4) / len(rows)
    assert np.allclose(share[1:], [0.5, 0.25, 0.25], atol=0.03)


def test_every_draw_falls_to_one_share(spark):
    """A hub of many light neighbours and one heavy one: slots hold the neighbour that plain running sums give."""
    weights = {j: 1 + (j % 5 == 0) * 2 for j in range(1, 60)} | {60: 500}
    rows = [(0, j, w) for j, w in weights.items()] + [(j, 0, w) for j, w in weights.items()]
    edges = spark.createDataFrame(rows, "src long, dst long, weight long").cache()
    slots = {r["slot"]: r["shares"] for r in walks.weight_slots(edges).where("src = 0").collect()}
    total = sum(weights.values())
    width = math.ceil(total / len(weights))
    order = [j for j in sorted(weights) for _ in range(weights[j])]
    for u in range(total):
        shares = slots[u // width]
        assert len(shares) <= width + 1
        assert next(s["dst"] for s in shares if s["upto"] > u) == order[u]


def test_large_query_folds_in_like_a_small_one(spark, toy, monkeypatch):
    model = ImplicitALS.fit(toy, FactorConfig(factors=4, iterations=3))
    q = queries_of(spark, [[1, 2, 3, 4, 5], [1, 2]])
    plain = {r["query_id"]: r["vec"] for r in model.fold_in(q).collect()}
    monkeypatch.setattr(factors, "FOLD_ITEMS", 3)
    monkeypatch.setattr(factors, "PART_ITEMS", 2)
    parts = {r["query_id"]: r["vec"] for r in model.fold_in(q).collect()}
    for k, x in plain.items():
        assert np.allclose(x, parts[k], atol=1e-8)
    y = np.array([r["vec"] for r in model.tables["vectors"].where("item_id in (1, 2)").collect()])
    allv = np.array([r["vec"] for r in model.tables["vectors"].collect()])
    want = np.linalg.solve(allv.T @ allv + y.T @ y + 0.01 * 2 * np.eye(4), 2 * y.sum(axis=0))
    assert np.allclose(plain[1], want, atol=1e-6)


def test_ranker_falls_back_then_learns(spark, toy, catalog, toy_queries, pop, cooc):
    cfg = RankerConfig(n_candidates=10, rounds=3, min_rows_per_leaf=1, max_depth=2)
    model = LambdaRanker.of({"TopPopular": pop, "CooccurrenceLift": cooc}, toy, catalog, None, cfg)
    assert lists_of(model.recommend(toy_queries, 5)) == lists_of(pop.recommend(toy_queries, 5))
    model.fit(toy_queries)
    assert len(model.params["trees"]) == 3
    sane(lists_of(model.recommend(toy_queries, 5)), 5)
    gains = model.importance().collect()
    assert len(gains) == len(model.feature_names) and gains[0]["gain"] > 0


def test_no_round_of_the_ranker_shuffles_its_rows(spark, toy, catalog, toy_queries, pop, cooc, monkeypatch):
    monkeypatch.setattr(ranker, "CUT_EVERY", 2)
    plans = []

    def seen(rows, plain=ranker.lambda_gradients):
        out = plain(rows)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(ranker, "lambda_gradients", seen)
    cfg = RankerConfig(n_candidates=10, rounds=5, min_rows_per_leaf=1, max_depth=2)
    LambdaRanker.of({"TopPopular": pop, "CooccurrenceLift": cooc}, toy, catalog, None, cfg).fit(toy_queries)
    assert len(plans) == 5
    assert not any("Exchange" in p for p in plans)


def test_lambda_gradient_of_one_group(spark):
    from pannier.recommend.ranker import lambda_gradients

    rows = spark.createDataFrame(
        [(0, 1, 0, 0.5), (0, 2, 1, 0.2), (0, 3, 0, 0.0)], "query_id long, item_id long, label int, score double"
    )
    got = {r["item_id"]: (r["g"], r["h"]) for r in lambda_gradients(rows).collect()}
    gs = hs = 0.0
    for item, score, rank in ((1, 0.5, 1), (3, 0.0, 3)):
        rho = 1 / (1 + math.exp(0.2 - score))
        swap = abs(1 / math.log2(3) - 1 / math.log2(1 + rank))
        assert got[item] == pytest.approx((-swap * rho, swap * rho * (1 - rho)))
        gs, hs = gs + swap * rho, hs + swap * rho * (1 - rho)
    assert got[2] == pytest.approx((gs, hs))


def test_base_needed(toy):
    with pytest.raises(ValueError):
        LambdaRanker().recommend(None)


def test_counts_of_toy(toy):
    assert toy.select("order_id").distinct().count() == len(TOY)
