"""Context pairs against plain counting; vectors trained block against block."""

from __future__ import annotations

import collections
import os

import numpy as np
import pyarrow as pa
import pytest
from conftest import items_of, queries_of
from pyspark.sql import functions as F

from pannier.config import EmbeddingConfig, FactorConfig, GraphConfig
from pannier.operators import context
from pannier.operators.numbering import place_rows
from pannier.recommend import alternate, blocks, embedding, factors
from pannier.recommend.blocks import BlockConfig, train_blocks
from pannier.recommend.embedding import Item2Vec, ItemGraphNode2Vec
from pannier.recommend.factors import ImplicitBPR

RNG = np.random.default_rng(3)
GROUPS, SIZE = 4, 12
BASKETS = [
    [int(x) for x in RNG.choice(SIZE, 4, replace=False) + SIZE * g] for g in RNG.integers(0, GROUPS, 400)
]


def plain_pairs(lines, window, min_count=1):
    counts = collections.Counter(w for line in lines for w in line)
    out = collections.Counter()
    for line in lines:
        line = [w for w in line if counts[w] >= min_count]
        for a, u in enumerate(line):
            for b in range(max(0, a - window), min(len(line), a + window + 1)):
                if line[b] != u:
                    out[u, line[b]] += 1
    return out


@pytest.fixture(params=[1024, 8])
def chunk(request, monkeypatch):
    monkeypatch.setattr(context, "CHUNK", request.param)
    return request.param


def test_context_pairs_of_long_and_short_baskets(spark, chunk):
    lines = [[3, 1, 2], [5], list(range(60)) + [4, 4, 7] * 9, [1, 2] * 20]
    words = context.basket_words(items_of(spark, lines).repartition(3))
    got = {(r["u"], r["i"]): r["weight"] for r in context.context_pairs(words, 5).collect()}
    assert got == plain_pairs(lines, 5)
    places = {(r["line"], r["at"]): r["word"] for r in words.collect()}
    assert places == {(b, k): w for b, line in enumerate(lines) for k, w in enumerate(line)}


def test_rare_words_go_before_the_window(spark, chunk):
    lines = [["a", "x", "b", "y", "c"] * 6, ["a", "q", "b"], ["z"]]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, words array<string>")
    words = context.frequent_words(context.array_words(df, F.col("id"), "words"), 2)
    got = {(r["u"], r["i"]): r["weight"] for r in context.context_pairs(words, 2).collect()}
    assert got == plain_pairs(lines, 2, 2)


def test_window_beyond_a_chunk_is_refused(spark):
    words = spark.createDataFrame([(1, 0, "a")], "line long, at long, word string")
    with pytest.raises(ValueError):
        context.context_pairs(words, context.CHUNK)


def test_places_over_ranges(spark):
    rows = [(g, k * 3) for g in (1, 1, 2, 7) for k in range(50)]
    got = place_rows(spark.createDataFrame(rows, "g long, k long").repartition(5), ["g"], ["k"], "at").collect()
    for g in (1, 2, 7):
        mine = sorted((r["at"], r["k"]) for r in got if r["g"] == g)
        assert [a for a, _ in mine] == list(range(len(mine)))
        assert [k for _, k in mine] == sorted(k for x, k in rows if x == g)


def vectors(df, name="id"):
    return {r[name]: np.array(r["vec"]) for r in df.collect()}


def purity(found, size=SIZE):
    """Share of each item's nearest that belong to its group."""
    ids = np.array(sorted(found))
    v = np.array([found[i] for i in ids])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T
    np.fill_diagonal(near, -9)
    best = np.argsort(-near, axis=1)[:, :5]
    return (ids[best] // size == (ids // size)[:, None]).mean()


@pytest.mark.parametrize("rows", [1 << 14, 10])
def test_planted_groups_are_found_at_the_defaults(spark, monkeypatch, rows):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", rows)
    found = vectors(Item2Vec.fit(items_of(spark, BASKETS), EmbeddingConfig()).tables["vectors"], "item_id")
    assert len(found) == GROUPS * SIZE and purity(found) > 0.95


def test_planted_groups_are_found_on_the_graph(spark):
    graph = GraphConfig(walk_length=8, num_walks=3)
    found = vectors(ItemGraphNode2Vec.fit(items_of(spark, BASKETS), graph).tables["vectors"], "item_id")
    assert len(found) == GROUPS * SIZE and purity(found) > 0.95


@pytest.mark.parametrize("rows", [1 << 14, 150])
def test_pairwise_factors_learn_which_items_belong_together(spark, monkeypatch, rows):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", rows)
    model = ImplicitBPR.fit(items_of(spark, BASKETS), FactorConfig(factors=16, iterations=60))
    asks = [[0, 1], [SIZE, SIZE + 1], [2 * SIZE + 3]]
    got = collections.defaultdict(list)
    for r in model.recommend(queries_of(spark, asks), 5).collect():
        got[r["query_id"]].append(r["item_id"] // SIZE)
    for q, ask in enumerate(asks):
        assert sum(g == ask[0] // SIZE for g in got[q]) >= 4


def test_vectors_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 10)
    words = context.basket_words(items_of(spark, BASKETS[:80]))
    pairs = context.context_pairs(words, 5)
    cfg = BlockConfig(factors=8, iterations=4)
    one = vectors(train_blocks(pairs, cfg))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        two = vectors(train_blocks(pairs.repartition(13), cfg))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one.keys() == two.keys()
    assert all((one[k] == two[k]).all() for k in one)


def test_every_cell_is_visited_once_a_sweep(spark, monkeypatch):
    """Turns deal each (left, right) block pair exactly once, and no block twice in one turn."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 5)
    n = 7
    seen = [(t, (t + s) % n, s) for s in range(n) for t in range(n)]
    assert len({x[:2] for x in seen}) == n * n
    pairs = spark.createDataFrame([(u, i, 1 + u % 3) for u in range(30) for i in range(30) if (u * i) % 3], "u long, i long, weight long")
    left = blocks._index(pairs.groupBy(F.col("u").alias("id")).agg(F.sum("weight").alias("mass")), "l", n)
    right = blocks._index(pairs.groupBy(F.col("i").alias("id")).agg(F.sum("weight").alias("mass")), "r", n)
    cells = blocks._cells(pairs, left, right, n)
    back = collections.Counter()
    lid = {(r["block"], r["row"]): r["id"] for r in left.collect()}
    rid = {(r["block"], r["row"]): r["id"] for r in right.collect()}
    for c in cells.collect():
        for a, b, w in zip(c["l"], c["r"], c["w"]):
            back[lid[c["t"], a], rid[(c["t"] + c["turn"]) % n, b]] += w
    assert back == {(r["u"], r["i"]): r["weight"] for r in pairs.collect()}


def test_a_step_moves_by_summed_gradients():
    block = blocks.Block("l", 0, np.ones(3, np.float32), None, None, BlockConfig(factors=2))
    before = block.vec.copy()
    g = np.array([[1, 0], [2, 2], [1, 2]], np.float32)
    block.step(np.array([2, 0, 2]), g, 0.5)
    sums = {0: g[1], 2: g[0] + g[2]}
    for row, s in sums.items():
        assert np.allclose(block.vec[row], before[row] + 0.5 * s / np.sqrt((s**2).mean()), atol=1e-5)
    assert (block.vec[1] == before[1]).all()


def test_noise_reaches_blocks_without_pairs():
    cfg = BlockConfig(factors=4, iterations=1)
    visit = blocks._visit(cfg, range(0, 3), 8.0)
    state = pa.table(
        {
            "t": pa.array([0, 0], pa.int32()),
            "side": ["l", "r"],
            "block": pa.array([0, 1], pa.int32()),
            "mass": pa.array([[1.0, 2.0], [1.0, 1.0]], pa.list_(pa.float32())),
            "vec": pa.array([None, None], pa.binary()),
            "sq": pa.array([None, None], pa.binary()),
            "l": pa.array([None, None], pa.list_(pa.int32())),
            "r": pa.array([None, None], pa.list_(pa.int32())),
            "w": pa.array([None, None], pa.list_(pa.float32())),
        }
    )
    out = {r["side"]: np.frombuffer(r["vec"], np.float32).reshape(2, 4) for r in visit(state).to_pylist()}
    fresh = blocks.Block("l", 0, np.ones(2, np.float32), None, None, cfg).vec
    assert not (out["l"] == fresh).all()
    assert (out["l"] @ out["r"].T < 0).all()  # strangers are pushed apart


def test_empty_pairs_and_unknown_loss(spark):
    none = spark.createDataFrame([], "u string, i string, weight long")
    assert train_blocks(none, BlockConfig()).collect() == []
    with pytest.raises(ValueError):
        train_blocks(none, BlockConfig(loss="other"))


def test_text_vectors_are_means_of_word_vectors(spark, monkeypatch):
    texts = [(1, "red red fish"), (2, "blue fish swims"), (3, ""), (4, None), (5, "red bird")]
    df = spark.createDataFrame(texts, "item_id long, description string")
    cfg = EmbeddingConfig(vector_size=6, min_count=1, epochs=3)
    from pannier.functions import scalar

    lines = df.where("length(description) > 0").select("item_id", scalar.words(F.col("description")).alias("words"))
    words = context.array_words(lines, F.col("item_id"), "words")
    known = vectors(embedding.word_vectors(words, cfg), "word")
    got = vectors(embedding.text_vectors(df, cfg), "item_id")
    lists = {r["item_id"]: r["words"] for r in lines.collect()}
    assert set(got) == {1, 2, 5}
    for i, x in got.items():
        mean = np.mean([known[w] for w in lists[i] if w in known], axis=0)
        assert np.allclose(x, mean / np.linalg.norm(mean), atol=1e-5)


def test_pairs_alone_do_not_multiply_the_turns():
    """A turn moves every vector: sixty times as many pairs of few vectors need no more turns."""
    assert blocks.blocks_for(1_000, 450_000) == 6
    assert blocks.blocks_for(1_000, 27_000_000) == blocks.blocks_for(1_000, 160_000_000) == blocks.CELL_BLOCKS
    assert blocks.blocks_for(6_750_000, 27_000_000) < 30
    assert blocks.blocks_for(10**9, 10**9) == blocks.MOST_BLOCKS


def test_a_fit_keeps_one_state_on_disk(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 10)
    monkeypatch.setattr(blocks, "CUT_TURNS", 2)
    kept = blocks.materialise
    stored = []

    def noted(df, name, *by):
        out = kept(df, name, *by)
        if name == "blocks":
            stored.append(out.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://"))
        return out

    monkeypatch.setattr(blocks, "materialise", noted)
    pairs = spark.createDataFrame([(u, i, 1) for u in range(40) for i in range(3)], "u long, i long, weight long")
    assert train_blocks(pairs, BlockConfig(factors=4, iterations=4)).count() == 3
    assert len(stored) > 4 and [os.path.exists(s) for s in stored] == [False] * (len(stored) - 1) + [True]


def test_als_drops_the_shuffle_files_of_each_iteration(spark, monkeypatch):
    seen = {}
    real = factors.ALS
    monkeypatch.setattr(factors, "ALS", lambda **kw: seen.update(kw) or real(**kw))
    model = factors.ImplicitALS.fit(items_of(spark, BASKETS[:40]), FactorConfig(factors=4, iterations=3))
    assert seen["checkpointInterval"] == 1 and model.tables["vectors"].count() > 0


def test_a_pass_equals_the_plain_formula():
    """Pairwise and skip-gram steps against sums written out; rows that repeat in a step get all their gradients."""
    rng = np.random.default_rng(8)
    l, r = rng.integers(0, 6, 40), rng.integers(0, 5, 40)  # noqa: E741
    cfg = BlockConfig(factors=3, regularization=0.1, loss="bpr")

    def fresh(side, n):
        return blocks.Block(side, 0, np.arange(1, n + 1, dtype=np.float32), None, None, cfg)

    def moved(x, rows, grads):
        sums = np.zeros(x.vec.shape)
        np.add.at(sums, rows, grads)
        square = (sums**2).mean(axis=1, keepdims=True)
        return x.vec + cfg.learning_rate * sums / np.sqrt(square + 1e-8)

    a, b = fresh("l", 6), fresh("r", 5)
    codes = np.sort(l * 5 + r)
    draw = np.random.default_rng(1)
    order, j = draw.permutation(40), draw.integers(0, 5, 40)
    u, i = l[order], r[order]
    free = ~np.isin(u * 5 + j, codes)
    u, i, j = u[free], i[free], j[free]
    x, seen, other = a.vec[u].astype(float), b.vec[i].astype(float), b.vec[j].astype(float)
    g = 1 / (1 + np.exp((x * (seen - other)).sum(axis=1)))[:, None]
    left = moved(a, u, g * (seen - other) - 0.1 * x)
    right = moved(b, np.concatenate([i, j]), np.concatenate([g * x - 0.1 * seen, -g * x - 0.1 * other]))
    blocks._bpr_pass(a, b, l, r, None, codes, np.random.default_rng(1), cfg)
    assert np.allclose(a.vec, left, atol=1e-5) and np.allclose(b.vec, right, atol=1e-5)

    a, b = fresh("l", 6), fresh("r", 5)
    w = rng.random(40).astype(np.float32)
    draw = np.random.default_rng(2)
    order = draw.permutation(40)
    u, i = l[order], r[order]
    mass, noise = np.cumsum(a.mass, dtype=float), np.cumsum(b.mass**0.75, dtype=float)
    n = np.searchsorted(mass, draw.random(blocks.STEP_PAIRS) * mass[-1], "right")
    m = np.searchsorted(noise, draw.random(blocks.SHARED_NOISE) * noise[-1], "right")
    each = blocks.NOISE * mass[-1] * noise[-1] / 30 / (blocks.STEP_PAIRS * blocks.SHARED_NOISE)
    x, y, p, q = (t.astype(float) for t in (a.vec[u], b.vec[i], a.vec[n], b.vec[m]))
    g = (w[order] / (1 + np.exp((x * y).sum(axis=1))))[:, None]
    away = -each / (1 + np.exp(-p @ q.T))
    left = moved(a, np.concatenate([u, n]), np.concatenate([g * y, away @ q]))
    right = moved(b, np.concatenate([i, m]), np.concatenate([g * x, away.T @ p]))
    blocks._skipgram_pass(a, b, l, r, w, 30.0, np.random.default_rng(2), cfg)
    assert np.allclose(a.vec, left, atol=1e-4) and np.allclose(b.vec, right, atol=1e-4)


def test_a_steps_gradients_are_left_as_they_were():
    block = blocks.Block("l", 0, np.ones(3, np.float32), None, None, BlockConfig(factors=2))
    g = np.ones((3, 2), np.float32)
    for rows in ([0, 1, 2], [1, 1, 0]):
        block.step(np.array(rows), g, 0.5)
        assert (g == 1).all()


def test_rows_of_few_and_many_ratings_solve_their_equations():
    rng = np.random.default_rng(9)
    y = rng.normal(size=(60, 4)).astype(np.float32)
    own = np.concatenate([np.zeros(2, int), np.full(3, 3), np.ones(54, int), [3]])
    gram = y.T.astype(float) @ y
    x = alternate.solve(own, y, 5, gram, 2.0, 0.3)
    for row in (0, 1, 3):
        part = y[own == row].astype(float)
        left = gram + 2.0 * part.T @ part + 0.3 * len(part) * np.eye(4)
        assert np.allclose(x[row], np.linalg.solve(left, 3.0 * part.sum(axis=0)), atol=1e-6)
    assert np.isnan(x[[2, 4]]).all()


@pytest.mark.parametrize("few", [1 << 15, 60])
def test_als_equals_sparks(spark, monkeypatch, few):
    """Same vectors as Spark's ALS, in one block and in many; rows that come twice count twice."""
    monkeypatch.setattr(alternate, "FEW_RATINGS", few)
    baskets = [*BASKETS[:120], [0] * 3, list(range(40))]
    items = items_of(spark, baskets)
    cfg = FactorConfig(factors=5, iterations=4, alpha=2.0)
    index = factors.dense_index(items, "item_id", "item").selectExpr("item_id", "cast(item as int) as item")
    users = factors.dense_index(items, "order_id", "user").selectExpr("order_id", "cast(user as int) as user")
    ratings = items.join(users, "order_id").join(index, "item_id").selectExpr("user", "item", "cast(1 as float) as rating")
    sparks = factors.ALS(rank=5, maxIter=4, regParam=0.01, alpha=2.0, implicitPrefs=True, seed=42).fit(ratings)
    want = vectors(sparks.itemFactors.join(index, sparks.itemFactors.id == index.item).selectExpr("item_id", "features as vec"), "item_id")
    got = vectors(factors.ImplicitALS.fit(items, cfg).tables["vectors"], "item_id")
    assert got.keys() == want.keys()
    assert all(np.allclose(got[i], want[i], atol=1e-5) for i in want)
