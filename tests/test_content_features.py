import math

import numpy as np
import pytest
from conftest import TOY, queries_of
from pyspark.sql import functions as F

from pannier.config import TextConfig
from pannier.functions.scalar import STOPWORDS, ngrams, parse_mixed, strip_tags, words
from pannier.operators import content, features
from pannier.operators.pairs import item_counts


def one(spark, expr, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(expr.alias("x")).first()["x"]


def test_words_and_ngrams(spark):
    text = "Свежая рыба, и соус к_рыбе: a bc 42"
    plain = one(spark, words(F.col("c0")), text)
    assert plain == ["свежая", "рыба", "соус", "к_рыбе", "bc", "42"]
    kept = one(spark, words(F.col("c0"), STOPWORDS), "что-то из рыбы")
    assert kept == ["рыбы"]
    grams = one(spark, ngrams(F.split("c0", " "), 1, 3), "a b c")
    assert grams == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, ngrams(F.split("c0", " "), 2, 2), "a") == []
    assert len(STOPWORDS) == 55


def test_strip_tags(spark):
    assert one(spark, strip_tags(F.col("c0")), " <p>Hello <b>big</b>\n</p>  ") == "Hello big"
    assert one(spark, strip_tags(F.col("c0")), None) == ""


@pytest.mark.parametrize(
    "text", ["2025-03-01 10:20:30", "2025-03-01T10:20:30", "01.03.2025 10:20:30", "2025-03-01 10:20:30.000"]
)
def test_mixed_timestamps(spark, text):
    got = one(spark, F.date_format(parse_mixed(F.col("c0")), "yyyy-MM-dd HH:mm:ss"), text)
    assert got == "2025-03-01 10:20:30"
    assert one(spark, parse_mixed(F.col("c0")), "soon") is None


def tables(spark, texts, **kw):
    cfg = TextConfig(**{"ngram_range": (1, 1), "use_stopwords": False, **kw})
    df = spark.createDataFrame(list(enumerate(texts)), "item_id long, description string")
    df = content.with_text(df)
    counts = content.term_counts(df, cfg)
    vocab = content.vocabulary(counts, cfg.max_features)
    return content.tfidf(counts, vocab, content.text_count(df), cfg.sublinear_tf), vocab


def test_tfidf_by_hand(spark):
    weights, _ = tables(spark, ["aa bb aa", "bb cc", ""])
    got = {(r["item_id"], r["term"]): r["weight"] for r in weights.collect()}
    a = (1 + math.log(2)) * (math.log(3 / 2) + 1)
    b = 1.0 * (math.log(3 / 3) + 1)
    assert got[0, "aa"] == pytest.approx(a / math.hypot(a, b))
    assert got[0, "bb"] == pytest.approx(b / math.hypot(a, b))


def test_vocabulary_is_cut_by_count_then_term(spark):
    _, vocab = tables(spark, ["bb aa cc", "bb"], max_features=2)
    assert {r["term"] for r in vocab.collect()} == {"aa", "bb"}


def test_only_terms_of_the_vocabulary_are_counted_by_text(spark):
    cfg = TextConfig(max_features=3, use_stopwords=False)
    rows = [(1, "aa bb aa bb"), (2, "bb cc"), (2, "bb aa bb"), (3, "dd"), (4, "")]
    texts = content.with_text(spark.createDataFrame(rows, "item_id long, description string"))
    counts, vocab = content.text_tables(texts, cfg)
    whole = content.term_counts(texts, cfg)
    want = content.vocabulary(whole, cfg.max_features)
    assert sorted(vocab.collect()) == sorted(want.collect())
    kept = whole.join(want.select("term"), "term").select("item_id", "term", "n")
    assert sorted(counts.collect()) == sorted(kept.collect()) and counts.count() < whole.count()


def test_similarities(spark):
    weights, _ = tables(spark, ["aa bb", "aa", "cc", "bb dd"])
    q = queries_of(spark, [[0, 1]])
    pool = spark.createDataFrame([(0, 2), (0, 3)], "query_id long, item_id long")
    got = {r["item_id"]: r["text"] for r in content.text_similarity(q.items, pool, weights).collect()}
    assert set(got) == {3} and 0 < got[3] < 1
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [2.0, 2.0]), (2, [0.0, 0.0])], "item_id long, vec array<float>")
    dense = {r["item_id"]: r["text"] for r in content.dense_similarity(q.items, pool, vectors).collect()}
    assert dense[3] == pytest.approx(1.0) and dense[2] == 0.0


def test_encoder_is_pluggable_and_normalised(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, "abcd")], "item_id long, description string")
    got = {r["item_id"]: r["vec"] for r in content.encode_texts(df, make, "q: ", 1).collect()}
    assert set(got) == {1, 3}
    assert got[1] == pytest.approx(np.array([5, 1]) / math.hypot(5, 1), abs=1e-6)


def test_user_features(spark, toy, catalog):
    hist = spark.createDataFrame([(7, 3), (7, 4), (7, 5)], "profile_id long, item_id long")
    q = queries_of(spark, [[1, 2], [1, 2], [3, 9999]], profiles=[7, None, 7])
    rows = {
        r["query_id"]: r.asDict()
        for r in features.user_features(q.cases, q.items, item_counts(toy), catalog, hist).collect()
    }
    first = rows[0]
    assert (first["basket_size"], first["history_length"], first["history_unique_items"]) == (2, 3, 3)
    assert first["repeat_ratio"] == 0 and first["category_overlap"] == 0
    assert (first["avg_item_popularity"], first["max_item_popularity"], first["min_item_popularity"]) == (4, 6, 2)
    assert rows[1]["history_length"] == 0 and rows[1]["repeat_ratio"] == 0
    last = rows[2]
    assert last["min_item_popularity"] == 0 and last["repeat_ratio"] == 0.5
    assert last["category_overlap"] == 1 and last["category_overlap_ratio"] == 0.5
    assert last["n_unique_categories"] == 2 and last["dominant_category_ratio"] == 0.5


def test_item_features(spark, toy, catalog):
    rows = {r["item_id"]: r for r in features.item_features(toy, catalog).collect()}
    assert len(rows) == 10
    one_ = rows[5]
    assert one_["item_popularity"] == 6 and one_["item_popularity_log"] == pytest.approx(math.log1p(6))
    assert one_["item_popularity_rank"] == 1 and one_["item_popularity_rank"] < rows[10]["item_popularity_rank"]
    assert one_["cooccurrence_diversity"] == len({i for b in TOY if 5 in b for i in b} - {5})
    assert one_["avg_basket_size"] == pytest.approx(np.mean([len(b) for b in TOY if 5 in b]))
    assert rows[10]["has_description"] == 0 and rows[4]["category_size"] == 3


def test_candidates_get_missing_ranks_and_the_held_out_item(spark):
    recs = "query_id long, rank int, item_id long"
    a = spark.createDataFrame([(0, 1, 5), (0, 2, 6)], recs)
    b = spark.createDataFrame([(0, 1, 6)], recs)
    wide = features.candidate_scores([("a", a), ("b", b)], 9)
    cases = spark.createDataFrame([(0, 8), (1, 5)], "query_id long, held_out long")
    rows = {r["item_id"]: r for r in features.label_candidates(wide, cases, ["a", "b"], 9).collect()}
    assert (rows[5]["score_a"], rows[5]["rank_a"], rows[5]["score_b"], rows[5]["rank_b"]) == (1.0, 0.0, 0.0, 9.0)
    assert (rows[6]["score_a"], rows[6]["rank_a"]) == (0.5, 1.0)
    assert rows[8]["label"] == 1 and rows[8]["rank_a"] == 9.0 and rows[5]["label"] == 0
    assert {r["query_id"] for r in rows.values()} == {0}  # a query without candidates is left out
