import numpy as np
import pytest
from conftest import lists_of, queries_of
from pyspark.sql import functions as F

from pannier.config import BoostConfig
from pannier.operators import evaluate as ev
from pannier.operators import sampling, tune
from pannier.operators.pairs import item_counts
from pannier.plans import reports
from pannier.recommend.boost import ContentBoost, blend
from pannier.recommend.cooccurrence import CooccurrenceLift
from pannier.operators.topk import top_k
from pannier.schema import METRICS, RECS


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_metrics_are_bounded_and_ordered(toy, toy_queries):
    recs = CooccurrenceLift.fit(toy, 1).recommend(toy_queries, 20)
    n = item_counts(toy).agg(F.count("*"))
    got = values(ev.evaluate(toy_queries.cases, recs, n, "m", "test"))
    assert 0 <= got["hit@5"] <= got["hit@10"] <= got["hit@20"] <= 1
    assert got["mrr"] <= got["hit@20"] and 0 < got["coverage"] <= 1


def test_exact_rates(spark):
    cases = spark.createDataFrame([(0, 7), (1, 7), (2, 7)], "query_id long, held_out long")
    recs = spark.createDataFrame([(0, 1, 7, 1.0), (1, 1, 8, 1.0), (1, 2, 7, 0.5)], RECS)
    got = values(ev.evaluate(cases, recs, spark.sql("select 4L"), "m", "test", (1, 5)))
    assert got == pytest.approx({"hit@1": 1 / 3, "hit@5": 2 / 3, "mrr": 0.5, "coverage": 0.5})


def test_empty_input_gives_zeros(spark):
    cases = spark.createDataFrame([], "query_id long, held_out long")
    got = values(ev.evaluate(cases, spark.createDataFrame([], RECS), spark.sql("select 0L"), "m", "test"))
    assert set(got.values()) == {0.0} and len(got) == 5


def test_buckets_follow_interpolated_percentiles(spark):
    rng = np.random.default_rng(4)
    freq = rng.integers(1, 30, 101)
    counts = spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq)], "item_id long, freq long")
    limits = np.percentile(freq, np.linspace(0, 100, 4))
    (row,) = ev.bucket_thresholds(counts, 3).collect()
    assert row["thresholds"] == pytest.approx(list(limits))
    for r in ev.item_buckets(counts, 3).collect():
        assert r["bucket"] == next(b for b in range(3) if r["freq"] <= limits[b + 1] or b == 2)
    assert [(r["lo"], r["hi"]) for r in ev.bucket_ranges(counts, 3).orderBy("bucket").collect()] == [
        (pytest.approx(limits[i]), pytest.approx(limits[i + 1])) for i in range(3)
    ]


def test_debiased_is_the_mean_of_non_empty_buckets(spark):
    cases = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 99)], "query_id long, held_out long")
    recs = spark.createDataFrame([(0, 1, 1, 1.0), (2, 1, 2, 1.0), (3, 2, 99, 1.0)], RECS)
    buckets = spark.createDataFrame([(1, 0), (2, 4)], "item_id long, bucket int")
    rows = {(r["scope"], r["bucket"], r["metric"]): r["value"] for r in ev.debiased(cases, recs, buckets, "m", "test").collect()}
    assert rows["bucket", 0, "hit@5"] == 0.5 and rows["bucket", 4, "hit@5"] == 1.0
    assert rows["debiased", None, "hit@5"] == 0.75 and rows["micro", None, "hit@5"] == 0.75
    assert rows["micro", None, "mrr"] == pytest.approx(2.5 / 4)
    assert not [k for k in rows if k[1] == -1]


def test_stratified_cases(spark):
    cases = spark.createDataFrame([(q, q % 7) for q in range(70)], "query_id long, held_out long")
    buckets = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 2)], "item_id long, bucket int")
    out = sampling.stratified_cases(cases, buckets)
    assert {r["bucket"]: r["count"] for r in out.groupBy("bucket").count().collect()} == {0: 10, 1: 10, 2: 10, -1: 10}
    assert out.select("query_id").distinct().count() == 40
    assert sampling.stratified_cases(cases, buckets, 3).count() == 19


def test_samples(spark):
    cases = spark.range(50).withColumnRenamed("id", "query_id")
    assert sampling.sample_cases(cases, 0, 1).count() == 50
    assert sampling.sample_cases(cases, 99, 1).count() == 50
    a = {r[0] for r in sampling.sample_cases(cases, 20, 1).collect()}
    b = {r[0] for r in sampling.sample_cases(cases.repartition(5), 20, 1).collect()}
    assert a == b and len(a) == 20
    assert sampling.train_val_split(cases, 0.3, 1).where("is_val").count() == 15
    assert sampling.train_val_split(cases.limit(2), 0.1, 1).where("is_val").count() == 1


def test_grid_equals_ranking_each_point(toy, catalog, toy_queries):
    model = ContentBoost.fit(toy, catalog, BoostConfig(min_support=1))
    parts = model.pool_parts(toy_queries, 25).cache()
    grid = tune.weight_grid((0.2, 0.6, 0.9), (0.1, 0.3))
    assert len(grid) == 4  # 1 - 0.9 - 0.1 falls just below 0
    held = {r["query_id"]: r["held_out"] for r in toy_queries.cases.collect()}
    got = {r["grid_idx"]: r["hit"] for r in tune.grid_hits(toy_queries.cases, parts, grid, 2).collect()}
    for i, w in enumerate(grid):
        lists = lists_of(top_k(blend(parts, w), 2))
        assert got[i] == pytest.approx(sum(held[q] in lists.get(q, []) for q in held) / len(held))
    best = max(got, key=lambda i: (got[i], -i))
    assert tune.best_weights(tune.grid_hits(toy_queries.cases, parts, grid, 2)) == pytest.approx(grid[best])


@pytest.fixture(scope="module")
def metrics(spark):
    sample = {
        "TopPopular": ((0.15, 0.25, 0.35, 0.10), (0.12, 0.20, 0.30, 0.08), 1.0),
        "CooccurrenceLift": ((0.10, 0.18, 0.28, 0.07), (0.09, 0.16, 0.25, 0.06), 5.0),
    }
    rows = []
    for model, (test, oot, seconds) in sample.items():
        for split, numbers in (("test", test), ("oot", oot)):
            rows += [(model, split, "micro", None, m, v) for m, v in zip(reports.METRICS, numbers)]
        rows.append((model, "train", "run", None, "train_time_s", seconds))
    return spark.createDataFrame(rows, METRICS).cache()


def test_report_tables(metrics):
    table = {r["model"]: r for r in reports.summary(metrics).collect()}
    assert table["TopPopular"]["test_hit5"] == 0.15 and table["CooccurrenceLift"]["train_time_s"] == 5.0
    (gain,) = reports.improvement(metrics).collect()
    assert gain["model"] == "CooccurrenceLift" and gain["test_hit5"] == pytest.approx(-100 / 3)
    loss = {r["model"]: r for r in reports.degradation(metrics).collect()}
    assert loss["TopPopular"]["hit5"] == pytest.approx(20.0)
    assert {r["model"]: (r["test"], r["oot"]) for r in reports.test_vs_oot(metrics, "mrr").collect()}["TopPopular"] == (0.10, 0.08)
    assert reports.hits_by_model(metrics, "oot").columns == ["model", "oot_hit5", "oot_hit10", "oot_hit20"]
    assert reports.quality_table(metrics).count() == 2 and reports.debiased_summary(metrics).count() == 0


def test_missing_baseline_warns_and_is_empty(metrics):
    with pytest.warns(UserWarning, match="Nobody"):
        assert reports.improvement(metrics, "Nobody").count() == 0


def test_member_choice(spark, metrics):
    weights = spark.createDataFrame([("TopPopular", 1.0), ("CooccurrenceLift", 1.2), ("Absent", 1.0)], "model string, weight double")
    assert {r["model"] for r in ev.ensemble_members(metrics, weights, 0.02).collect()} == {"TopPopular", "CooccurrenceLift"}
    assert {r["model"] for r in ev.ensemble_members(metrics, weights, 0.12).collect()} == {"TopPopular"}
    assert ev.ranker_members(metrics).count() == 2


def test_titles_fall_back_to_the_id(spark, toy):
    titles = spark.createDataFrame([(3, "three")], "item_id long, title string")
    model = CooccurrenceLift.fit(toy, 1)
    baskets = spark.createDataFrame([(0, 1), (0, 2)], "query_id long, item_id long")
    names = {r["item_id"]: r["title"] for r in reports.infer(model, baskets, titles, 9).collect()}
    assert names[3] == "three" and names[4] == "Item #4"
    q = queries_of(spark, [[1, 2]])
    both = reports.compare_models([("a", model.recommend(q, 3)), ("b", model.recommend(q, 2))], titles)
    assert both.count() == 3 and both.where("b is null").count() == 1
