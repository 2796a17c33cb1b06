from datetime import datetime, timedelta

import pytest
from conftest import TOY, items_of, lists_of
from pyspark.sql import functions as F

from pannier.config import (
    BoostConfig,
    DataConfig,
    EmbeddingConfig,
    FactorConfig,
    GraphConfig,
    RankerConfig,
    TrainConfig,
)
from pannier.operators import baskets as bk
from pannier.operators.pairs import pair_counts
from pannier.plans import training
from pannier.recommend.cooccurrence import CooccurrenceLift
from pannier.recommend.fusion import EnsembleRRF, PopularityRerank
from pannier.recommend.popular import TopPopular
from pannier.recommend.ranker import LambdaRanker
from pannier.schema import CATALOG, ORDER_LINES
from pannier.sources import csv, snapshot
from pannier.streaming.baskets import append_partial_baskets, merged_baskets, score_stream

HEADER = "created_at;profile_id;order_oms_id;order_item_oms_id;order_item_title;order_status_title;price"
OK = "Заказ доставлен"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_lines(spark, tmp_path):
    rows = [
        f"2025-01-02 10:00:00;5;1;11.0;Сыр;{OK};1",
        f"02.01.2025 09:30;5;1;12;Хлеб;{OK};1",
        f"2025-01-02;;2;;Ничего;{OK};1",
        "2025-01-03;6;3;13;Соль;Отменён;1",
    ]
    path = write(tmp_path / "orders.csv", "\n".join([HEADER, *rows]))
    lines = csv.read_order_lines(spark, path, DataConfig(separator=";"))
    good = bk.successful(lines, DataConfig().success_statuses)
    items = bk.order_items(good)
    got = [(r["item_id"]) for r in items.where("order_id = 1").orderBy("pos").collect()]
    assert got == [11, 12]
    head = {r["order_id"]: r for r in bk.order_headers(items).collect()}
    assert head[1]["order_ts"] == datetime(2025, 1, 2, 9, 30) and head[1]["profile_id"] == 5
    assert head[2]["size"] == 0 and head[2]["profile_id"] is None and 3 not in head
    with pytest.raises(ValueError, match="order_oms_id"):
        csv.read_order_lines(spark, write(tmp_path / "bad.csv", "a;b\n1;2"), DataConfig(separator=";"))


def test_catalog(spark, tmp_path):
    text = 'Бэк ID,OMS ID,Название,Описание,Категория\n1,10,"Сыр, твёрдый","<p>Сыр\nвкусный</p>",Сыры\n2,11,Соль,,Приправы\n'
    rows = {r["item_id"]: r for r in csv.read_catalog(spark, write(tmp_path / "c.csv", text)).collect()}
    assert rows[10]["description"] == "Сыр\nвкусный" and rows[10]["name"] == "Сыр, твёрдый"
    assert rows[11]["description"] == "" and rows[11]["category"] == "Приправы"
    twice = text + "3,10,Новый,,Сыры\n4,,Без номера,,Сыры\n"
    rows = csv.read_catalog(spark, write(tmp_path / "d.csv", twice)).collect()
    assert sorted((r["item_id"], r["name"]) for r in rows) == [(10, "Новый"), (11, "Соль")]
    none = csv.read_catalog(spark, str(tmp_path / "absent.csv"))
    assert none.count() == 0 and none.schema == CATALOG


def lines_of(spark, n_orders=120):
    rows = []
    for o in range(n_orders):
        for pos, item in enumerate(TOY[o % 10]):
            when = datetime(2025, 1, 1) + timedelta(days=o // 2)
            rows.append((o, o % 9, when, item, f"Item {item}", "ok", pos))
    return spark.createDataFrame(rows, ORDER_LINES)


CFG = DataConfig(success_statuses=("ok",), train_days=40, test_days=10, oot_days=8)


def test_snapshot_is_reused_only_for_the_same_settings(spark, tmp_path):
    path = str(tmp_path / "snap")
    calls = []

    def build():
        calls.append(1)
        return bk.prepare(lines_of(spark), CFG)

    first = snapshot.prepared_or_built(spark, CFG, path, build)
    again = snapshot.prepared_or_built(spark, CFG, path, build)
    assert len(calls) == 1 and first.items.count() == again.items.count() > 0
    assert snapshot.load_prepared(spark, DataConfig(train_days=1), path) is None
    assert snapshot.load_prepared(spark, CFG, str(tmp_path / "nowhere")) is None


def test_models_come_back_from_disk(spark, tmp_path, toy, toy_queries):
    pop, cooc = TopPopular.fit(toy), CooccurrenceLift.fit(toy, 1)
    cfg = RankerConfig(n_candidates=5, rounds=1, min_rows_per_leaf=1, max_depth=1)
    ranker = LambdaRanker.of({"TopPopular": pop, "CooccurrenceLift": cooc}, toy, None, None, cfg)
    ranker.fit(toy_queries)
    models = [PopularityRerank.fit(cooc, toy), EnsembleRRF.of([(pop, 1.0), (cooc, 2.0)]), ranker]
    for model in models:
        snapshot.save_model(model, snapshot.model_path(str(tmp_path), model.name))
    short = {v: k for k, v in snapshot.SHORT_NAMES.items()}
    for model in models:
        back = snapshot.load_model(spark, short[model.name], str(tmp_path))
        assert lists_of(back.recommend(toy_queries, 4)) == lists_of(model.recommend(toy_queries, 4))
    with pytest.raises(ValueError, match="unknown model"):
        snapshot.load_model(spark, "magic", str(tmp_path))
    with pytest.raises(FileNotFoundError):
        snapshot.load_model(spark, "item2vec", str(tmp_path))
    assert snapshot.load_titles(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        snapshot.load_metrics(spark, str(tmp_path))


def test_micro_batches_equal_one_batch(spark, tmp_path):
    lines = lines_of(spark).repartition(5)  # lines of one order land in several files
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ORDER_LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    append_partial_baskets(stream, ("ok",), out, str(tmp_path / "cp")).awaitTermination()
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) > 1
    got = merged_baskets(spark.read.parquet(out))
    want = bk.order_items(bk.successful(lines, ("ok",)))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_scoring_equals_batch(spark, tmp_path, toy):
    baskets = spark.createDataFrame([(q, i) for q, b in enumerate(TOY) for i in b[:2]], "query_id long, item_id long")
    for part in range(2):
        baskets.where(F.col("query_id") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    model = CooccurrenceLift.fit(toy, 1)
    stream = spark.readStream.schema(baskets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def sink(recs, batch_id):
        recs.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={batch_id}"))

    score_stream(stream, model, 3, sink, str(tmp_path / "cp")).awaitTermination()
    from pannier.operators.topk import Queries

    got = lists_of(spark.read.parquet(str(tmp_path / "out")))
    assert got == lists_of(model.recommend(Queries.from_items(baskets), 3))


def test_only_must_name_an_enabled_model():
    assert training.chosen_models(TrainConfig(only="TopPopular")) == ["TopPopular"]
    with pytest.raises(ValueError, match="Nothing"):
        training.chosen_models(TrainConfig(only="Nothing"))


def test_whole_run(spark, tmp_path, catalog, monkeypatch):
    prepared = bk.prepare(lines_of(spark), CFG)
    small = EmbeddingConfig(vector_size=4, min_count=1, epochs=1)
    boost = BoostConfig(min_support=1)
    cfg = TrainConfig(
        data=CFG,
        item2vec=small,
        graph=GraphConfig(1, 4, 1, small),
        als=FactorConfig(factors=2, iterations=1),
        bpr=FactorConfig(factors=2, iterations=1),
        content=boost,
        dense=boost,
        ranker=RankerConfig(n_candidates=5, rounds=1, max_depth=1, min_rows_per_leaf=1),
        ensemble_min_hit5=0.0,
        profile_models=(),  # every profile here bought everything, which ties nothing
    )
    mined = []
    monkeypatch.setattr(training, "pair_counts", lambda *a, **b: mined.append(1) or pair_counts(*a, **b))
    out = str(tmp_path / "models")
    models, metrics = training.train(prepared, cfg, catalog, models_dir=out)
    assert set(models) == set(cfg.models) and len(models) == 12
    assert len(mined) == 1  # one pair job for the five models that need pairs
    table = {(r["model"], r["split"], r["scope"], r["bucket"], r["metric"]): r["value"] for r in metrics.collect()}
    for name in models:
        for split in ("test", "oot"):
            h = [table[name, split, "micro", None, f"hit@{k}"] for k in (5, 10, 20)]
            assert 0 <= h[0] <= h[1] <= h[2] <= 1
        assert (name, "test", "debiased", None, "hit@5") in table
        assert table[name, "train", "run", None, "train_time_s"] >= 0
    assert snapshot.load_metrics(spark, out).count() == len(table)
    assert snapshot.load_titles(spark, out).count() == 10
    assert snapshot.load_model(spark, "cooccurrence", out).name == "CooccurrenceLift"


def test_profile_level_fit_uses_histories(spark):
    prepared = bk.prepare(lines_of(spark), CFG)
    items = prepared.profile_baskets
    assert items.select("order_id").distinct().count() == 9
    assert items_of(spark, TOY).count() == sum(map(len, TOY))
