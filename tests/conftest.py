from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TOY = [
    [2, 5, 9], [2, 5], [5, 9, 1, 4], [7, 3], [3, 7, 6, 2],
    [10, 4, 5], [2, 9], [8, 1, 5, 2], [6, 7], [5, 2, 3, 9, 10],
]

CATEGORIES = [
    "Фрукты", "Сыры", "Орехи", "Напитки", "Хлеб",
    "Орехи", "Фрукты", "Напитки", "Фрукты", "Напитки",
]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def items_of(spark, baskets, profiles=None):
    """Baskets in the long form that fits the models."""
    rows = [
        (b, int(item), pos, profiles[b] if profiles else None, len(basket))
        for b, basket in enumerate(baskets)
        for pos, item in enumerate(basket)
    ]
    return spark.createDataFrame(
        rows, "order_id long, item_id long, pos long, profile_id long, size long"
    )


def queries_of(spark, baskets, held=None, profiles=None):
    from pannier.operators.topk import Queries

    cases = spark.createDataFrame(
        [
            (q, profiles[q] if profiles else None, held[q] if held else None)
            for q in range(len(baskets))
        ],
        "query_id long, profile_id long, held_out long",
    )
    items = spark.createDataFrame(
        [(q, i) for q, b in enumerate(baskets) for i in b], "query_id long, item_id long"
    )
    return Queries.stored(cases, items)


def lists_of(recs):
    """query -> item ids in rank order; checks that ranks run 1..n."""
    out: dict[int, list[tuple[int, int]]] = {}
    for r in recs.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    for rows in out.values():
        rows.sort()
        assert [rank for rank, _ in rows] == list(range(1, len(rows) + 1))
    return {q: [item for _, item in rows] for q, rows in out.items()}


@pytest.fixture(scope="session")
def toy(spark):
    return items_of(spark, TOY).cache()


@pytest.fixture(scope="session")
def catalog(spark):
    words = ["свежая рыба к ужину", "гречка и рис", "острый соус", "перец", "соль и перец",
             "креветки", "огурцы свежие", "молоко", "томаты свежие", ""]
    rows = [(i, i, f"Item {i}", words[i - 1], CATEGORIES[i - 1]) for i in range(1, 11)]
    return spark.createDataFrame(
        rows, "back_id long, item_id long, name string, description string, category string"
    ).cache()


@pytest.fixture(scope="session")
def toy_queries(spark):
    return queries_of(spark, [[2, 9], [5, 4], [7, 3]], held=[5, 10, 6])
