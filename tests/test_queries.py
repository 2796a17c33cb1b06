"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from pannier.plans import oracle, queries

DATA = os.environ.get("PANNIER_TEST_DATA", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, SQL = queries.QUERIES, oracle.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def tidy(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)
    # fits that start from random vectors, and reports of nested values
    assert set(QUERIES) - set(SQL) == {
        "item2vec_recs", "als_recs", "bpr_recs", "graph_walk_recs",
        "lambdarank_recs", "feature_importance", "health_report", "text_vectors",
    }


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ours = tidy(QUERIES[name](spark, DATA).toPandas())
    theirs = tidy(duck.execute(SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
    for c in ours.columns:
        a, b = ours[c], theirs[c]
        if "f" in (a.dtype.kind, b.dtype.kind):
            assert np.allclose(a.astype(float), b.astype(float), atol=1e-9, equal_nan=True), c
        else:
            assert ((a == b) | (a.isna() & b.isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4
