"""Derived tables: what stays on disk after one is written."""

import os

import pytest
from pyspark.sql import functions as F

from pannier import session

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = manager.getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {name for name in names if name.startswith("shuffle")}


def _counted(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 10)
    return rows.groupBy("k").count().join(rows.groupBy("k").agg(F.max("id").alias("m")), "k")


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    table = session.materialise(_counted(spark).repartition(3), "counted")
    assert not _shuffle_files(spark) - before
    assert sorted(map(tuple, table.collect())) == [(k, 100, 990 + k) for k in range(10)]


@pytest.mark.parametrize("value", ["true", "false"])
def test_the_setting_stays_as_it_was(spark, value):
    held = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, value)
        session.materialise(_counted(spark), "counted")
        assert spark.conf.get(KEY) == value
        with pytest.raises(Exception):
            session.materialise(spark.range(3).select(F.raise_error(F.lit("no"))), "failing")
        assert spark.conf.get(KEY) == value
    finally:
        spark.conf.set(KEY, held)


def test_a_replaced_table_is_deleted_and_no_other(spark, tmp_path):
    first, second = (session.materialise(spark.range(n), "blocks") for n in (3, 4))
    folder = first.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    session.discard(first)
    assert not os.path.exists(folder) and second.count() == 4
    spark.range(2).write.parquet(f"{tmp_path}/given")
    with pytest.raises(ValueError, match="no stored table"):
        session.discard(spark.read.parquet(f"{tmp_path}/given"))
    assert spark.read.parquet(f"{tmp_path}/given").count() == 2
