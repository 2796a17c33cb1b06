"""Where jobs keep what they derive: the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
# Drops a statement's shuffle files at its end; otherwise they stay until the driver collects garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one machine, gets a
    folder of its own when the setting is missing.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    own = _own_dirs.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="pannier-"))
    sc.setCheckpointDir(own)
    return own


def run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pannier/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Spark SQL settings for the jobs started inside; afterwards they are as before."""
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialise(
    df: DataFrame, name: str, partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """Write a derived table once to the shared folder and read it back.

    The shuffle files behind it have served their purpose and go with the write.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with settings(spark, {_DROP_SHUFFLES: "true"}):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, *key: str, **options: str) -> DataFrame:
    """As ``materialise``, dealt to as many buckets of ``key`` as there are shuffle partitions.

    A join or grouping by ``key`` then moves the other side only, as often as the table is used.
    The name in the catalog goes at once; the files stay.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.options(**options).bucketBy(buckets, *key).option("path", f"{run_dir(spark)}/{table}")
    with settings(spark, {_DROP_SHUFFLES: "true"}):
        writer.saveAsTable(table)
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return stored


def discard(stored: DataFrame) -> None:
    """Delete a table that ``materialise`` stored and that a later one has replaced."""
    spark = stored.sparkSession
    own = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    own = fs.makeQualified(own).toUri().getPath()
    for folder in {file.rsplit("/", 1)[0] for file in stored.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().toUri().getPath() != own:
            raise ValueError(f"{folder} is no stored table of this run")
        fs.delete(path, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a source of fewer splits than cores to all cores before heavy row-wise work.

    Large sources have more splits than that and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
