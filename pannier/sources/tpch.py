"""Order lines, catalog and vectors out of a star schema of orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title")
    )


def order_lines(spark: SparkSession, sf_dir: str, titles: bool = True) -> DataFrame:
    """Line numbers repeat inside an order, so the position is (line number, item)."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("item_id"),
        (
            F.shiftleft(F.col("l_linenumber").cast("long"), 40) + F.col("l_partkey")
        ).alias("pos"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("profile_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
    )
    joined = lines.join(orders, "order_id")
    if titles:
        joined = joined.join(item_names(spark, sf_dir), "item_id", "left")
    else:
        joined = joined.withColumn("title", F.lit(None).cast("string"))
    return joined.select(
        "order_id", "profile_id", "created_at", "item_id", "title", "status", "pos"
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("back_id"),
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("name"),
        F.col("p_name").alias("description"),
        F.col("p_type").alias("category"),
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec")
    )
