"""Schemas of the tables the jobs exchange."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# One line of one order; ``pos`` orders the lines of an order as they were recorded
# (any type with an order will do).
ORDER_LINES = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("profile_id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("pos", T.LongType()),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("back_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)

RECS = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def require_columns(df: DataFrame, required: Iterable[str], source: str) -> None:
    """Raise when a source lacks columns; looks at the schema only and runs no job."""
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(
            f"{source} lacks required columns {sorted(missing)}; "
            f"available columns: {sorted(df.columns)}"
        )
