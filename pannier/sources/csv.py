"""CSV sources: order lines and the product catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pannier.config import DataConfig
from pannier.functions.scalar import parse_mixed, parse_timestamp, strip_tags
from pannier.schema import CATALOG, require_columns

# Columns of the raw order export.
ORDER_COLUMNS = (
    "order_status_title",
    "order_oms_id",
    "profile_id",
    "order_item_title",
)

# Headers of the raw catalog export.
CATALOG_HEADERS = {
    "Бэк ID": "back_id",
    "OMS ID": "item_id",
    "Название": "name",
    "Описание": "description",
    "Категория": "category",
}

def _header_frame(spark: SparkSession, path: str, separator: str, multi_line: bool) -> DataFrame:
    """All columns as text; the header alone decides the names."""
    return (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .csv(path)
    )


def _integer(name: str) -> Column:
    """Ids may be written as 12 or, after a null in the column, as 12.0; a fraction is no id."""
    number = F.expr(f"try_cast(trim(`{name}`) as decimal(38, 6))")
    return F.when(number == F.floor(number), F.expr(f"try_cast(try_cast(trim(`{name}`) as decimal(38, 6)) as bigint)"))


def _parsed(cfg: DataConfig, formats: Sequence[str] | None) -> dict[str, tuple[str, Column]]:
    """Schema column -> (raw column, value)."""
    time = F.col(f"`{cfg.date_column}`")
    return {
        "order_id": ("order_oms_id", _integer("order_oms_id")),
        "profile_id": ("profile_id", _integer("profile_id")),
        "created_at": (cfg.date_column, parse_timestamp(time, formats) if formats else parse_mixed(time)),
        "item_id": (cfg.item_id_column, _integer(cfg.item_id_column)),
    }


def _lost(name: str, value: Column) -> Column:
    """A text that is not blank and gave no value."""
    return value.isNull() & (F.trim(F.col(f"`{name}`")) != "")


def _or_raise(name: str, value: Column) -> Column:
    """The parsed value; a text that cannot be read stops the job and is shown."""
    text = F.col(f"`{name}`")
    return F.when(_lost(name, value), F.raise_error(F.concat(F.lit(f"{name} cannot be read: "), text))).otherwise(value)


def _raw_lines(spark: SparkSession, path: str, cfg: DataConfig) -> DataFrame:
    raw = _header_frame(spark, path, cfg.separator, cfg.multi_line)
    require_columns(raw, [*ORDER_COLUMNS, cfg.item_id_column, cfg.date_column], path)
    return raw


def read_order_lines(
    spark: SparkSession,
    path: str,
    cfg: DataConfig = DataConfig(),
    formats: Sequence[str] | None = None,
    rejects: bool = False,
) -> DataFrame:
    """Order lines in the common schema; only the columns in use are parsed.

    Files are read in splits that Spark orders by size, so the recorded order is
    (file, offset of the split, row within it); ``pos`` carries these three. With
    ``cfg.multi_line`` quoted fields may span lines and a file is one split. A time
    or an order, profile or item id that cannot be read stops the job; blank ones are null.
    With ``rejects`` such lines are left out instead: ``rejected_order_lines`` has them.
    Times are read by their shape, or by the given formats in turn.
    """
    raw = _raw_lines(spark, path, cfg)
    parsed = _parsed(cfg, formats)
    if rejects:
        for name, value in parsed.values():
            raw = raw.where(~F.coalesce(_lost(name, value), F.lit(False)))
    values = {to: value if rejects else _or_raise(name, value) for to, (name, value) in parsed.items()}
    return raw.select(
        *[values[to].alias(to) for to in ("order_id", "profile_id", "created_at", "item_id")],
        F.col("order_item_title").alias("title"),
        F.col("order_status_title").alias("status"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("offset"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("pos"),
    )


def rejected_order_lines(
    spark: SparkSession, path: str, cfg: DataConfig = DataConfig(), formats: Sequence[str] | None = None
) -> DataFrame:
    """What cannot be read, one row per value: file, column, value, and the order's and item's text."""
    raw = _raw_lines(spark, path, cfg)
    found = [
        F.when(_lost(name, value), F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").alias("value")))
        for name, value in _parsed(cfg, formats).values()
    ]
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("order_oms_id").alias("order_text"),
        F.col(f"`{cfg.item_id_column}`").alias("item_text"),
        F.explode(F.array_compact(F.array(*found))).alias("r"),
    ).select("file", "r.column", "r.value", "order_text", "item_text")


def line_counts(
    spark: SparkSession, path: str, cfg: DataConfig = DataConfig(), formats: Sequence[str] | None = None
) -> DataFrame:
    """column, value, n as ``reject_counts`` has them, and a row (kept, "", n) of the lines with an order id that
    ``read_order_lines`` keeps with ``rejects``; the files are read once.
    """
    raw = _raw_lines(spark, path, cfg)
    parsed = _parsed(cfg, formats)
    row = lambda column, value: F.struct(column.alias("column"), value.alias("value"))
    found = F.array_compact(
        F.array(*[F.when(_lost(name, value), row(F.lit(name), F.col(f"`{name}`"))) for name, value in parsed.values()])
    )
    ordered = parsed["order_id"][1].isNotNull().alias("ordered")
    kept = F.when(F.col("ordered"), F.array(row(F.lit("kept"), F.lit(""))))
    counts = (
        raw.select(found.alias("found"), ordered)
        .select(F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(kept)).alias("r"))
        .groupBy("r.column", "r.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    none = spark.range(1).select(F.lit("kept").alias("column"), F.lit("").alias("value"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(none).groupBy("column", "value").agg(F.sum("n").alias("n"))


def reject_counts(rejected: DataFrame) -> DataFrame:
    """column, value, n: what is unreadable and how often."""
    return rejected.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog with clean descriptions; a missing file gives an empty table.

    Descriptions may hold line breaks, so quoted fields can span lines. Of rows with
    one id the last in the file counts; rows without an id are left out.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], CATALOG)
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
        .withColumnsRenamed(CATALOG_HEADERS)
    )
    rows = raw.select(
        _integer("item_id").alias("item_id"),
        F.struct(
            _integer("back_id").alias("back_id"),
            "name",
            strip_tags(F.col("description")).alias("description"),
            "category",
        ).alias("row"),
        F.monotonically_increasing_id().alias("place"),
    ).where("item_id is not null")
    return (
        rows.groupBy("item_id")
        .agg(F.max_by("row", "place").alias("row"))
        .select("row.back_id", "item_id", "row.name", "row.description", "row.category")
    )


def catalog_summary(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count(F.lit(1)).alias("n_items"), F.count_distinct("category").alias("n_categories")
    )


def write_csv(df: DataFrame, path: str) -> None:
    """A report table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


