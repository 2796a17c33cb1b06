"""A stored pair table that micro-batches advance.

The store is append-only: a batch adds the (order, item) rows that earlier batches
lack, and the pair counts these rows bring: pairs of the orders it touches, after
minus before. Counts, lift, PMI, NPMI and graph edges derive from the sums of all
batches, so history is never mined again. A batch owns the folders of its id and
reads only those before it; repeated after a failure it writes the same again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pannier.operators import pairs as pr
from pannier.operators.baskets import successful

_ITEMS = "order_id long, item_id long, batch long"
_PAIRS = "item_a long, item_b long, pair_count long, batch long"


@dataclass(frozen=True)
class PairStore:
    """Items and pair counts by batch under ``folder``."""

    spark: SparkSession
    folder: str

    def _before(self, name: str, schema: str, batch_id: int | None) -> DataFrame:
        """Rows of the batches before ``batch_id``, or of all."""
        path = f"{self.folder}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(path)
        return rows if batch_id is None else rows.where(F.col("batch") < batch_id)

    def add(self, lines: DataFrame, batch_id: int) -> None:
        """Advance by the (order_id, item_id) rows of one batch; repeated and null ones add nothing."""
        known = self._before("items", _ITEMS, batch_id).select("order_id", "item_id")
        rows = lines.select("order_id", "item_id").where("order_id is not null and item_id is not null").distinct()
        mine = f"{self.folder}/items/batch={batch_id}"
        rows.join(known, ["order_id", "item_id"], "left_anti").write.mode("overwrite").parquet(mine)
        fresh = self.spark.read.schema("order_id long, item_id long").parquet(mine)
        before = known.join(fresh.select("order_id").distinct(), "order_id", "left_semi")
        gone = pr.pair_counts(before).withColumn("pair_count", -F.col("pair_count"))
        change = pr.pair_counts(before.unionByName(fresh)).unionByName(gone)
        (
            change.groupBy("item_a", "item_b")
            .agg(F.sum("pair_count").alias("pair_count"))
            .where("pair_count <> 0")
            .write.mode("overwrite")
            .parquet(f"{self.folder}/pairs/batch={batch_id}")
        )

    def items(self) -> DataFrame:
        return self._before("items", _ITEMS, None).select("order_id", "item_id")

    def pairs(self, min_support: int = 1) -> DataFrame:
        """item_a, item_b, pair_count over all batches."""
        sums = self._before("pairs", _PAIRS, None).groupBy("item_a", "item_b").agg(F.sum("pair_count").alias("pair_count"))
        return sums.where(F.col("pair_count") >= min_support)

    def associations(self, metric: str, min_support: int = 2) -> DataFrame:
        """Positive associations in both directions, as ``association_table`` gives them."""
        items = self.items()
        return pr.association_table(
            items, pr.item_counts(items), pr.basket_total(items), metric, min_support, mined=self.pairs(min_support)
        )


def advance_pairs(
    lines: DataFrame, statuses: Sequence[str], store: PairStore, checkpoint_dir: str
) -> StreamingQuery:
    """Advance the store by each micro-batch of order lines."""
    return (
        lines.writeStream.foreachBatch(lambda batch, batch_id: store.add(successful(batch, statuses), batch_id))
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
