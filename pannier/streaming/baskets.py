"""Incremental basket building, and scoring of baskets that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pannier.operators.baskets import order_items, successful
from pannier.operators.topk import Queries
from pannier.recommend.base import Model


def append_partial_baskets(
    lines: DataFrame, statuses: Sequence[str], out_dir: str, checkpoint_dir: str
) -> StreamingQuery:
    """Fold each micro-batch of order lines into partial baskets under ``out_dir``.

    A batch owns the folder of its id and overwrites it, so a batch repeated after
    a failure counts once. No state is kept: an order whose lines arrive in
    several batches is completed by ``merged_baskets``.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        order_items(successful(batch, statuses)).write.mode("overwrite").parquet(
            f"{out_dir}/batch={batch_id}"
        )

    return (
        lines.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def merged_baskets(parts: DataFrame) -> DataFrame:
    """Partial baskets of all batches as the rows a single batch would have given."""
    return parts.groupBy("order_id", "item_id").agg(
        F.min("pos").alias("pos"),
        F.min("first_at").alias("first_at"),
        F.min_by("profile_id", "pos").alias("profile_id"),
    )


def score_stream(
    baskets: DataFrame,
    model: Model,
    k: int,
    sink: Callable[[DataFrame, int], None],
    checkpoint_dir: str,
) -> StreamingQuery:
    """Recommend for baskets (query_id, item_id) that arrive as a stream.

    A micro-batch holds whole baskets; its recommendations go to ``sink`` with
    the batch id, under which the sink can overwrite.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            sink(model.recommend(Queries.from_items(batch), k), batch_id)

    return (
        baskets.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
