"""Latent factor models: implicit ALS with fold-in, and pairwise (BPR) factors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pannier.config import FactorConfig
from pannier.functions.vectors import mean_vectors
from pannier.operators.nearest import nearest
from pannier.operators.numbering import dense_index
from pannier.operators.topk import Queries, drop_owned, top_k
from pannier.recommend.alternate import item_factors
from pannier.recommend.base import Model
from pannier.recommend.blocks import BlockConfig, train_blocks
from pannier.session import materialise

# A query with more items than this is folded in from partial sums.
FOLD_ITEMS = 100
# Items behind one partial sum.
PART_ITEMS = 4096
# Linear systems solved at once inside a task.
SOLVE_ROWS = 512


class ImplicitBPR(Model):
    """Pairwise-ranked factors; a query is the mean of its items' vectors."""

    name: ClassVar[str] = "ImplicitBPR"

    @classmethod
    def fit(
        cls, items: DataFrame, cfg: FactorConfig = FactorConfig(iterations=100), seed: int = 42
    ) -> ImplicitBPR:
        pairs = items.select(F.col("order_id").alias("u"), F.col("item_id").alias("i")).distinct()
        train = BlockConfig(cfg.factors, cfg.iterations, cfg.learning_rate, cfg.regularization, "bpr", seed)
        vectors = train_blocks(pairs.withColumn("weight", F.lit(1)), train).withColumnRenamed("id", "item_id")
        return cls(tables={"vectors": materialise(vectors, "bpr_vectors")})

    def recommend(self, queries: Queries, k: int = 10) -> DataFrame:
        mine = (
            queries.items.join(self.tables["vectors"], "item_id")
            .groupBy("query_id")
            .agg(mean_vectors(F.col("vec")).alias("vec"))
        )
        return _by_dot(mine, self.tables["vectors"], queries, k)


def _by_dot(mine: DataFrame, vectors: DataFrame, queries: Queries, k: int) -> DataFrame:
    asks = materialise(
        mine.join(queries.cases.select("query_id", "size"), "query_id").select(
            "query_id", "vec", (F.col("size") + k).alias("want")
        ),
        "query_vectors",
    )
    return top_k(drop_owned(nearest(asks, vectors, "dot"), queries), k)


class ImplicitALS(Model):
    """Implicit ALS over baskets (``alternate``); a new basket is folded in exactly.

    Factors are fitted on baskets as users, but a query is a basket the fit never
    saw: its vector solves the same regularised least squares against the fixed
    item vectors, with confidence ``1 + alpha`` for its items.
    """

    name: ClassVar[str] = "ImplicitALS"

    @classmethod
    def fit(
        cls, items: DataFrame, cfg: FactorConfig = FactorConfig(), seed: int = 42
    ) -> ImplicitALS:
        users = materialise(dense_index(items, "order_id", "user"), "als_users")
        index = materialise(dense_index(items, "item_id", "item"), "als_items")
        if users.count() >= 1 << 31:
            raise ValueError("ALS numbers its users with 32 bits; fit it on fewer baskets")
        ratings = (
            items.select("order_id", "item_id")
            .join(users, "order_id")
            .join(index, "item_id")
            .select(
                F.col("user").cast("int").alias("user"),
                F.col("item").cast("int").alias("item"),
                F.lit(1.0).cast("float").alias("rating"),
            )
        )
        # Spark's ALS draws the vectors that users start from; they depend on the users' numbers only
        firsts = ratings.groupBy("user").agg(F.min("item").alias("item"), F.min("rating").alias("rating"))
        model = ALS(
            rank=cfg.factors,
            maxIter=0,
            regParam=cfg.regularization,
            alpha=cfg.alpha,
            implicitPrefs=True,
            seed=seed,
            checkpointInterval=1,
        ).fit(firsts if cfg.iterations else ratings)
        factors = model.itemFactors
        if cfg.iterations:
            factors = item_factors(ratings, model.userFactors, users.count(), index.count(), cfg)
        vectors = factors.withColumnRenamed("id", "item").join(
            index.withColumn("item", F.col("item").cast("int")), "item"
        )
        params = {
            "factors": cfg.factors,
            "regularization": cfg.regularization,
            "alpha": cfg.alpha,
        }
        return cls(
            params,
            {"vectors": materialise(vectors.select("item_id", F.col("features").alias("vec")), "als_vectors")},
        )

    def gram(self) -> np.ndarray:
        """Item factors' Gram matrix: per-partition products, summed cell by cell."""
        n = self.params["factors"]

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((n, n))
            for batch in batches:
                if len(batch):
                    y = np.asarray(batch["vec"].tolist(), dtype=np.float64)
                    total += y.T @ y
            yield pd.DataFrame({"cell": np.arange(n * n), "value": total.ravel()})

        cells = (
            self.tables["vectors"].select("vec")
            .mapInPandas(partial, "cell long, value double")
            .groupBy("cell")
            .agg(F.sum("value").alias("value"))
        )
        out = np.zeros(n * n)
        for row in cells.collect():  # factors x factors cells, whatever the data size
            out[row["cell"]] = row["value"]
        return out.reshape(n, n)

    def fold_in(self, queries: Queries) -> DataFrame:
        """Query vectors. A query's items are summed in bounded parts first."""
        n, alpha, reg = (self.params[p] for p in ("factors", "alpha", "regularization"))
        base = self.gram()
        sizes = queries.cases.select("query_id", "size")
        rows = queries.owned.join(self.tables["vectors"], "item_id").join(sizes, "query_id")

        def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lo in range(0, len(batch), SOLVE_ROWS):
                    tile = batch.iloc[lo : lo + SOLVE_ROWS]
                    ys = [np.asarray(v, dtype=np.float64).reshape(-1, n) for v in tile["flat"]]
                    left = np.stack([alpha * (y.T @ y) + reg * len(y) * np.eye(n) for y in ys])
                    right = np.stack([(1 + alpha) * y.sum(axis=0) for y in ys])
                    x = np.linalg.solve(base + left, right[:, :, None])[:, :, 0]
                    yield pd.DataFrame({"query_id": tile["query_id"].to_numpy(), "vec": list(x)})

        vectors = (
            rows.where(F.col("size") <= FOLD_ITEMS)
            .groupBy("query_id")
            .agg(F.flatten(F.collect_list("vec")).alias("flat"))
            .mapInPandas(small, "query_id long, vec array<double>")
        )
        if queries.max_size <= FOLD_ITEMS:
            return vectors

        def part_sums(pdf: pd.DataFrame) -> pd.DataFrame:
            y = np.asarray(pdf["vec"].tolist(), dtype=np.float64)
            values = np.concatenate([(y.T @ y).ravel(), y.sum(axis=0), [len(y)]])
            return pd.DataFrame(
                {
                    "query_id": pdf["query_id"].iloc[0],
                    "cell": np.arange(len(values)),
                    "value": values,
                }
            )

        def large(pdf: pd.DataFrame) -> pd.DataFrame:
            values = pdf.sort_values("cell")["value"].to_numpy()
            gram, rhs = values[: n * n].reshape(n, n), values[n * n : n * n + n]
            left = base + alpha * gram + reg * values[-1] * np.eye(n)
            x = np.linalg.solve(left, (1 + alpha) * rhs)
            return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]], "vec": [x]})

        summed = (
            rows.where(F.col("size") > FOLD_ITEMS)
            .select(
                "query_id",
                "vec",
                F.pmod(
                    F.xxhash64("item_id"), F.ceil(F.col("size") / PART_ITEMS).cast("long")
                ).alias("part"),
            )
            .groupBy("query_id", "part")
            .applyInPandas(part_sums, "query_id long, cell long, value double")
            .groupBy("query_id", "cell")
            .agg(F.sum("value").alias("value"))
        )
        return vectors.unionByName(
            summed.groupBy("query_id").applyInPandas(large, "query_id long, vec array<double>")
        )

    def recommend(self, queries: Queries, k: int = 10) -> DataFrame:
        return _by_dot(self.fold_in(queries), self.tables["vectors"], queries, k)
