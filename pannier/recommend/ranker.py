"""Learned ensemble: boosted regression trees on the LambdaRank gradient.

Spark ML has no ranking objective. Every group has exactly one relevant item, so
the pairwise gradient needs only that item's score and rank next to each row:
window values over the query, whose size is the number of candidates. A round
fits one weighted regression tree to gradient / curvature, which makes the mean
of a leaf the Newton step, and adds its damped prediction to the scores.
"""

from __future__ import annotations

import random
from typing import Any, ClassVar

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pannier.config import RankerConfig
from pannier.operators import features as fe
from pannier.operators.sampling import sample_cases
from pannier.operators.topk import Queries, top_k
from pannier.recommend.base import Model
from pannier.session import dealt, discard, materialise

CUT_EVERY = 5
# Keeps the weight of an already well-ordered row away from 0.
MIN_CURVATURE = 1e-6


def lambda_gradients(rows: DataFrame) -> DataFrame:
    """Gradient ``g`` and curvature ``h`` per row from label and score.

    The ideal DCG is 1. For a negative the cost of a swap with the positive is
    |1/log2(1 + rank_p) - 1/log2(1 + rank_j)|.
    """
    whole = Window.partitionBy("query_id")
    order = whole.orderBy(F.col("score").desc(), F.col("item_id"))
    ranked = rows.withColumn("_r", F.row_number().over(order))
    is_pos = F.col("label") == 1
    seen = ranked.withColumn("_sp", F.max(F.when(is_pos, F.col("score"))).over(whole)).withColumn(
        "_rp", F.max(F.when(is_pos, F.col("_r"))).over(whole)
    )
    rho = 1.0 / (1.0 + F.exp(F.col("_sp") - F.col("score")))
    swap = F.abs(1.0 / F.log2(1.0 + F.col("_rp")) - 1.0 / F.log2(1.0 + F.col("_r")))
    pulls = seen.withColumn("_l", F.when(is_pos, 0.0).otherwise(swap * rho)).withColumn(
        "_c", F.when(is_pos, 0.0).otherwise(swap * rho * (1.0 - rho))
    )
    g = F.when(is_pos, F.sum("_l").over(whole)).otherwise(-F.col("_l"))
    h = F.when(is_pos, F.sum("_c").over(whole)).otherwise(F.col("_c"))
    return (
        pulls.withColumn("g", g)
        .withColumn("h", F.greatest(h, F.lit(MIN_CURVATURE)))
        .drop("_r", "_sp", "_rp", "_l", "_c")
    )


class LambdaRanker(Model):
    """Without a fit, or for queries nobody has candidates for, the first base model answers."""

    name: ClassVar[str] = "LGBMEnsemble"

    def __init__(
        self,
        params: dict[str, Any] | None = None,
        tables: dict[str, DataFrame] | None = None,
        members: dict[str, Model] | None = None,
        cfg: RankerConfig = RankerConfig(),
    ) -> None:
        super().__init__(params or {}, tables or {})
        self.members = members or {}
        self.cfg = cfg
        self.params.setdefault("trees", [])

    def components(self) -> dict[str, Model]:
        return self.members

    @property
    def feature_names(self) -> list[str]:
        return [
            *fe.score_features(list(self.members)),
            *fe.USER_FEATURES,
            *fe.ITEM_FEATURES,
        ]

    @classmethod
    def of(
        cls,
        members: dict[str, Model],
        train_items: DataFrame,
        catalog: DataFrame | None = None,
        histories: DataFrame | None = None,
        cfg: RankerConfig = RankerConfig(),
        mined: DataFrame | None = None,
    ) -> LambdaRanker:
        """Feature tables only; ``fit`` adds the trees. ``mined`` are all pair counts of the items, if stored."""
        items = materialise(fe.item_features(train_items, catalog, mined=mined), "item_features")
        tables = {"items": items}
        if catalog is not None:
            tables["catalog"] = catalog
        if histories is not None:
            tables["histories"] = histories
        return cls({}, tables, members, cfg)

    def _packed(self) -> Column:
        """All features in their fixed order, as one array."""
        return F.array(*[F.col(f"`{f}`") for f in self.feature_names]).alias("features")

    def candidates(self, queries: Queries) -> DataFrame:
        lists = [
            (name, m.recommend(queries, self.cfg.n_candidates))
            for name, m in self.members.items()
        ]
        return materialise(
            fe.candidate_scores(lists, self.cfg.n_candidates), "ranker_candidates"
        )

    def _features(self, candidates: DataFrame, queries: Queries, history: bool) -> DataFrame:
        items = self.tables["items"]
        counts = items.select("item_id", F.col("item_popularity").alias("freq"))
        users = fe.user_features(
            queries.cases,
            queries.items,
            counts,
            self.tables.get("catalog"),
            self.tables.get("histories") if history else None,
        )
        n_items = items.agg(F.count_if(F.col("item_popularity") > 0))
        return fe.with_features(candidates, users, items, n_items)

    def training_rows(self, queries: Queries) -> DataFrame:
        """Labelled candidates with features, one array per row."""
        cfg = self.cfg
        cases = sample_cases(queries.cases, cfg.max_train_cases, f"{cfg.seed}:ranker")
        sampled = Queries.stored(
            cases, queries.items.join(cases.select("query_id"), "query_id", "left_semi"), "rank"
        )
        labelled = fe.label_candidates(
            self.candidates(sampled), sampled.cases, list(self.members), cfg.n_candidates
        )
        full = self._features(labelled, sampled, True)
        return full.select("query_id", "item_id", "label", self._packed())

    def fit(self, queries: Queries) -> LambdaRanker:
        cfg = self.cfg
        # stored dealt by query: no round's windows shuffle
        rows = self._dealt(self.training_rows(queries).withColumn("score", F.lit(0.0)))
        if rows.isEmpty():
            return self
        stored = rows
        n = len(self.feature_names)
        chosen = random.Random(cfg.seed)
        share = max(1, round(n * cfg.feature_fraction))
        for step in range(cfg.rounds):
            used = sorted(chosen.sample(range(n), share))
            vector = array_to_vector(
                F.array(*[F.element_at("features", i + 1) for i in used])
            ).alias("used")
            target = lambda_gradients(rows).select(
                vector, F.col("h").alias("weight"), (F.col("g") / F.col("h")).alias("target")
            ).persist()
            tree = DecisionTreeRegressor(
                featuresCol="used",
                labelCol="target",
                weightCol="weight",
                maxDepth=cfg.max_depth,
                minInstancesPerNode=cfg.min_rows_per_leaf,
                seed=cfg.seed + step,
            ).fit(target)
            target.unpersist()
            self.params["trees"].append(flatten_tree(tree, used))
            rows = (
                tree.transform(rows.withColumn("used", vector))
                .withColumn("score", F.col("score") + cfg.learning_rate * F.col("prediction"))
                .drop("used", "prediction")
            )
            if (step + 1) % CUT_EVERY == 0 and step + 1 < cfg.rounds:
                scored = self._dealt(rows)
                discard(stored)
                rows = stored = scored
        return self

    @staticmethod
    def _dealt(rows: DataFrame) -> DataFrame:
        return dealt(rows.repartition("query_id"), "ranker_rows", "query_id")

    def importance(self) -> DataFrame:
        """Gain per feature, summed over the rounds."""
        totals = [0.0] * len(self.feature_names)
        for tree in self.params["trees"]:
            for at, gain in zip(tree["at"], tree["gain"]):
                if at >= 0:
                    totals[at] += gain
        spark = next(iter(self.tables.values())).sparkSession
        table = spark.createDataFrame(
            list(zip(self.feature_names, totals)), "feature string, gain double"
        )
        return table.orderBy(F.col("gain").desc(), "feature")

    def recommend(self, queries: Queries, k: int = 10) -> DataFrame:
        first = next(iter(self.members.values()), None)
        if first is None:
            raise ValueError("the ranker needs at least one base model")
        if not self.params["trees"]:
            return first.recommend(queries, k)
        # a query has candidates exactly when some base model proposes an item,
        # and then the first base model's own list is not needed
        full = self._features(self.candidates(queries), queries, self.cfg.use_history)
        score = tree_sum(self.params["trees"], self.cfg.learning_rate)
        packed = full.select("query_id", "item_id", self._packed())
        return top_k(packed.select("query_id", "item_id", score("features").alias("score")), k)


def flatten_tree(tree: Any, used: list[int]) -> dict[str, Any]:
    """Nodes of a fitted tree as plain lists; children by position, -1 for a leaf."""
    out: dict[str, Any] = {"at": [], "limit": [], "left": [], "right": [], "value": [], "gain": []}

    def add(node: Any) -> int:
        here = len(out["at"])
        leaf = node.subtreeDepth() == 0
        out["at"].append(-1 if leaf else used[node.split().featureIndex()])
        out["limit"].append(0.0 if leaf else node.split().threshold())
        out["value"].append(node.prediction())
        out["gain"].append(0.0 if leaf else node.gain() * node.impurityStats().count())
        out["left"].append(-1)
        out["right"].append(-1)
        if not leaf:
            out["left"][here] = add(node.leftChild())
            out["right"][here] = add(node.rightChild())
        return here

    add(tree._java_obj.rootNode())
    return out


def tree_sum(trees: list[dict[str, Any]], rate: float):
    """Sum of the trees' predictions for a column of feature arrays, in Arrow batches."""
    packed = [
        tuple(np.asarray(t[c]) for c in ("at", "limit", "left", "right", "value")) for t in trees
    ]

    @F.pandas_udf("double")
    def total(features: pd.Series) -> pd.Series:
        rows = np.asarray(features.tolist(), dtype=np.float64)
        out = np.zeros(len(rows))
        everyone = np.arange(len(rows))
        for at, limit, left, right, value in packed:
            node = np.zeros(len(rows), dtype=np.int64)
            while True:
                split = at[node] >= 0
                if not split.any():
                    break
                low = rows[everyone, np.maximum(at[node], 0)] <= limit[node]
                node = np.where(split, np.where(low, left[node], right[node]), node)
            out += rate * value[node]
        return pd.Series(out)

    return total
