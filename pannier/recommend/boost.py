"""Co-occurrence pool re-scored with category affinity and text similarity."""

from __future__ import annotations

from collections.abc import Sequence
from typing import ClassVar

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pannier.config import BoostConfig, TextConfig
from pannier.operators import content
from pannier.operators.pairs import basket_total, category_affinity
from pannier.operators.topk import Queries, top_k
from pannier.recommend.base import Model
from pannier.recommend.cooccurrence import association_top, fit_associations
from pannier.session import materialise

# The pool holds this many times k candidates.
POOL_FACTOR = 5

PARTS = ("cooc", "category", "text")


class BlendedPool(Model):
    """Common part of the two boosted models; they differ in the text signal."""

    def text_scores(self, queries: Queries, pool: DataFrame) -> DataFrame | None:
        raise NotImplementedError

    def pool_parts(self, queries: Queries, pool_size: int) -> DataFrame:
        """The pool with its three parts, each divided by its maximum in the pool.

        A part whose maximum is not positive counts 0. The pool is at most
        ``pool_size`` rows per query, so windows by query stay small.
        """
        pool = materialise(
            association_top(queries, self.tables, pool_size).select(
                "query_id", "item_id", F.col("score").alias("cooc")
            ),
            "boost_pool",
        )
        parts = pool
        if "affinity" in self.tables:
            parts = parts.join(
                content.category_scores(
                    queries.items, pool, self.tables["catalog"], self.tables["affinity"]
                ),
                ["query_id", "item_id"],
                "left",
            )
        else:
            parts = parts.withColumn("category", F.lit(0.0))
        text = self.text_scores(queries, pool)
        if text is None:
            parts = parts.withColumn("text", F.lit(0.0))
        else:
            parts = parts.join(text, ["query_id", "item_id"], "left")
        whole = Window.partitionBy("query_id")
        top = {p: F.max(p).over(whole) for p in PARTS}
        return parts.select(
            "query_id",
            "item_id",
            *[
                F.when(top[p] > 0, F.coalesce(p, F.lit(0.0)) / top[p])
                .otherwise(F.lit(0.0))
                .alias(p)
                for p in PARTS
            ],
        )

    def weights(self) -> tuple[float, float, float]:
        p = self.params
        return p["cooc_weight"], p["category_weight"], p["text_weight"]

    def with_weights(self, weights: Sequence[float]) -> BlendedPool:
        names = ("cooc_weight", "category_weight", "text_weight")
        return type(self)({**self.params, **dict(zip(names, weights))}, self.tables)

    def recommend(self, queries: Queries, k: int = 10, pool_size: int | None = None) -> DataFrame:
        parts = self.pool_parts(queries, pool_size or POOL_FACTOR * k)
        return top_k(blend(parts, self.weights()), k)


def blend(parts: DataFrame, weights: Sequence[float]) -> DataFrame:
    score = sum(
        (F.lit(float(w)) * F.col(p) for w, p in zip(weights[1:], PARTS[1:])),
        F.lit(float(weights[0])) * F.col(PARTS[0]),
    )
    return parts.select("query_id", "item_id", score.alias("score"))


def _fit_common(
    items: DataFrame, catalog: DataFrame | None, cfg: BoostConfig, mined: DataFrame | None
) -> tuple[dict, dict[str, DataFrame]]:
    params = {
        "cooc_weight": cfg.cooc_weight,
        "category_weight": cfg.category_weight,
        "text_weight": cfg.text_weight,
        "min_support": cfg.min_support,
        "score_metric": cfg.score_metric,
    }
    tables = fit_associations(items, cfg.score_metric, cfg.min_support, mined=mined)
    if catalog is not None:
        tables["catalog"] = materialise(
            catalog.select("item_id", "category"), "boost_catalog"
        )
        tables["affinity"] = materialise(
            category_affinity(items, tables["catalog"], basket_total(items)), "affinity"
        )
    return params, tables


class ContentBoost(BlendedPool):
    name: ClassVar[str] = "ContentBoost"

    @classmethod
    def fit(
        cls,
        items: DataFrame,
        catalog: DataFrame | None = None,
        cfg: BoostConfig = BoostConfig(score_metric="lift"),
        text: TextConfig = TextConfig(),
        mined: DataFrame | None = None,
    ) -> ContentBoost:
        params, tables = _fit_common(items, catalog, cfg, mined)
        if catalog is not None:
            texts = content.with_text(catalog)
            counts, vocab = content.text_tables(texts, text)
            tables["tfidf"] = materialise(
                content.tfidf(counts, vocab, content.text_count(texts), text.sublinear_tf),
                "tfidf",
            )
        return cls(params, tables)

    def text_scores(self, queries: Queries, pool: DataFrame) -> DataFrame | None:
        if "tfidf" not in self.tables:
            return None
        return content.text_similarity(queries.items, pool, self.tables["tfidf"])


class DenseBoost(BlendedPool):
    """As ContentBoost, with dense item vectors in place of TF-IDF."""

    name: ClassVar[str] = "STBoost"

    @classmethod
    def fit(
        cls,
        items: DataFrame,
        catalog: DataFrame | None = None,
        vectors: DataFrame | None = None,
        cfg: BoostConfig = BoostConfig(0.5, 0.2, 0.3, score_metric="lift"),
        mined: DataFrame | None = None,
    ) -> DenseBoost:
        params, tables = _fit_common(items, catalog, cfg, mined)
        if catalog is not None and vectors is not None:
            described = content.with_text(catalog).select("item_id")
            tables["vectors"] = materialise(
                vectors.join(described, "item_id", "left_semi").select("item_id", "vec"),
                "item_vectors",
            )
        return cls(params, tables)

    def text_scores(self, queries: Queries, pool: DataFrame) -> DataFrame | None:
        if "vectors" not in self.tables:
            return None
        return content.dense_similarity(queries.items, pool, self.tables["vectors"])
