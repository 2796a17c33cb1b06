"""Recommenders that compare item vectors: skip-gram vectors of baskets and of graph walks."""

from __future__ import annotations

from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pannier.config import EmbeddingConfig, GraphConfig
from pannier.functions import scalar
from pannier.functions.vectors import mean_vectors, sum_vectors
from pannier.operators.content import unit_vectors
from pannier.operators.context import array_words, basket_words, context_pairs, frequent_words
from pannier.operators.nearest import nearest
from pannier.operators.pairs import both_ways, pair_counts
from pannier.operators.topk import Queries, drop_owned, top_k
from pannier.operators.walks import random_walks
from pannier.recommend.base import Model
from pannier.recommend.blocks import BlockConfig, train_blocks
from pannier.session import materialise, spread

# Learning rate of word vectors.
RATE = 0.05


def word_vectors(words: DataFrame, cfg: EmbeddingConfig) -> DataFrame:
    """word, vec of every word of ``words(line, at, word)`` that occurs ``min_count`` times and has a neighbour."""
    pairs = context_pairs(frequent_words(words, cfg.min_count), cfg.window)
    train = BlockConfig(cfg.vector_size, cfg.epochs, RATE, 0.0, "skipgram", cfg.seed)
    return train_blocks(pairs, train, side="l").withColumnRenamed("id", "word")


def item_vectors(words: DataFrame, cfg: EmbeddingConfig) -> DataFrame:
    return word_vectors(words, cfg).select(F.col("word").alias("item_id"), "vec")


def text_vectors(texts: DataFrame, cfg: EmbeddingConfig, prefix: str = "") -> DataFrame:
    """Unit vectors of descriptions without an outside encoder: mean of trained word vectors.

    A word's vector meets each description that holds it once, with its count.
    """
    described = spread(texts.where(F.length("description") > 0), "item_id")
    text = F.concat(F.lit(prefix), "description") if prefix else F.col("description")
    lines = described.select("item_id", scalar.words(text).alias("words"))
    placed = materialise(array_words(lines, F.col("item_id"), "words"), "text_words")
    vectors = word_vectors(placed, cfg)
    counts = placed.groupBy("line", "word").agg(F.count(F.lit(1)).alias("n"))
    sums = (
        counts.join(vectors, "word")
        .select(F.col("line").alias("item_id"), "n", F.transform("vec", lambda x: x * F.col("n")).alias("vec"))
        .groupBy("item_id")
        .agg(sum_vectors(F.col("vec")).alias("vec"), F.sum("n").alias("n"))
    )
    return unit_vectors(sums.select("item_id", F.transform("vec", lambda x: x / F.col("n")).alias("vec")))


class VectorModel(Model):
    """Items nearest to the mean vector of the basket."""

    metric = "cosine"

    def query_vectors(self, queries: Queries) -> DataFrame:
        return (
            queries.items.join(self.tables["vectors"], "item_id")
            .groupBy("query_id")
            .agg(mean_vectors(F.col("vec")).alias("vec"))
        )

    def recommend(self, queries: Queries, k: int = 10) -> DataFrame:
        asks = materialise(
            self.query_vectors(queries)
            .join(queries.cases.select("query_id", "size"), "query_id")
            .select("query_id", "vec", (F.col("size") + k).alias("want")),
            "query_vectors",
        )
        found = nearest(asks, self.tables["vectors"], self.metric)
        return top_k(drop_owned(found, queries), k)


class Item2Vec(VectorModel):
    name: ClassVar[str] = "Item2Vec"

    @classmethod
    def fit(cls, items: DataFrame, cfg: EmbeddingConfig = EmbeddingConfig()) -> Item2Vec:
        lines = materialise(basket_words(items), "basket_words")
        return cls(tables={"vectors": materialise(item_vectors(lines, cfg), "item_vectors")})


def graph_edges(items: DataFrame, min_support: int = 2, mined: DataFrame | None = None) -> DataFrame:
    """Co-purchase graph in both directions: src, dst, weight; ``mined`` are the items' stored pair counts."""
    if mined is None:
        mined = pair_counts(items, min_support=min_support)
    pairs = mined.where(F.col("pair_count") >= min_support).withColumnRenamed("pair_count", "weight")
    return both_ways(pairs, "item_a", "item_b", ("src", "dst"))


class ItemGraphNode2Vec(VectorModel):
    name: ClassVar[str] = "ItemGraphNode2Vec"

    @classmethod
    def fit(
        cls, items: DataFrame, cfg: GraphConfig = GraphConfig(), mined: DataFrame | None = None
    ) -> ItemGraphNode2Vec:
        edges = materialise(graph_edges(items, cfg.min_support, mined), "graph_edges")
        walks = random_walks(edges, cfg.walk_length, cfg.num_walks, cfg.embedding.seed)
        lines = walks.select(
            F.struct("start", "walk").alias("line"), F.col("step").cast("long").alias("at"), F.col("node").alias("word")
        )
        return cls(
            tables={"vectors": materialise(item_vectors(lines, cfg.embedding), "graph_vectors")}
        )
