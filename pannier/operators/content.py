"""Text and category signals for candidate items."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pannier.config import TextConfig
from pannier.functions.scalar import STOPWORDS, ngrams, words
from pannier.functions.vectors import dot, norm, sum_vectors, unit
from pannier.session import materialise, spread


def with_text(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.length("description") > 0)


def _terms(texts: DataFrame, cfg: TextConfig) -> DataFrame:
    """item_id, term for every occurrence of a word n-gram in the description."""
    stop = STOPWORDS if cfg.use_stopwords else ()
    dealt = spread(texts.select("item_id", "description"), "item_id")
    tokens = dealt.select("item_id", words(F.col("description"), stop).alias("_w"))
    return tokens.select("item_id", F.explode(ngrams(F.col("_w"), *cfg.ngram_range)).alias("term"))


def term_counts(texts: DataFrame, cfg: TextConfig) -> DataFrame:
    """item_id, term, n for every word n-gram of the description."""
    return _terms(texts, cfg).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))


def text_tables(texts: DataFrame, cfg: TextConfig) -> tuple[DataFrame, DataFrame]:
    """``term_counts`` of the vocabulary's terms, and the ``vocabulary``; both stored.

    The texts are read twice: terms are counted over all texts first, so only those
    of the vocabulary are counted by text, moved and stored.
    """
    terms = _terms(texts, cfg)
    totals = terms.groupBy("term").agg(F.count(F.lit(1)).alias("corpus_n"))
    most = totals.orderBy(F.col("corpus_n").desc(), "term").limit(cfg.max_features)
    most = materialise(most, "text_terms")
    counts = terms.join(most.select("term"), "term").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "text_counts")
    found = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts, materialise(most.join(found, "term"), "text_vocabulary")


def vocabulary(counts: DataFrame, max_features: int) -> DataFrame:
    """The ``max_features`` terms with the highest corpus count, with document frequency."""
    totals = counts.groupBy("term").agg(
        F.sum("n").alias("corpus_n"), F.count(F.lit(1)).alias("df")
    )
    return totals.orderBy(F.col("corpus_n").desc(), "term").limit(max_features)


def tfidf(counts: DataFrame, vocab: DataFrame, n_texts: DataFrame, sublinear: bool) -> DataFrame:
    """L2-normalised weights item_id, term, weight; idf = ln((1 + n) / (1 + df)) + 1."""
    tf = 1 + F.log(F.col("n").cast("double")) if sublinear else F.col("n").cast("double")
    idf = F.log((1 + F.col("_docs")) / (1 + F.col("df"))) + 1
    raw = (
        counts.join(vocab.select("term", "df"), "term")
        .withColumn("_docs", n_texts.scalar())
        .select("item_id", "term", (tf * idf).alias("w"))
    )
    lengths = raw.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_len"))
    return raw.join(lengths, "item_id").select(
        "item_id", "term", (F.col("w") / F.col("_len")).alias("weight")
    )


def text_count(texts: DataFrame) -> DataFrame:
    return texts.agg(F.count(F.lit(1)).alias("n"))


def text_similarity(items: DataFrame, pool: DataFrame, weights: DataFrame) -> DataFrame:
    """Cosine of the basket's mean TF-IDF vector with each pool item that has a text.

    The number of basket texts cancels in the cosine, so sums do. Item vectors
    have length 1 (or 0 without any vocabulary term).
    """
    mine = (
        items.join(weights, "item_id")
        .groupBy("query_id", "term")
        .agg(F.sum("weight").alias("q"))
    )
    length = mine.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("_len"))
    dots = (
        pool.select("query_id", "item_id")
        .join(weights, "item_id")
        .join(mine, ["query_id", "term"])
        .groupBy("query_id", "item_id")
        .agg(F.sum(F.col("weight") * F.col("q")).alias("d"))
    )
    return dots.join(length, "query_id").select(
        "query_id", "item_id", (F.col("d") / F.col("_len")).alias("text")
    )


def dense_similarity(items: DataFrame, pool: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of the basket's mean dense vector with each pool item that has a vector."""
    mine = (
        items.join(vectors, "item_id")
        .groupBy("query_id")
        .agg(sum_vectors(F.col("vec")).alias("_q"))
        .withColumn("_qn", norm(F.col("_q")))
    )
    ready = vectors.select("item_id", "vec", norm(F.col("vec")).alias("_n"))
    length = F.col("_qn") * F.col("_n")
    return (
        pool.select("query_id", "item_id")
        .join(ready, "item_id")
        .join(mine, "query_id")
        .select(
            "query_id",
            "item_id",
            F.when(length > 0, dot(F.col("_q"), F.col("vec")) / length)
            .otherwise(F.lit(0.0))
            .alias("text"),
        )
    )


def category_scores(
    items: DataFrame, pool: DataFrame, catalog: DataFrame, affinity: DataFrame
) -> DataFrame:
    """Highest affinity between a basket category and the pool item's category.

    Affinities are looked up per distinct (query, category), not per pool item.
    """
    cats = catalog.where("category is not null").select("item_id", "category")
    mine = items.join(cats, "item_id").select(
        "query_id", F.col("category").alias("cat_a")
    ).distinct()
    theirs = pool.join(cats, "item_id").select(
        "query_id", "item_id", F.col("category").alias("cat_b")
    )
    best = (
        theirs.select("query_id", "cat_b")
        .distinct()
        .join(mine, "query_id")
        .join(affinity, ["cat_a", "cat_b"], "left")
        .groupBy("query_id", "cat_b")
        .agg(F.greatest(F.lit(0.0), F.coalesce(F.max("affinity"), F.lit(0.0))).alias("category"))
    )
    return theirs.join(best, ["query_id", "cat_b"]).select("query_id", "item_id", "category")


def encode_texts(
    texts: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    prefix: str = "query: ",
    batch_size: int = 256,
) -> DataFrame:
    """Normalised dense vectors of descriptions from a user's encoder.

    ``make_encoder`` runs once per Python worker and returns ``texts -> matrix``.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            rows = list(batch)
            parts = [
                np.asarray(encoder(rows[i : i + batch_size]), dtype=np.float32)
                for i in range(0, len(rows), batch_size)
            ]
            matrix = np.vstack(parts) if parts else np.zeros((0, 1), dtype=np.float32)
            length = np.linalg.norm(matrix, axis=1, keepdims=True)
            yield pd.Series(list(matrix / np.where(length > 0, length, 1.0)))

    text: Column = F.concat(F.lit(prefix), "description") if prefix else F.col("description")
    return with_text(texts).select("item_id", encode(text).alias("vec"))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select("item_id", unit(F.col("vec")).alias("vec"))
