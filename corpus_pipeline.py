"""A training corpus from raw documents: each stage calls one operator of ``pannier.llm``.

Every stage reads all its predecessor wrote. All but the last return the columns
of documents; the last returns doc_id, start, n_tokens and ids_crc32 of the token
files. The quality machine is trained on documents, so no SQL twin exists for the
rows of ``run`` (ORACLE_SQL is None); tests check counts and ids of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pannier.llm import decontaminate, mixing, near_dedup, quality, token_files
from pannier.llm.queries import table, tokenizer_path
from pannier.session import materialise


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good (score of 0.5 or more)."""
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return quality.kept(docs, machine)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus, and where each document is in them."""
    return token_files.read(token_files.write(docs, tokenizer_path()))


STAGES = [
    ("quality_classifier", by_quality),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", to_weights),
    ("token_files", to_token_files),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
