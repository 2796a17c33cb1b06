"""Registered queries of the training-data operators; each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pannier.llm import (
    chat_template,
    collocations,
    decontaminate,
    merkle,
    mixing,
    near_dedup,
    omh_fingerprint,
    quality,
    simhash,
    suffix_dedup,
    token_files,
    url_rules,
    warc,
)

#: The host rules and the extra conversation of the registered queries.
HOST_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
EXTRA_TEXT = "\\### Assistant: </turn> ok"

#: The tokenizer file of the registered query; a parameter of the operator.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels no fit may see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh_fingerprint.with_next(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.described(spark, warc.write(table(spark, sf_dir, "pages")))


def op5_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], turns.schema)
    return chat_template.read_back(chat_template.written(turns.unionByName(extra)))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_rules.host_rule(*r) for r in HOST_RULES] + [url_rules.pattern_rule(*r) for r in url_rules.PATTERNS]
    return url_rules.judged(table(spark, sf_dir, "pages"), rules)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", held_out=held_out())
    scored = quality.score(docs.select("doc_id", "text"), machine)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), tokenizer_path()))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_order_minhash": op2_order_minhash,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_chat_template": op5_chat_template,
    "op6_url_rules": op6_url_rules,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_near_dedup": op9_near_dedup,
    "op10_token_files": op10_token_files,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_simhash": op12_simhash,
    "op13_collocations": op13_collocations,
}
