"""WARC archive addressed by content, as two stores joined on reading.

* payloads: each distinct payload's bytes once, under its SHA-256. A digest that two
  different payloads shared would be noticed (their SHA-1 and length are compared
  when they are merged) and stops the job.
* headers: one row per record with the exact bytes of its WARC header block.

Of records with equal payloads of at least ``least`` bytes the one with the smallest
page_id is a response, the others revisit it; smaller payloads are responses
all. A record is rebuilt by joining its header with its payload; a revisit's
original through the same digest. Merging payloads combines copies before the
shuffle, and the joins carry hot digests as many short header rows against
one row, which adaptive execution can split.

Edge cases: a null html is an empty payload; a null url leaves out its header line; line
breaks in a url are percent-encoded; rows that repeat page_id and payload are all
responses; a null page_id is never the smallest unless there is no other; an
empty table gives empty stores; extra columns are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pannier.session import run_dir

#: The base-32 alphabet of digests, the record version.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
LEAST = 0


def base32_sha1(data: Column) -> Column:
    """Upper-case base-32 of the SHA-1: eight groups of five hexadecimal digits, four letters each."""
    hexed = F.sha1(data)

    def letters(group: Column) -> Column:
        value = F.conv(F.substring(hexed, group * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(
            *[F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        )

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def header(least: int) -> Column:
    """Header block of a record, from page_id, url, n_bytes, sha1, first_id."""
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = (F.col("n_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", ident(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, _line("WARC-Refers-To", ident(F.col("first_id")))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit("\r\n"),
    ).cast("binary")


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> str:
    """Archive ``pages(page_id, url, html)``; the folder of the two stores."""
    spark = pages.sparkSession
    folder = folder or f"{run_dir(spark)}/warc-{uuid.uuid4().hex[:12]}"
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    same = (F.col("least_sha1") == F.col("most_sha1")) & (F.col("least_bytes") == F.col("most_bytes"))
    hexed = F.sha1("payload")
    merged = (
        rows.withColumn("sha1_hex", hexed)
        .withColumn("n_bytes", F.octet_length("payload").cast("long"))
        .groupBy("digest")
        .agg(
            F.first("payload").alias("payload"),
            F.min("page_id").alias("first_id"),
            F.min("sha1_hex").alias("least_sha1"),
            F.max("sha1_hex").alias("most_sha1"),
            F.min("n_bytes").alias("least_bytes"),
            F.max("n_bytes").alias("most_bytes"),
        )
        .withColumn("checked", F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("boolean")))
        .where("checked")
    )
    merged.select("digest", "payload", "first_id").write.parquet(f"{folder}/payloads")
    firsts = spark.read.parquet(f"{folder}/payloads").select("digest", "first_id")
    slim = rows.select(
        "page_id", "url", "digest", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes")
    )
    slim.join(firsts, "digest").select("page_id", "digest", header(least).alias("header")).write.parquet(f"{folder}/headers")
    return folder


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Exact bytes of every record: page_id, record (header, payload unless revisited, end)."""
    heads = spark.read.parquet(f"{folder}/headers")
    full = field("WARC-Type") == "response"
    bodies = spark.read.parquet(f"{folder}/payloads").select(F.col("digest").alias("of"), "payload")
    wanted = heads.withColumn("want", F.when(full, F.col("digest")))
    end = F.lit("\r\n\r\n").cast("binary")
    return wanted.join(bodies, F.col("want") == F.col("of"), "left").select(
        "page_id", F.concat("header", F.coalesce("payload", F.lit("").cast("binary")), end).alias("record")
    )


def originals(spark: SparkSession, folder: str) -> DataFrame:
    """The payload of every record, revisits included: page_id, payload."""
    bodies = spark.read.parquet(f"{folder}/payloads").select("digest", "payload")
    return spark.read.parquet(f"{folder}/headers").join(bodies, "digest").select("page_id", "payload")


def field(name: str) -> Column:
    """A field of the header block, null where it is missing."""
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def described(spark: SparkSession, folder: str) -> DataFrame:
    """What the archive says of every record.

    Length and digest are taken anew from the stored bytes, once per distinct
    payload, and joined to all its records; a header that disagrees stops the job.
    """
    heads = spark.read.parquet(f"{folder}/headers")
    bodies = spark.read.parquet(f"{folder}/payloads").select(
        "digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    ident = F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(-?[0-9]+)>$", 1)
    agrees = field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "payload_digest")
    return heads.join(bodies, "digest").select(
        "page_id",
        "payload_bytes",
        F.when(agrees, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its header"))).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(F.length(ident) > 0, ident).cast("long").alias("refers_to"),
    )
