"""URL filters: pattern rules indexed by their rarest literal token, DataFrame operations only.

A rule is a pattern with literal tokens that every match must hold. The index
lists a rule under the one of its tokens that fewest URLs hold, so a common
token like ``com`` fetches only rules that have nothing rarer. URL tokens are
joined with the index; only the rules fetched that way run their regular expression.

Two kinds of rules:

* host rules ``host/path``: the host and its subdomains, and paths that start with
  the rule's path; they decide first, the longest wins (blocking first on a tie);
* patterns, for URLs that no host rule fits: ``||`` begins at a host label, ``^`` is a
  separator or the end, ``*`` anything; the longest that fits decides, otherwise
  the verdict is ``allow``.

Verdicts are found once per distinct URL, so a hot URL is judged once, and joined back.
Rules are broadcast up to ``BROADCAST_RULES`` of them; a longer list is
joined by shuffle, where its rare tokens keep partitions even.

Edge cases: a null URL, or one without ``://``, has an empty host and path and is
allowed unless a pattern fits; repeated rows are judged alike; an empty table
or rule list works; extra columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 50_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The method's own patterns.
PATTERNS = (
    ("block", ".ads-track."),
    ("block", "/ads/"),
    ("block", "/tracker/"),
    ("block", "/login^"),
    ("block", "/signup^"),
    ("block", "/casino/"),
    ("allow", "||docs.*/login^"),
)


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    by_host: bool


def host_rule(verdict: str, rule: str) -> Rule:
    """``host/path``; its last path token counts only if something ends it."""
    host, slash, path = rule.partition("/")
    host = host.translate(str.maketrans(_UPPER, _UPPER.lower()))
    whole = f"{host}/{path}"
    runs = [(m.group(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+", whole)]
    tokens = tuple(t.lower() for t, end in runs if end < len(whole))
    return Rule(f"{host}{slash}{path}", verdict, rf"\A(?:[^/]*\.)?{re.escape(whole)}", tokens, True)


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """A pattern over the lower-cased URL; tokens are runs that it closes on both sides."""
    anchored = pattern.startswith("||")
    body = pattern.lower().removeprefix("||")
    regex = "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\z)"}.get(c, re.escape(c)) for c in body)
    tokens = []
    for m in re.finditer(r"[a-z0-9]+", body):
        before = body[m.start() - 1] if m.start() else ("^" if anchored else "*")
        after = body[m.end()] if m.end() < len(body) else "*"
        if "*" not in (before, after):
            tokens.append(m.group())
    head = r"(?s)\A(?:[^/]*\.)?" if anchored else "(?s)"
    return Rule(pattern, verdict, head + regex, tuple(tokens), False)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, empty where it has none."""
    at = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, at, 1), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(text, at, 2)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.name, r.verdict, r.regex, list(r.tokens), r.by_host) for r in rules]
    return spark.createDataFrame(
        rows, "name string, rule_verdict string, regex string, tokens array<string>, by_host boolean"
    )


def judged(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages(page_id, url)``."""
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    table = rule_table(spark, rules)
    small = len(rules) <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda df: df)

    # what a pattern sees: the URL behind its scheme, lower-cased
    seen = F.lower(F.regexp_replace("url", r"(?s)\A.*?://", ""))
    distinct = rows.select("url", "host", "path").distinct().withColumn("seen", seen)
    tokens = distinct.withColumn(
        "token", F.explode(F.array_distinct(F.regexp_extract_all(F.concat("host", F.lit(" "), F.lower("path"), F.lit(" "), "seen"), F.lit("([a-z0-9]+)"), F.lit(1))))
    )
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    counts = tokens.join(hint(wanted), "token").groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    index = (
        table.select("name", "rule_verdict", "regex", "by_host", F.explode_outer("tokens").alias("token"))
        .join(counts, "token", "left")
        .groupBy("name", "rule_verdict", "regex", "by_host")
        .agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token")).alias("rarest"))
        .select("name", "rule_verdict", "regex", "by_host", F.col("rarest.token").alias("token"))
    )
    fetched = tokens.join(hint(index), "token")
    loose = [r for r in rules if not r.tokens]
    if loose:  # rules without a closed token meet every URL, as columns rather than as a join
        each = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("rule_verdict"), F.lit(r.regex).alias("regex"), F.lit(r.by_host).alias("by_host")) for r in loose])
        more = distinct.withColumn("r", F.explode(each)).select("url", "host", "path", "seen", "r.*")
        fetched = fetched.drop("token").unionByName(more)
    subject = F.when(F.col("by_host"), F.concat("host", "path")).otherwise(F.col("seen"))
    rank = F.struct(
        "by_host", F.length("name").alias("n"), (F.col("rule_verdict") == "block").alias("b"), "name", "rule_verdict"
    )
    best = (
        fetched.where(F.rlike(subject, F.col("regex")))
        .groupBy("url")
        .agg(F.max(rank).alias("best"))
        .select("url", "best.by_host", "best.name", "best.rule_verdict")
    )
    return rows.join(best, "url", "left").select(
        "page_id",
        "host",
        "path",
        F.when(F.col("by_host"), F.col("name")).alias("rule"),
        F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"),
    )
