"""Column expressions shared by the operators. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(salt: object, *keys: str | Column) -> Column:
    """A fixed pseudo-random hex string per key: same result in any run and any engine."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(
        F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(salt)))
    )


def association(metric: str, p_a: Column, p_b: Column, p_ab: Column) -> Column:
    """Lift, PMI or NPMI of two events; 0 where one of the probabilities is 0."""
    lift = p_ab / (p_a * p_b)
    if metric == "lift":
        score = lift
    elif metric == "pmi":
        score = F.log2(lift)
    elif metric == "npmi":
        width = -F.log2(p_ab)
        score = F.when(width > 0, F.log2(lift) / width).otherwise(0.0)
    else:
        raise ValueError(f"unknown association metric {metric!r}")
    return F.when((p_a > 0) & (p_b > 0) & (p_ab > 0), score).otherwise(F.lit(0.0))


def parse_timestamp(text: Column, formats: Sequence[str]) -> Column:
    """First format that fits; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


# A time of day with optional seconds, fraction and zone, as formats write it.
_CLOCK = "[ H:mm[:ss[.SSSSSSSSS]][ XXX][XXX][X]]"


def parse_mixed(text: Column) -> Column:
    """A time in any of the usual written forms; null when none fits.

    The shape of a value decides on its one parser: year first (with - or / and one or two
    digits a part), day.month.year, month/day/year (day first where the first number is
    above 12), a month's name, or digits only. ``T`` or blanks stand before the time of
    day, which may have seconds, a fraction, AM or PM, and a zone.
    """
    t = F.regexp_replace(F.trim(text), r"\s+", " ")
    t = F.regexp_replace(t, r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2})[Tt](?=\d)", "$1 ")
    named = F.regexp_replace(t, r"^(\d{1,2}) ([A-Za-z]{3,9})\.?,? (\d{4})", "$2 $1 $3")
    named = F.regexp_replace(named, r"^([A-Za-z]{3})[A-Za-z]*\.? (\d{1,2}),? (\d{4})", "$1 $2 $3")
    named = F.concat(F.initcap(F.substring(named, 1, 3)), F.substr(named, F.lit(4)))
    noon = F.upper(F.regexp_replace(t, r"(?i)(\d) ?([ap])\.?m\.?$", "$1 $2m"))
    half = t.rlike(r"(?i)\d ?[ap]\.?m\.?$")
    clock = F.when(half, noon).otherwise(t)

    def read(value: Column, day: str) -> Column:
        return F.when(half, F.try_to_timestamp(value, F.lit(day + " h:mm[:ss] a"))).otherwise(
            F.try_to_timestamp(value, F.lit(day + _CLOCK))
        )

    first = F.regexp_extract(t, r"^(\d{1,2})/", 1)
    return (
        F.when(t.rlike(r"^\d{4}[-/]\d{1,2}[-/]"), read(F.regexp_replace(clock, r"^(\d{4})[-/](\d{1,2})[-/]", "$1-$2-"), "y-M-d"))
        .when(t.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}"), read(clock, "d.M.y"))
        .when(
            t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"),
            F.when(first.cast("int") > 12, read(clock, "d/M/y")).otherwise(read(clock, "M/d/y")),
        )
        .when(t.rlike(r"^([A-Za-z]{3,9}|\d{1,2} [A-Za-z]{3,9})\.?,? \d"), F.try_to_timestamp(named, F.lit("MMM d y" + _CLOCK)))
        .when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
        .when(t.rlike(r"^\d{14}$"), F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")))
    )


# Blanks at either end of a text, including the Unicode ones.
_EDGE_BLANKS = r"^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$"


def strip_tags(text: Column) -> Column:
    """Remove HTML tags and outer blanks; null becomes the empty string."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", "")
    return F.regexp_replace(bare, _EDGE_BLANKS, "")


# The Russian function words left out of the text vocabulary.
STOPWORDS = (
    "и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то", "все", "она",
    "так", "его", "но", "да", "ты", "к", "у", "же", "вы", "за", "бы", "по", "только", "ее",
    "мне", "было", "вот", "от", "меня", "еще", "нет", "о", "из", "ему", "теперь", "когда",
    "даже", "ну", "вдруг", "ли", "если", "уже", "или", "ни", "быть", "был", "него", "до",
    "вас", "нибудь",
)


def words(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Lower-cased runs of at least two word characters, without the stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    if not stopwords:
        return found
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(found, lambda w: ~F.array_contains(stop, w))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All word n-grams of the lengths ``low..high``, joined by a blank."""

    def longer(shorter: Column, n: int) -> Column:
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        return F.zip_with(
            F.slice(shorter, F.lit(1), count),
            F.slice(tokens, F.lit(n), count),
            lambda head, word: F.concat_ws(" ", head, word),
        )

    grams = tokens
    parts = [tokens] if low == 1 else []
    for n in range(2, high + 1):
        grams = longer(grams, n)
        if n >= low:
            parts.append(grams)
    return F.concat(*parts)


def item_label(title: Column, item_id: Column) -> Column:
    return F.coalesce(title, F.concat(F.lit("Item #"), item_id.cast("string")))


def percent_change(value: Column, base: Column) -> Column:
    """``(value - base) / base`` in percent; 0 when the base is not positive."""
    return F.when(base > 0, (value - base) / base * 100).otherwise(F.lit(0.0))
