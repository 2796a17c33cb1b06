"""Document fingerprints by Order MinHash, in DataFrame operations only.

A text's five-word k-mers are numbered by occurrence, so a repeated k-mer is several
elements. For each of ``SKETCHES`` orders of the elements the two least are taken, put in
the order in which they stand in the text, and hashed as a pair. Two texts share
a sketch only if they share k-mers in the same order, which follows edit distance
better than the set of k-mers does.

The orders are rotations of one: elements are hashed once and sorted; order j begins at
j/SKETCHES of the hash range and goes round. So a text costs one sort, not one
pass per sketch.

Edge cases: a null text is an empty one; texts without words share one fingerprint; a
text of fewer than five words has one k-mer of all its words; with a single element a
pair is that element twice; repeated rows get equal fingerprints; extra columns pass
untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pannier.operators.numbering import number_rows
from pannier.session import materialise

WORDS = 5
SKETCHES = 32
_BITS = SKETCHES.bit_length() - 1
#: Documents whose ids share this many successive numbers lie together.
SPAN = 64


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once: a lambda variable of a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kmers(text: Column) -> Column:
    """Hashes of ``WORDS`` successive words; a shorter text has one k-mer."""
    words = F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""), lambda w: F.xxhash64(w))
    return _let(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WORDS)]),
        ),
    )


def _numbered(g: Column) -> Column:
    """Elements (v, x, o): the o-th occurrence of k-mer x, v its own hash; v = x for the first.

    Runs of the sorted k-mers give the numbers; time is linear but for the sort.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        )
        return _let(
            starts,
            lambda at: F.transform(
                at,
                lambda p, r: F.struct(
                    F.get(s, p).alias("x"), (F.coalesce(F.get(at, r + 1), F.size(s)) - p).alias("n")
                ),
            ),
        )

    def element(x: Column, o: Column) -> Column:
        return F.struct(F.when(o == 0, x).otherwise(F.xxhash64(x, o)).alias("v"), x.alias("x"), o.alias("o"))

    return F.flatten(
        F.transform(
            _let(F.sort_array(g), runs),
            lambda r: F.transform(F.sequence(F.lit(0), r["n"] - 1), lambda o: element(r["x"], o)),
        )
    )


def _pairs(v: Column) -> Column:
    """The ``SKETCHES`` pairs of least elements, from the sorted elements."""
    bins = F.transform(v, lambda x: F.shiftright(x, 64 - _BITS).cast("int") + SKETCHES // 2)
    # first element of each hash range; an empty range takes the next one's, round the end
    first = _let(
        bins,
        lambda b: F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda j: F.array_position(b, j).cast("int")),
    )
    start = lambda p, j: F.coalesce(F.get(F.filter(F.slice(p, j, SKETCHES), lambda q: q > 0), F.lit(0)), F.lit(1))
    starts = _let(first, lambda p: F.transform(F.sequence(F.lit(1), F.lit(SKETCHES)), lambda j: start(p, j)))
    return F.transform(starts, lambda q: F.struct(F.get(v, q - 1).alias("a"), F.get(v, q % F.size(v)).alias("b")))


def _hashed(pairs: Column, place) -> Column:
    ordered = F.transform(
        pairs,
        lambda d: F.when(place(d["a"]) <= place(d["b"]), F.xxhash64(d["a"], d["b"])).otherwise(
            F.xxhash64(d["b"], d["a"])
        ),
    )
    return F.transform(ordered, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))


def _of_repeated(g: Column) -> Column:
    """Sketches of a text with repeated k-mers."""

    def with_elements(e: Column) -> Column:
        def with_values(v: Column) -> Column:
            def nth(mine: Column) -> Column:
                places = F.filter(F.sequence(F.lit(1), F.size(g)), lambda i: F.element_at(g, i) == mine["x"])
                return F.when(mine["o"] == 0, F.array_position(g, mine["x"])).otherwise(
                    F.get(places, mine["o"]).cast("long")
                )

            def place(x: Column) -> Column:
                return _let(F.element_at(e, F.array_position(v, x).cast("int")), nth)

            return _hashed(_let(F.sort_array(v), _pairs), place)

        return _let(F.transform(e, lambda x: x["v"]), with_values)

    return _let(_numbered(g), with_elements)


def sketch(text: Column) -> Column:
    """``SKETCHES`` pair hashes of 32 bits each. Texts without repeated k-mers need no numbers."""
    return _let(
        _kmers(text),
        lambda g: F.when(
            F.size(F.array_distinct(g)) == F.size(g),
            _hashed(_let(F.sort_array(g), _pairs), lambda x: F.array_position(g, x)),
        ).otherwise(_of_repeated(g)),
    )


def sketched(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sketches of a column."""
    return df.withColumn(name, sketch(F.col(text)))


def as_text(name: str) -> Column:
    """The fingerprint: eight hexadecimal digits per sketch."""
    return F.array_join(F.transform(name, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal sketches, 0 to 1."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / float(SKETCHES)


def _edited() -> Column:
    taken = F.floor(F.col("n_chars") / 3).cast("int")
    return F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - taken),
        F.substring(F.col("next_text"), F.lit(1), taken),
    )


def _compared(df: DataFrame) -> DataFrame:
    """Edited text, its fingerprint and the likenesses, from a row with its successor's text and sketch."""
    made = sketched(df.withColumn("edited", _edited()), "edited", "edited_sketch")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Every document compared with its edited text and the next document by descending doc_id.

    Documents are laid together by spans of ``SPAN`` ids, which gives every successor but
    the last of a span in one shuffle and without a window over all rows; the first
    and last rows of spans, a small share, are matched in a second step.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("n_chars", F.char_length("text").cast("long"))
    base = sketched(base, "text", "sketch")
    # null ids follow all others, in slices by text
    span = F.coalesce(
        F.floor(F.col("doc_id") / SPAN), F.lit(-(1 << 60)) - F.pmod(F.xxhash64("text"), F.lit(1 << 14))
    ).cast("long")
    base = base.withColumn("span", span).withColumn("tie", F.xxhash64("text"))
    inside = Window.partitionBy("span").orderBy(F.col("doc_id").desc_nulls_last(), "tie")
    laid = base.select(
        "*",
        F.row_number().over(inside).alias("at"),
        F.lead("text").over(inside).alias("next_text"),
        F.lead("sketch").over(inside).alias("next_sketch"),
    )
    ends = F.col("next_text").isNull()
    # a last row is compared with itself here and again, with its successor, below
    filled = (
        laid.withColumn("last", ends)
        .withColumn("head_text", F.when(F.col("at") == 1, F.col("text")))
        .withColumn("tail_text", F.when(ends, F.col("text")))
        .withColumn("next_text", F.coalesce("next_text", F.lit("")))
        .withColumn("next_sketch", F.coalesce("next_sketch", "sketch"))
    )
    made = sketched(filled.withColumn("edited", _edited()), "edited", "edited_sketch").select(
        "doc_id", "n_chars", "span", "last", "head_text", "tail_text", "sketch",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
    made = materialise(made, "compared")
    heads = made.where(F.col("head_text").isNotNull()).select(
        "span", F.col("head_text").alias("next_text"), F.col("sketch").alias("next_sketch")
    )
    spans = materialise(
        number_rows(
            heads.select("span"), [], -F.floor(F.col("span") / 65536), [F.col("span").desc()], "rank", start=0
        ),
        "spans",
    )
    n = spans.count()
    following = spans.select(F.col("span").alias("after"), F.col("rank").alias("follows"))
    chain = spans.withColumn("follows", (F.col("rank") + 1) % max(n, 1)).join(following, "follows").select("span", "after")
    tails = (
        made.where("last")
        .select("doc_id", "n_chars", "span", "sketch", F.col("tail_text").alias("text"))
        .join(chain, "span")
        .drop("span")
        .join(heads.withColumnRenamed("span", "after"), "after")
    )
    rest = made.where(~F.col("last")).select(
        "doc_id", "n_chars", "edited_sha256", as_text("sketch").alias("fingerprint"),
        "edited_fingerprint", "near_edited", "near_next",
    )
    return rest.unionByName(_compared(tails))
