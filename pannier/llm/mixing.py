"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Document rates r_i stay as close to 1 as they can in relative entropy,

    minimise  sum_i r_i log r_i - r_i   subject to   sum_{i in s} size_i r_i = t_s,  r_i <= cap,

whose dual is convex with one multiplier per source; its solution is the tilt
r_i = min(cap, exp(lambda_s * size_i / scale_s)). Newton iterations on the dual run
over all sources at once: documents are first reduced to cells (source, size)
with counts, and an iteration is one aggregation of the cells (gradient and
curvature per source) and one step per source, kept inside a bracket so that it
cannot leave the region where the dual still curves.

Rates become copies by rounding along the sizes: inside a source the cumulated
rates are rounded, so the words taken follow the target closely, and a few
exchange rounds move single copies until the rest is below the smallest useful
document. Which documents of a cell get the extra copy follows a hash of their
id. Cells are cut into shares of about ``SHARE`` documents before rows are ranked,
so no cell, however hot, meets in one task. No step uses random numbers.

Edge cases: a null text has size 0 and is never needed (0 or 1 copies); a null
source is a source of its own, after all others; a source whose target is its
ceiling gives every document ``cap`` copies; an empty table gives an empty table;
repeated rows are documents of their own; extra columns pass untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pannier.operators.numbering import dense_index, number_rows
from pannier.session import materialise

CAP = 3
#: Documents of one cell that are ranked together.
SHARE = 4096
NEWTON_STEPS = 60
EXCHANGES = 12


def size_of(text: str = "text") -> Column:
    """Words: maximal runs of anything but blanks and the controls 9 to 13 (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """Add ``target`` to (source, source_size, weight).

    Shares of the whole by weight, none above ``cap`` times its source; what is cut
    goes to the others by weight. The common level t in min(cap * size, t * weight)
    is found by repeated aggregation; only its scalars reach the driver.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, ceiling = 0.0, F.col("source_size") * float(cap)
    while True:
        full = ceiling <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, ceiling)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        new = max(0.0, total - row["fixed"]) / row["open"] if row["open"] else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return sources.withColumn("target", F.least(ceiling, F.lit(level) * F.col("weight")))


def source_weights(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, weight): sources in code point order, null last, weights in turn."""
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # blocks of a code point order: null apart, then the first bytes
    block = F.struct(F.col("source").isNull().alias("a"), F.substring(F.coalesce("source", F.lit("")), 1, 2).alias("b"))
    ranked = number_rows(
        sums, [], block, [F.col("source").isNull(), F.col("source")], "_rank", start=0
    )
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.select(
        "source", "source_size", F.element_at(turn, (F.col("_rank") % len(weights) + 1).cast("int")).alias("weight")
    )


def _rate(cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))))


def tilt(cells: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """Multiplier per source: (sid, lam, scale, target).

    ``cells`` (sid, size, n) and ``goals`` (sid, source_size, docs, target) are stored
    tables. Sources at their ceiling or without words need no iteration.
    """
    scale = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0))
    reached = F.col("target") >= F.col("source_size") * float(cap) * (1 - 1e-12)
    state = goals.select(
        "sid",
        "target",
        scale.alias("scale"),
        F.when(reached, 1e6).otherwise(0.0).alias("lam"),
        F.lit(-1e6).alias("low"),
        F.lit(1e6).alias("high"),
        (reached | (F.col("source_size") == 0)).alias("done"),
    )
    for step in range(NEWTON_STEPS):
        x = F.col("size") / F.col("scale")
        sums = (
            cells.where("size > 0")
            .join(state.where("not done"), "sid")
            .groupBy("sid")
            .agg(
                F.sum(F.col("n") * x * _rate(cap)).alias("mass"),
                F.sum(F.when(_rate(cap) < cap, F.col("n") * x * x * _rate(cap)).otherwise(0.0)).alias("bend"),
            )
        )
        gap = F.col("mass") - F.col("target") / F.col("scale")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / F.col("bend")
        middle = (
            F.when(low < -1e5, F.col("lam") * 2 - 1)
            .when(high > 1e5, F.col("lam") * 2 + 1)
            .otherwise((low + high) / 2)
        )
        new = F.when((F.col("bend") > 0) & (newton > low) & (newton < high), newton).otherwise(middle)
        met = F.abs(gap) * F.col("scale") <= F.greatest(F.col("target") * 1e-9, F.lit(1e-6))
        tight = (high - low) <= F.lit(1e-13) * F.greatest(F.abs(F.col("lam")), F.lit(1.0))
        open_ = ~F.col("done") & F.col("mass").isNotNull()
        state = materialise(
            state.join(sums, "sid", "left").select(
                "sid",
                "target",
                "scale",
                F.when(open_ & ~met, new).otherwise(F.col("lam")).alias("lam"),
                F.when(open_, low).otherwise(F.col("low")).alias("low"),
                F.when(open_, high).otherwise(F.col("high")).alias("high"),
                (F.col("done") | F.coalesce(met | tight, F.lit(True))).alias("done"),
            ),
            "tilt",
        )
        if step % 2 and state.where("not done").isEmpty():
            break
    return state.select("sid", "lam", "scale", "target")


def _rounded(cells: DataFrame, cap: float) -> DataFrame:
    """Add ``q``, the copies of all documents of a cell together.

    Fractions are cumulated along the sizes of a source, largest first; a source has
    at most as many cells as sizes and shares occur, not as many as documents.
    """
    along = Window.partitionBy("sid").orderBy(F.col("size").desc(), F.col("share"))
    return (
        cells.withColumn("want", F.col("rate") * F.col("n"))
        .withColumn("upto", F.sum("want").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("q", F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("want") + 0.5))
        .withColumn("q", F.greatest(F.lit(0), F.least("q", F.col("n") * int(cap))).cast("long"))
        .select("sid", "size", "share", "n", "q")
    )


def _exchanged(cells: DataFrame, goals: DataFrame, cap: int) -> DataFrame:
    """Move single copies until no move brings a source's words closer to its target.

    Each round takes, per source, the largest cell that fits into the rest and
    changes as many of its copies as the rest asks for.
    """
    for _ in range(EXCHANGES):
        sums = cells.groupBy("sid").agg(F.sum(F.col("size") * F.col("q")).alias("taken"))
        rest = goals.join(sums, "sid").select("sid", (F.col("target") - F.col("taken")).alias("rest"))
        room = F.when(F.col("rest") > 0, F.col("n") * cap - F.col("q")).otherwise(F.col("q"))
        best = materialise(
            cells.join(rest, "sid")
            .where((F.col("size") > 0) & (room > 0) & (F.col("size") < 2 * F.abs("rest")))
            .groupBy("sid")
            .agg(
                F.max(F.struct(F.least(F.col("size"), F.abs("rest")).alias("v"), "size", "share")).alias("b"),
                F.first("rest").alias("rest"),
            )
            .select("sid", F.col("b.size").alias("size"), F.col("b.share").alias("share"), "rest"),
            "moves",
        )
        if best.isEmpty():
            break
        moved = F.least(F.greatest(F.lit(1), F.round(F.abs("rest") / F.col("size"))), room) * F.signum("rest")
        cells = materialise(
            cells.join(best, ["sid", "size", "share"], "left").select(
                "sid", "size", "share", "n",
                (F.col("q") + F.coalesce(moved, F.lit(0.0))).cast("long").alias("q"),
            ),
            "copies",
        )
    return cells


def mixed(docs: DataFrame, cap: int = CAP, weights: tuple[float, ...] = (1, 2, 3), goal: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``goal`` (source, weight) replaces the weights in turn; a source that it lacks weighs 0.
    """
    slim = docs.select("doc_id", "source", size_of().alias("size"))
    cells = materialise(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    weighed = source_weights(cells, weights)
    if goal is not None:
        given = goal.select(F.col("source").alias("_g"), F.col("weight").cast("double").alias("_w"))
        weighed = weighed.join(given, F.col("source").eqNullSafe(F.col("_g")), "left").select(
            "source", "source_size", F.coalesce("_w", F.lit(0.0)).alias("weight")
        )
    goals = targets(materialise(weighed, "weights"), cap)
    counts = cells.groupBy("source").agg(F.sum("n").alias("docs"))
    named = dense_index(counts.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "key", "sid")
    name_of = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    goals = materialise(
        goals.withColumn("key", name_of)
        .join(named, "key")
        .join(counts.withColumn("key", name_of).drop("source"), "key")
        .select("key", "sid", "source_size", "docs", "target"),
        "goals",
    )
    keyed = cells.withColumn("key", name_of).join(goals.select("key", "sid"), "key").select("sid", "size", "n")
    keyed = materialise(keyed, "cells")
    lams = tilt(keyed, goals, cap)

    # documents of a cell in shares of about SHARE, by a hash of the id
    digest = F.xxhash64(F.lit(29), "doc_id")
    shares = keyed.withColumn("shares", F.ceil(F.col("n") / SHARE).cast("long"))
    slim = slim.withColumn("key", name_of).join(goals.select("key", "sid", "source_size", "target"), "key").drop("key")
    slim = slim.join(shares.select("sid", "size", "shares"), ["sid", "size"])
    slim = materialise(
        slim.withColumn("digest", digest).withColumn("share", F.pmod("digest", "shares")).drop("shares"), "slim"
    )
    split = slim.groupBy("sid", "size", "share").agg(F.count(F.lit(1)).alias("n"))
    rated = split.join(lams.select("sid", "lam", "scale"), "sid").withColumn("rate", _rate(cap))
    copies = _exchanged(materialise(_rounded(rated, cap), "copies"), goals, cap)
    return _place(slim, copies)


def _place(slim: DataFrame, copies: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    inside = Window.partitionBy("sid", "size", "share").orderBy("digest", "doc_id")
    return (
        slim.join(copies, ["sid", "size", "share"])
        .withColumn("rank", F.row_number().over(inside))
        .withColumn("copies", F.expr("q div n + cast(rank <= q % n as bigint)"))
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
        )
    )


def repeated(docs: DataFrame, cap: int = CAP, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, all columns as they came."""
    plan = mixed(docs, cap, weights)
    # rows of one id, source and size share their copies: the n-th such row gets the n-th count
    counts = plan.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    renamed = counts.withColumnsRenamed({"doc_id": "__id", "source": "__source", "size": "__size"})
    joined = docs.withColumn("__words", size_of()).join(
        renamed,
        F.col("doc_id").eqNullSafe(F.col("__id"))
        & F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("__words") == F.col("__size")),
    )
    own = F.when(F.col("__rows") == 1, F.col("__copies"))
    alike = Window.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    single = joined.where("__rows = 1").withColumn("__times", own)
    several = (
        joined.where("__rows > 1")
        .withColumn("__n", F.row_number().over(alike) - 1)
        .withColumn("__times", F.expr("__copies div __rows + cast(__n < __copies % __rows as bigint)"))
        .drop("__n")
    )
    names = [F.col(f"`{c}`") for c in docs.columns]
    return (
        single.unionByName(several)
        .where("__times > 0")
        .withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
        .select(*names)
    )
