"""Item counts, co-purchase pairs and association tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pannier.functions.scalar import association

# Baskets above this size are not paired inside one task.
LARGE_BASKET = 1000
# Items per side when a large basket is paired block by block.
PAIR_BLOCK = 512


def item_counts(items: DataFrame, item: str = "item_id") -> DataFrame:
    """Number of baskets per item (baskets are distinct already)."""
    return items.groupBy(item).agg(F.count(F.lit(1)).alias("freq"))


def group_sizes(items: DataFrame, group: str) -> DataFrame:
    return items.groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def _pairs_in_arrays(items: DataFrame, group: str, item: str) -> DataFrame:
    """Pairs of ordinary baskets: one shuffle, then two explodes."""
    packed = items.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("_all"))
    left = packed.select(F.posexplode("_all").alias("_at", "item_a"), "_all")
    return left.select(
        "item_a",
        F.explode(F.slice("_all", F.col("_at") + 2, F.size("_all"))).alias("item_b"),
    )


def _pairs_in_blocks(items: DataFrame, group: str, item: str) -> DataFrame:
    """Pairs of large baskets, spread over tasks.

    Items hash into blocks of about PAIR_BLOCK; two items meet under the key of
    their two blocks, so one key never sees more than one block from each side.
    """
    blocks = F.ceil(F.col("size") / PAIR_BLOCK).cast("long")
    placed = items.select(group, item, blocks.alias("_n")).withColumn(
        "_blk", F.pmod(F.xxhash64(item), F.col("_n"))
    )
    low = placed.select(
        group,
        F.col(item).alias("_x"),
        F.col("_blk").alias("_lo"),
        F.explode(F.sequence("_blk", F.col("_n") - 1)).alias("_hi"),
    )
    high = placed.select(
        group,
        F.col(item).alias("_y"),
        F.explode(F.sequence(F.lit(0).cast("long"), "_blk")).alias("_lo"),
        F.col("_blk").alias("_hi"),
    )
    met = low.join(high, [group, "_lo", "_hi"]).where(
        (F.col("_lo") < F.col("_hi")) | (F.col("_x") < F.col("_y"))
    )
    return met.select(
        F.least("_x", "_y").alias("item_a"), F.greatest("_x", "_y").alias("item_b")
    )


def _count(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("pair_count"))


def pair_counts(
    items: DataFrame,
    group: str = "order_id",
    item: str = "item_id",
    min_support: int = 1,
    large: int = LARGE_BASKET,
) -> DataFrame:
    """Number of baskets per unordered item pair with ``item_a < item_b``.

    ``items`` holds distinct (group, item) rows; its ``size`` column is used when
    present. Large baskets take a separate, equally exact route:

    * without a support threshold every pair is part of the result, so they are
      emitted block by block;
    * with one, pairs that some ordinary basket holds are looked up in the large
      baskets, and only items shared by enough large baskets are paired among
      themselves. A single giant basket then emits no pair of its own.
    """
    if "size" not in items.columns:
        items = items.join(group_sizes(items, group), group)
    items = items.select(group, item, "size").where("size > 1")
    huge = items.where(F.col("size") > large)
    has_huge = not huge.isEmpty()
    if min_support > 1:
        frequent = (
            item_counts(items, item).where(F.col("freq") >= min_support).select(item)
        )
        items = items.join(frequent, item, "left_semi")
        huge = items.where(F.col("size") > large)
    usual = items.where(F.col("size") <= large)
    small = _count(_pairs_in_arrays(usual, group, item))
    if not has_huge:
        return small.where(F.col("pair_count") >= min_support)
    if min_support <= 1:
        return _count(
            _pairs_in_arrays(usual, group, item).unionByName(
                _pairs_in_blocks(huge, group, item)
            )
        )
    member = huge.select(group, item)
    seen = (
        small.join(member.withColumnRenamed(item, "item_a"), "item_a")
        .join(member.withColumnRenamed(item, "item_b"), [group, "item_b"], "left_semi")
        .groupBy("item_a", "item_b")
        .agg(F.count(F.lit(1)).alias("_more"))
    )
    both = small.join(seen, ["item_a", "item_b"], "left").select(
        "item_a",
        "item_b",
        (F.col("pair_count") + F.coalesce("_more", F.lit(0))).alias("pair_count"),
    )
    shared = (
        member.groupBy(item)
        .agg(F.count(F.lit(1)).alias("_in"))
        .where(F.col("_in") >= min_support)
        .select(item)
    )
    among = _count(
        _pairs_in_blocks(huge.join(shared, item, "left_semi"), group, item)
    ).join(small, ["item_a", "item_b"], "left_anti")
    return both.unionByName(among).where(F.col("pair_count") >= min_support)


def partner_counts(
    items: DataFrame,
    group: str = "order_id",
    item: str = "item_id",
    large: int = LARGE_BASKET,
) -> DataFrame:
    """Number of distinct items each item shares a basket with: item, partners.

    An item of exactly one large basket has all of that basket as partners, plus
    those ordinary partners outside it: no pair of the large basket is needed.
    Only items of several large baskets are met with their members, block by block.
    """
    items = items.select(group, item, "size").where("size > 1")
    huge = items.where(F.col("size") > large)
    usual = both_ways(
        pair_counts(items.where(F.col("size") <= large), group, item, 1, large).drop("pair_count"),
        "item_a",
        "item_b",
        (item, "_other"),
    )

    def counted(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(item).agg(F.count(F.lit(1)).alias("partners"))

    if huge.isEmpty():
        return counted(usual)
    homes = huge.groupBy(item).agg(
        F.count(F.lit(1)).alias("_n"), F.max(group).alias("_g"), F.max("size").alias("_size")
    )
    tagged = usual.join(homes.select(item, "_n", "_g"), item, "left")
    inside = huge.select(F.col(group).alias("_g"), F.col(item).alias("_other"))
    outside = counted(
        tagged.where("_n = 1").join(inside, ["_g", "_other"], "left_anti").select(item)
    )
    single = (
        homes.where("_n = 1")
        .join(outside, item, "left")
        .select(
            item, (F.col("_size") - 1 + F.coalesce("partners", F.lit(0))).alias("partners")
        )
    )
    several = homes.where("_n > 1").select(item)
    blocks = F.ceil(F.col("size") / PAIR_BLOCK).cast("long")

    def every() -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1))

    placed = huge.withColumn("_b", blocks).withColumn(
        "_at", F.pmod(F.xxhash64(item), F.col("_b"))
    )
    left = placed.join(several, item, "left_semi").select(
        group, item, F.col("_at").alias("_lo"), every().alias("_hi")
    )
    right = placed.select(
        group, F.col(item).alias("_other"), every().alias("_lo"), F.col("_at").alias("_hi")
    )
    met = left.join(right, [group, "_lo", "_hi"]).where(F.col(item) != F.col("_other"))
    among = counted(
        met.select(item, "_other").unionByName(tagged.where("_n > 1").select(item, "_other")).distinct()
    )
    return counted(tagged.where("_n is null").select(item)).unionByName(single).unionByName(among)


def pair_partners(mined: DataFrame, item: str = "item_id") -> DataFrame:
    """As ``partner_counts``, from the stored counts of all pairs."""
    ways = both_ways(mined.select("item_a", "item_b"), "item_a", "item_b", (item, "_other"))
    return ways.groupBy(item).agg(F.count(F.lit(1)).alias("partners"))


def both_ways(pairs: DataFrame, a: str, b: str, names: tuple[str, str]) -> DataFrame:
    """Each unordered pair in both directions, in one pass over the pairs."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    swapped = F.explode(
        F.array(
            F.struct(F.col(a).alias("x"), F.col(b).alias("y")),
            F.struct(F.col(b).alias("x"), F.col(a).alias("y")),
        )
    ).alias("_p")
    return pairs.select(swapped, *rest).select(
        F.col("_p.x").alias(names[0]), F.col("_p.y").alias(names[1]), *rest
    )


def scored_pairs(
    pairs: DataFrame, counts: DataFrame, total: DataFrame, metric: str, item: str = "item_id"
) -> DataFrame:
    """Attach the association score to counted pairs.

    ``total`` is a one-row table with the number of baskets in column ``n``.
    """
    left = counts.select(F.col(item).alias("item_a"), F.col("freq").alias("freq_a"))
    right = counts.select(F.col(item).alias("item_b"), F.col("freq").alias("freq_b"))
    n = F.col("_n")
    return (
        pairs.join(left, "item_a")
        .join(right, "item_b")
        .withColumn("_n", total.select(F.col("n").cast("double")).scalar())
        .select(
            "item_a",
            "item_b",
            "pair_count",
            association(
                metric, F.col("freq_a") / n, F.col("freq_b") / n, F.col("pair_count") / n
            ).alias("score"),
        )
    )


def basket_total(items: DataFrame, group: str = "order_id") -> DataFrame:
    return items.select(group).distinct().agg(F.count(F.lit(1)).alias("n"))


def association_table(
    items: DataFrame,
    counts: DataFrame,
    total: DataFrame,
    metric: str,
    min_support: int = 2,
    group: str = "order_id",
    mined: DataFrame | None = None,
) -> DataFrame:
    """Positive associations in both directions: item_id, other_id, pair_count, score.

    ``mined`` are the pair counts of these items, where they are stored already.
    """
    if mined is None:
        pairs = pair_counts(items, group, "item_id", min_support)
    else:
        pairs = mined.where(F.col("pair_count") >= min_support)
    kept = scored_pairs(pairs, counts, total, metric).where("score > 0")
    return both_ways(kept, "item_a", "item_b", ("item_id", "other_id"))


# Fixed value: affinity of a category with itself.
SAME_CATEGORY = 1.5


def category_affinity(
    items: DataFrame, catalog: DataFrame, total: DataFrame, group: str = "order_id"
) -> DataFrame:
    """Lift between categories of a basket; baskets without any category count too."""
    cats = (
        items.join(catalog.select("item_id", "category"), "item_id")
        .where(F.col("category").isNotNull())
        .select(group, "category")
        .distinct()
    )
    counts = item_counts(cats, "category")
    pairs = pair_counts(cats, group, "category")
    lifts = both_ways(
        scored_pairs(pairs, counts, total, "lift", "category").drop("pair_count"),
        "item_a",
        "item_b",
        ("cat_a", "cat_b"),
    )
    same = counts.select(
        F.col("category").alias("cat_a"),
        F.col("category").alias("cat_b"),
        F.lit(SAME_CATEGORY).alias("score"),
    )
    return lifts.unionByName(same).withColumnRenamed("score", "affinity")
