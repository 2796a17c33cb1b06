"""Features of query baskets, candidate items and model lists for the learned ranker."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pannier.operators.numbering import popularity_rank
from pannier.operators.pairs import item_counts, pair_partners, partner_counts
from pannier.session import materialise

USER_FEATURES = (
    "basket_size",
    "avg_item_popularity",
    "max_item_popularity",
    "min_item_popularity",
    "n_unique_categories",
    "dominant_category_ratio",
    "history_length",
    "history_unique_items",
    "repeat_ratio",
    "category_overlap",
    "category_overlap_ratio",
)

ITEM_FEATURES = (
    "item_popularity",
    "item_popularity_log",
    "item_popularity_rank",
    "description_length",
    "has_description",
    "category_size",
    "avg_basket_size",
    "cooccurrence_diversity",
)

UNKNOWN = "unknown"


def _category(rows: DataFrame, catalog: DataFrame | None) -> DataFrame:
    if catalog is None:
        return rows.withColumn("category", F.lit(UNKNOWN))
    return rows.join(catalog.select("item_id", "category"), "item_id", "left").withColumn(
        "category", F.coalesce("category", F.lit(UNKNOWN))
    )


def user_features(
    cases: DataFrame,
    items: DataFrame,
    counts: DataFrame,
    catalog: DataFrame | None = None,
    histories: DataFrame | None = None,
) -> DataFrame:
    """One row of USER_FEATURES per query; without a history those features are 0.

    cases: query_id, profile_id; items: query_id, item_id (repeats count);
    counts: item_id, freq; histories: profile_id, item_id (distinct).
    """
    known = _category(items.join(counts.select("item_id", "freq"), "item_id", "left"), catalog)
    per_category = known.groupBy("query_id", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("freq", F.lit(0))).alias("mass"),
        F.max(F.coalesce("freq", F.lit(0))).alias("top"),
        F.min(F.coalesce("freq", F.lit(0))).alias("low"),
    )
    basket = per_category.groupBy("query_id").agg(
        F.sum("n").cast("double").alias("basket_size"),
        (F.sum("mass") / F.sum("n")).alias("avg_item_popularity"),
        F.max("top").cast("double").alias("max_item_popularity"),
        F.min("low").cast("double").alias("min_item_popularity"),
        F.count(F.lit(1)).cast("double").alias("n_unique_categories"),
        (F.max("n") / F.sum("n")).alias("dominant_category_ratio"),
    )
    base = cases.select("query_id", "profile_id").join(basket, "query_id", "left")
    if histories is None:
        full = base
    else:
        who = cases.where("profile_id is not null").select("query_id", "profile_id")
        asked = who.select("profile_id").distinct()
        past = histories.select("profile_id", "item_id").join(asked, "profile_id", "left_semi")
        length = past.groupBy("profile_id").agg(F.count(F.lit(1)).alias("_length"))
        repeats = (
            items.join(who, "query_id")
            .join(past, ["profile_id", "item_id"], "left_semi")
            .groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("_repeats"))
        )
        past_cats = _category(past, catalog).select("profile_id", "category").distinct()
        overlap = (
            per_category.select("query_id", "category")
            .join(who, "query_id")
            .join(past_cats, ["profile_id", "category"], "left_semi")
            .groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("_overlap"))
        )
        full = (
            base.join(length, "profile_id", "left")
            .join(repeats, "query_id", "left")
            .join(overlap, "query_id", "left")
            .withColumn("history_length", F.col("_length").cast("double"))
            .withColumn("history_unique_items", F.col("_length").cast("double"))
            .withColumn("repeat_ratio", F.col("_repeats") / F.col("basket_size"))
            .withColumn("category_overlap", F.col("_overlap").cast("double"))
            .withColumn(
                "category_overlap_ratio", F.col("_overlap") / F.col("n_unique_categories")
            )
        )
    present = set(full.columns)
    return full.select(
        "query_id",
        *[
            (F.coalesce(F.col(f), F.lit(0.0)) if f in present else F.lit(0.0)).alias(f)
            for f in USER_FEATURES
        ],
    )


def item_features(
    items: DataFrame, catalog: DataFrame | None = None, group: str = "order_id", mined: DataFrame | None = None
) -> DataFrame:
    """One row of ITEM_FEATURES per item bought in training or listed in the catalog.

    ``mined`` are the counts of all pairs of these items, where they are stored already.
    """
    stats = items.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("freq"), F.avg("size").alias("avg_basket_size")
    )
    ranks = popularity_rank(materialise(item_counts(items), "item_counts"), start=0)
    partners = partner_counts(items, group) if mined is None else pair_partners(mined)
    bought = stats.join(ranks.select("item_id", "rank"), "item_id").join(
        partners, "item_id", "left"
    )
    n_items = ranks.agg(F.count(F.lit(1)))
    if catalog is None:
        full = bought.withColumn("description", F.lit("")).withColumn(
            "category_size", F.lit(0)
        )
    else:
        known = catalog.select(
            "item_id",
            F.coalesce("description", F.lit("")).alias("description"),
            F.coalesce("category", F.lit(UNKNOWN)).alias("category"),
        )
        sizes = known.groupBy("category").agg(F.count(F.lit(1)).alias("category_size"))
        full = bought.join(known.join(sizes, "category"), "item_id", "full")
    zero = F.lit(0)
    freq = F.coalesce("freq", zero).cast("double")
    text = F.coalesce("description", F.lit(""))
    return full.withColumn("_n", n_items.scalar()).select(
        "item_id",
        freq.alias("item_popularity"),
        F.log1p(freq).alias("item_popularity_log"),
        F.coalesce("rank", F.col("_n")).cast("double").alias("item_popularity_rank"),
        F.length(text).cast("double").alias("description_length"),
        (F.length(text) > 0).cast("double").alias("has_description"),
        F.coalesce("category_size", zero).cast("double").alias("category_size"),
        F.coalesce("avg_basket_size", F.lit(0.0)).alias("avg_basket_size"),
        F.coalesce("partners", zero).cast("double").alias("cooccurrence_diversity"),
    )


def candidate_scores(
    lists: Sequence[tuple[str, DataFrame]], n_candidates: int
) -> DataFrame:
    """Union of the models' lists as one wide row per (query, item).

    A model that did not propose the item scores 0 and ranks ``n_candidates``;
    its own ranks start at 0.
    """
    tagged = [
        df.select("query_id", "item_id", F.lit(name).alias("model"), "rank")
        for name, df in lists
    ]
    rows = reduce(DataFrame.unionByName, tagged)
    columns = []
    for name, _ in lists:
        rank = F.min(F.when(F.col("model") == name, F.col("rank")))
        columns += [
            F.coalesce(1.0 / rank, F.lit(0.0)).alias(f"score_{name}"),
            F.coalesce((rank - 1).cast("double"), F.lit(float(n_candidates))).alias(
                f"rank_{name}"
            ),
        ]
    return rows.groupBy("query_id", "item_id").agg(*columns)


def score_features(models: Sequence[str]) -> list[str]:
    return [f"{kind}_{m}" for m in models for kind in ("score", "rank")]


def label_candidates(
    candidates: DataFrame, cases: DataFrame, models: Sequence[str], n_candidates: int
) -> DataFrame:
    """Mark the held-out item and add it where no model proposed it.

    Queries without any candidate are left out.
    """
    held = cases.where("held_out is not null").select(
        "query_id", F.col("held_out").alias("item_id")
    )
    marked = candidates.join(
        held.withColumn("_hit", F.lit(1)), ["query_id", "item_id"], "left"
    ).withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")
    proposed = candidates.select("query_id").distinct()
    missing = held.join(proposed, "query_id", "left_semi").join(
        candidates.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti"
    )
    for m in models:
        missing = missing.withColumn(f"score_{m}", F.lit(0.0)).withColumn(
            f"rank_{m}", F.lit(float(n_candidates))
        )
    return marked.unionByName(missing.withColumn("label", F.lit(1)))


def with_features(
    candidates: DataFrame, users: DataFrame, items: DataFrame, n_items: DataFrame
) -> DataFrame:
    """Attach query and item features; unseen items get zeros and the last rank.

    The query's are attached last: a table that is wanted by query lies so then.
    """
    joined = candidates.join(items, "item_id", "left").join(users, "query_id", "left")
    joined = joined.withColumn("_n", n_items.scalar().cast("double")).withColumn(
        "item_popularity_rank", F.coalesce("item_popularity_rank", "_n")
    )
    return joined.drop("_n").fillna(0.0, [*USER_FEATURES, *ITEM_FEATURES])
