"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query writes its
whole result to the no-op sink. ``prepare`` is the stored snapshot the later
queries start from; a query's own fit is part of its time.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from pannier.plans.queries import QUERIES, Workspace

HEADLINE = (
    "basket_dedup",
    "temporal_split",
    "user_histories",
    "pair_counts",
    "assoc_npmi",
    "category_lift",
    "popularity_rank",
    "l1o_items",
    "top_popular_recs",
    "cooc_recs",
    "session_recs",
    "content_boost_recs",
    "dense_boost_recs",
    "popularity_rerank",
    "rrf_ensemble",
    "tfidf_documents",
    "dense_cosine_topk",
    "eval_hit_mrr",
    "debiased_metrics",
    "weight_grid",
    "item_features",
    "user_features",
    "candidate_features",
    "item2vec_recs",
    "als_recs",
    "bpr_recs",
    "graph_walk_recs",
    "lambdarank_recs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pannier-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def clock(name: str, work) -> None:
        start = time.perf_counter()
        work()
        took[name] = round(time.perf_counter() - start, 3)

    spark.range(1000).selectExpr("sum(id)").collect()
    workspace = Workspace.of(spark, sf_dir)
    clock("prepare", lambda: workspace.prepared)
    for name in HEADLINE:
        clock(
            name,
            lambda name=name: QUERIES[name](spark, sf_dir)
            .write.format("noop")
            .mode("overwrite")
            .save(),
        )
    n_cases = workspace.test.cases.count()
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": float(scale.group(1)) if scale else None,
                "scored_baskets": n_cases,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
