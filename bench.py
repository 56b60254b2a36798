"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import Observation, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from commentloom.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "issue_distribution", "comments_long", "translated_wide", "detect_language", "store_missing",
    "embed_hash", "standardise", "pca_scores", "knn", "silhouette", "hdbscan", "kmeans_best_k",
    "cluster_labels", "term_table", "term_audit", "translate_glossary", "row_ids",
    "spanning_tree", "clusters", "cluster_summary", "layout",
)
# Dear queries are timed once; the others warm, as the median of three runs.
SLOW_S = 8.0


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("commentloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = only.split(",") if only else HEADLINE
    # One run off the clock starts the JVM's compilers and the Python workers.
    QUERIES["embedding_summary"](spark, folder).collect()
    times, rows = {}, {}
    for name in names:
        taken = []
        for _ in range(runs):
            seen = Observation()
            start = time.perf_counter()
            df = QUERIES[name](spark, folder).observe(seen, F.count(F.lit(1)).alias("rows"))
            df.write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
            if taken[0] > SLOW_S:
                break
        times[name], rows[name] = round(statistics.median(taken), 3), seen.get["rows"]
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows": rows,
                "spark": spark.version,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
