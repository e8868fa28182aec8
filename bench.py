"""Time the headline queries: one warm run, then the median of the next two. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from ripplegraph.plans.registry import QUERIES
from ripplegraph.session import build_session

HEADLINE = [
    "news_features", "propagation_order", "propagation_order_ties", "user_index", "user_features", "tweet_features",
    "cascade_edges", "heuristic_edges", "pattern_match", "popular_star", "all_edges_lookback", "user_interaction",
    "news_text_stats", "writing_style", "node_degree", "cascade_depth", "local_influence", "write_graphs",
    "gcn_propagate", "gat_attention", "mean_max_pool", "stratified_split", "auc", "classification_report",
    "feature_importance", "confidence_histogram", "dangling_edges",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
                                      "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in names:
        runs = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of warm medians",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
