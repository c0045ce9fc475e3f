"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from mnemospark.session import local_session

#: One query for each channel, link type, graph search and lifecycle step.
HEADLINE = [
    "recall",
    "semantic_topk",
    "keyword_rank",
    "hybrid_rrf",
    "temporal_entry",
    "temporal_links",
    "entity_cooccurrence",
    "push_two_hops",
    "lifecycle_composite",
    "promotion_decision",
    "property_aggregation",
    "cluster_cohesion",
    "bank_stats",
    "token_budget",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    from mnemospark.plans.registry import QUERIES

    QUERIES["bank_stats"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM's and Python's workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
