"""Benchmark the headline queries; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default HEADLINE).
Each query is planned and executed in full into Spark's no-op sink (no rows
are collected); the time includes planning-time jobs such as sampling
bookkeeping and checkpoints.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from inferna.plans import catalog  # noqa: E402
from inferna.session import get_spark  # noqa: E402

HEADLINE = ["load_splits", "text_stats", "unique_sentences", "parse_trees", "syntactic_diff",
            "feature_align", "stratified_sample", "kfold_assign", "tfidf_l2", "mnb_predict",
            "cross_dataset_matrix", "knn_cosine", "embedding_pair_features"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    names = [n for n in names if n in catalog.QUERIES]
    spark = get_spark("inferna-bench", cpus=cpus)
    # warm-up: JVM start, first parquet footer reads
    catalog.QUERIES["text_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
