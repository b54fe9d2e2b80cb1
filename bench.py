"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line: the median of $BENCH_RUNS warm runs of each, 5 by default."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from lectern.plans.queries import queries

NAMES = ("html_strip", "token_counts", "dense_topk", "bm25_topk", "hybrid_fusion", "concept_index", "taxonomy_units", "chunk_notes")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = queries()
    took: dict[str, float] = {}
    for name in NAMES:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "5")) + 1):  # the first run compiles
            start = time.perf_counter()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(median(runs[1:] or runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
