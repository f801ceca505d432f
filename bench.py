"""Times the headline queries; prints one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: local threads."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

from rivulet.plans import catalog

HEADLINE = [
    "edge_rollup", "entity_totals", "hop_both", "crawl_d2_edges", "crawl_capped", "ledger_page", "ledger_totals", "entity_search", "similarity_shortlist", "score_match",
    "name_normalize", "purge_source", "summary", "row_hash_dedupe",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):  # the first run compiles
            began = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 3)
    sf = folder.rpartition("/sf")[2]
    json.dump({"metric": "sum of median seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}, sys.stdout)
    print()
    spark.stop()


if __name__ == "__main__":
    main()
