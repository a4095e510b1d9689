"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = ["evaluate_run", "episode_counts", "greedy_match", "nearest_boundary", "failure_classes", "paired_bootstrap",
             "clean_segments", "stitch_sheets", "state_segments", "annotate_strict", "session_segments", "frames_to_segments"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("spanlake-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             # Inputs this small would otherwise be coalesced to one core.
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from spanlake.plans.catalog import QUERIES

    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
