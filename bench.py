"""Time headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from perfloom.plans.catalog import QUERIES

HEADLINE = [
    "percentile_linear", "merge_windows", "moving_average", "cpu_sustained_high", "cpu_single_core_saturation",
    "detect_anomalies", "slowdown_windows", "slowdown_latency_hits", "slowdown_offenders", "trend_stats", "detect_leaks",
    "per_pid_aggregates", "rank_offenders", "app_aggregates", "rank_apps", "system_rates", "process_io_rates",
    "candidate_processes", "process_snapshot_diff", "disk_io_by_process", "connections_by_pid", "latency_by_target",
    "gpu_process_memory", "correlate_events", "top_apps_stack", "run_scores",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("perfloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session()
    run(spark, "series_summary", folder)  # start-up is not part of any query
    times = {name: round(run(spark, name, folder), 3) for name in names}
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
