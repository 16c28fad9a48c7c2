"""Processes ranked over a whole run, and process churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import text_or_unknown, zero_if_null
from ..functions.naming import BACKGROUND_NAMES, SECURITY_NAMES
from .series import top_k

MB = 1024 * 1024


def per_pid_aggregates(process: DataFrame) -> DataFrame:
    """One row per (run, pid): sums, peaks, ranges and the rounded averages used for ranking."""
    some_name = F.coalesce("name", F.lit("")) != ""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    last = [c for c in ("cpu_time_user", "cpu_time_system") if c in process.columns]
    # By name first: all that is aggregated there are numbers, which Spark updates in place; with a text among them
    # it would sort all rows. A process has few names, so few rows are left for the second step.
    parts = process.filter(F.col("pid").isNotNull()).groupBy("run_id", "pid", "name").agg(
        F.max(F.when(some_name, F.col("row_ord"))).alias("_named"),
        F.min("row_ord").alias("_first"),
        F.max("row_ord").alias("_last"),
        F.min_by("ppid", "row_ord").alias("ppid"),
        F.count(F.lit(1)).alias("samples"),
        F.sum(zero_if_null("cpu_pct")).alias("cpu_pct_sum"),
        F.max(zero_if_null("cpu_pct")).alias("cpu_pct_max"),
        F.max(F.coalesce("rss_bytes", F.lit(0))).alias("rss_bytes_max"),
        F.max(positive("num_handles")).alias("num_handles_max"),
        F.min(positive("num_handles")).alias("num_handles_min"),
        F.max(positive("num_threads")).alias("num_threads_max"),
        F.min(positive("num_threads")).alias("num_threads_min"),
        F.sum(zero_if_null("io_read_bps")).alias("io_read_bps_sum"),
        F.sum(zero_if_null("io_write_bps")).alias("io_write_bps_sum"),
        F.max(zero_if_null("io_read_bps")).alias("io_read_bps_max"),
        F.max(zero_if_null("io_write_bps")).alias("io_write_bps_max"),
        *([F.max(F.coalesce("vms_bytes", F.lit(0))).alias("vms_bytes_max")] if "vms_bytes" in process.columns else []),
        *[F.max_by(c, "row_ord").alias(f"{c}_last") for c in last],
        F.max(F.coalesce(F.col("is_target").cast("int"), F.lit(0))).alias("is_target"),
        F.min("rel_seconds").alias("first_seen"),
        F.max("rel_seconds").alias("last_seen"),
    )
    whole = lambda function, *columns: [function(c).alias(c) for c in columns]
    counts = ("num_handles_max", "num_threads_max"), ("num_handles_min", "num_threads_min")
    d = parts.groupBy("run_id", "pid").agg(
        F.coalesce(F.max_by("name", "_named"), F.lit("?")).alias("name"),
        F.min_by("ppid", "_first").alias("ppid"),
        *whole(F.sum, "samples", "cpu_pct_sum"),
        *whole(F.max, "cpu_pct_max", "rss_bytes_max"),
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts[0]],
        *[F.coalesce(F.min(c), F.lit(0)).alias(c) for c in counts[1]],
        *whole(F.sum, "io_read_bps_sum", "io_write_bps_sum"),
        *whole(F.max, "io_read_bps_max", "io_write_bps_max"),
        *(whole(F.max, "vms_bytes_max") if "vms_bytes" in process.columns else []),
        *[F.coalesce(F.max_by(f"{c}_last", "_last"), F.lit(0.0)).alias(f"{c}_last") for c in last],
        (F.max("is_target") == 1).alias("is_target"),
        *whole(F.min, "first_seen"),
        *whole(F.max, "last_seen"),
    )
    return d.withColumns(
        {
            "cpu_pct_avg": F.bround(F.col("cpu_pct_sum") / F.col("samples"), 2),
            "io_read_bps_avg": F.bround(F.col("io_read_bps_sum") / F.col("samples"), 1),
            "io_write_bps_avg": F.bround(F.col("io_write_bps_sum") / F.col("samples"), 1),
            "rss_mb_max": F.bround(F.col("rss_bytes_max") / MB, 1),
            "handle_growth": F.col("num_handles_max") - F.col("num_handles_min"),
            "thread_growth": F.col("num_threads_max") - F.col("num_threads_min"),
        }
    )


RANK_COLUMNS = [
    "pid", "name", "ppid", "samples", "cpu_pct_avg", "cpu_pct_max", "rss_mb_max", "num_handles_max",
    "handle_growth", "num_threads_max", "thread_growth", "io_read_bps_avg", "io_write_bps_avg", "is_target",
]


def _axis(name: str, first: Column, second: Column | None = None, only: Column | None = None) -> Column:
    entry = F.struct(
        F.lit(name).alias("axis"), first.cast("double").alias("k1"),
        (F.lit(0.0) if second is None else second.cast("double")).alias("k2"),
    )
    return entry if only is None else F.when(only, entry)


def rank_axes(df: DataFrame, axes: list[Column], tie: str, columns: list[str], n: int | None) -> DataFrame:
    """Long ranking (axis, rank): one shuffle for all axes, cut to ``n`` per group before it."""
    long = df.withColumn("_a", F.explode(F.array_compact(F.array(*axes))))
    long = long.select("run_id", "_a.*", *columns)
    return top_k(long, ["run_id", "axis"], [F.desc("k1"), F.desc("k2"), F.asc(tie)], n).select(
        "run_id", "axis", "rank", *columns
    )


def rank_offenders(aggregates: DataFrame, n: int = 10) -> DataFrame:
    io = F.col("io_read_bps_avg") + F.col("io_write_bps_avg")
    axes = [
        _axis("top_cpu", F.col("cpu_pct_avg"), F.col("cpu_pct_max")),
        _axis("top_rss", F.col("rss_mb_max")),
        _axis("top_handles", F.col("num_handles_max")),
        _axis("top_handle_growth", F.col("handle_growth"), only=F.col("handle_growth") > 0),
        _axis("top_threads", F.col("num_threads_max")),
        _axis("top_thread_growth", F.col("thread_growth"), only=F.col("thread_growth") > 0),
        _axis("top_io", io),
    ]
    return rank_axes(aggregates, axes, "pid", RANK_COLUMNS, n)


def security_offenders(aggregates: DataFrame, n: int = 10) -> DataFrame:
    mine = aggregates.filter(F.lower("name").isin(*SECURITY_NAMES))
    key = F.col("cpu_pct_avg") + F.col("io_read_bps_avg") / 1e6
    return rank_axes(mine, [_axis("security", key)], "pid", RANK_COLUMNS, n)


def background_offenders(aggregates: DataFrame, n: int = 10) -> DataFrame:
    mine = aggregates.filter(F.lower("name").isin(*BACKGROUND_NAMES))
    key = F.col("cpu_pct_avg") + F.col("rss_mb_max") / 100
    return rank_axes(mine, [_axis("background_noise", key)], "pid", RANK_COLUMNS, n)


def process_churn(events: DataFrame) -> DataFrame:
    """Starts and ends per run."""
    return events.groupBy("run_id").agg(
        F.count(F.when(F.col("event") == "process_started", 1)).alias("total_process_starts"),
        F.count(F.when(F.col("event") == "process_ended", 1)).alias("total_process_ends"),
    )


def top_spawners(events: DataFrame, n: int = 10) -> DataFrame:
    started = events.filter(F.col("event") == "process_started")
    counts = started.groupBy("run_id", text_or_unknown("name").alias("name")).agg(F.count(F.lit(1)).alias("starts"))
    return top_k(counts, ["run_id"], [F.desc("starts"), F.asc("name")], n)
