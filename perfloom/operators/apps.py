"""Processes grouped into applications: totals of concurrent instances per tick, then per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import zero_if_null
from ..functions.naming import IDLE_APP, app_key, display_name
from .offenders import MB, _axis, rank_axes
from .series import top_k


def app_ticks(process: DataFrame) -> DataFrame:
    """Sums over the concurrent processes of an application at each tick."""
    d = process.filter(F.col("rel_seconds").isNotNull())
    return d.groupBy("run_id", app_key("name").alias("app_key"), "rel_seconds").agg(
        F.sum(zero_if_null("cpu_pct")).alias("cpu_pct"),
        *[
            F.sum(F.coalesce(c, F.lit(0)).cast("double")).alias(c)
            for c in ("rss_bytes", "num_handles", "num_threads", "io_read_bps", "io_write_bps")
        ],
        (F.max(F.coalesce(F.col("is_target").cast("int"), F.lit(0))) == 1).alias("is_target"),
    )


def app_members(process: DataFrame) -> DataFrame:
    """All (run, application, pid), a row each."""
    d = process.filter(F.col("rel_seconds").isNotNull() & F.col("pid").isNotNull())
    return d.select("run_id", app_key("name").alias("app_key"), "pid").distinct()


def app_pids(process: DataFrame, listed: int | None = 25) -> DataFrame:
    """Distinct pids per application: their number and the first ``listed`` of them (None: all)."""
    pairs = app_members(process)
    counts = pairs.groupBy("run_id", "app_key").agg(F.count(F.lit(1)).alias("pid_count"))
    first = top_k(pairs, ["run_id", "app_key"], [F.asc("pid")], listed)
    first = first.groupBy("run_id", "app_key").agg(F.array_sort(F.collect_list("pid")).alias("pids"))
    return counts.join(first, ["run_id", "app_key"])


def app_aggregates(process: DataFrame, listed: int | None = 25) -> DataFrame:
    d = app_ticks(process).groupBy("run_id", "app_key").agg(
        F.count(F.lit(1)).alias("samples"),
        F.bround(F.avg("cpu_pct"), 2).alias("cpu_pct_avg"),
        F.max("cpu_pct").alias("cpu_pct_max"),
        F.bround(F.max("rss_bytes") / MB, 1).alias("rss_mb_max"),
        F.max("num_handles").cast("bigint").alias("num_handles_max"),
        F.max("num_threads").cast("bigint").alias("num_threads_max"),
        F.bround(F.avg("io_read_bps"), 1).alias("io_read_bps_avg"),
        F.bround(F.avg("io_write_bps"), 1).alias("io_write_bps_avg"),
        F.max("io_read_bps").alias("io_read_bps_max"),
        F.max("io_write_bps").alias("io_write_bps_max"),
        F.max("is_target").alias("is_target"),
        F.min("rel_seconds").alias("first_seen"),
        F.max("rel_seconds").alias("last_seen"),
    )
    d = d.join(app_pids(process, listed), ["run_id", "app_key"], "left")
    return d.withColumns(
        {
            "display_name": display_name("app_key"),
            "pid_count": F.coalesce("pid_count", F.lit(0)),
            "pids": F.coalesce("pids", F.array().cast("array<bigint>")),
        }
    )


APP_COLUMNS = ["app_key", "display_name", "pid_count", "samples", "cpu_pct_avg", "cpu_pct_max", "rss_mb_max",
               "num_handles_max", "num_threads_max", "io_read_bps_avg", "io_write_bps_avg"]


def rank_apps(aggregates: DataFrame, n: int = 10) -> DataFrame:
    """Five axes cut to ``n``, and ``all_apps`` uncut; idle time is not an application."""
    apps = aggregates.filter(F.col("app_key") != IDLE_APP)
    axes = [
        _axis("top_cpu", F.col("cpu_pct_avg"), F.col("cpu_pct_max")),
        _axis("top_rss", F.col("rss_mb_max")),
        _axis("top_handles", F.col("num_handles_max")),
        _axis("top_threads", F.col("num_threads_max")),
        _axis("top_io", F.col("io_read_bps_avg") + F.col("io_write_bps_avg")),
    ]
    ranked = rank_axes(apps, axes, "app_key", APP_COLUMNS, n)
    every = _axis("all_apps", F.col("cpu_pct_avg") + F.col("rss_mb_max") / 100)
    return ranked.unionByName(rank_axes(apps, [every], "app_key", APP_COLUMNS, None))
