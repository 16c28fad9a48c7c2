"""Tables ready for charts: thinned series, heat map grid, stacked applications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import parse_semicolon_list, text_or_unknown, zero_if_null
from ..functions.naming import IDLE_APP
from .apps import app_ticks
from .offenders import MB
from .series import dense_index, indexed, top_k


def _sized(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with ``_n``, the row count of its series."""
    if "_n" in df.columns:
        return df
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(sizes, [*keys])


def downsample_max(df: DataFrame, x: str, ys: Sequence[str], target: int = 500, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """At most about ``target`` points per series: first x and highest y of each bucket."""
    d = _sized(indexed(df, keys), keys)
    step = F.col("_n") / target
    bucket = F.when(F.col("_n") <= target, F.col("idx")).otherwise(F.ceil((F.col("idx") + 1) / step) - 1)
    return d.groupBy(*keys, bucket.cast("bigint").alias("bucket")).agg(
        F.min_by(x, "idx").alias(x), *[F.max(y).alias(y) for y in ys]
    )


def core_heatmap(system: DataFrame, points: int = 400) -> DataFrame:
    """Core x time grid; more than ``points`` columns are folded by their maximum."""
    cores = F.col("cpu_per_core_pct")
    if dict(system.dtypes)["cpu_per_core_pct"] == "string":
        cores = parse_semicolon_list(cores)
    d = indexed(system).select("run_id", "idx", cores.alias("cores"))
    sizes = d.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("cores")).alias("_cores"))
    d = d.join(sizes, "run_id").filter("_cores > 0")
    fold = F.when(F.col("_n") > points, F.floor(F.col("_n") / points) + 1).otherwise(F.lit(1))
    d = d.withColumn("core", F.explode(F.sequence(F.lit(0), F.col("_cores") - 1)))
    return d.groupBy("run_id", "core", F.floor(F.col("idx") / fold).alias("slot")).agg(
        F.max(F.coalesce(F.get("cores", F.col("core")), F.lit(0.0))).alias("value")
    )


def top_apps_stack(process: DataFrame, k: int = 6, points: int = 400) -> DataFrame:
    """Top ``k`` applications by CPU and by memory at each kept tick; the rest as ``other``."""
    ticks = app_ticks(process).filter(F.col("app_key") != IDLE_APP).select(
        "run_id", "app_key", "rel_seconds", F.col("cpu_pct").alias("cpu"), (F.col("rss_bytes") / MB).alias("rss_mb")
    )
    # Idle time only hides an application, its ticks still count for the time axis.
    axis = process.filter("rel_seconds is not null").select("run_id", "rel_seconds").distinct()
    axis = dense_index(axis, ("run_id",), ("rel_seconds",), size="_n")
    every = F.when(F.col("_n") > points, F.floor(F.col("_n") / points) + 1).otherwise(F.lit(1))
    axis = axis.filter(F.col("idx") % every == 0).select("run_id", "rel_seconds")

    totals = ticks.groupBy("run_id", "app_key").agg(F.sum("cpu").alias("cpu"), F.max("rss_mb").alias("rss_mb"))
    long = totals.unpivot(["run_id", "app_key"], ["cpu", "rss_mb"], "metric", "total")
    top = top_k(long, ["run_id", "metric"], [F.desc("total"), F.asc("app_key")], k)
    names = top.select("run_id", "metric", "rank", F.col("app_key").alias("series"))

    values = ticks.unpivot(["run_id", "app_key", "rel_seconds"], ["cpu", "rss_mb"], "metric", "value")
    values = values.join(top.select("run_id", "metric", "app_key", "rank"), ["run_id", "metric", "app_key"], "left")
    values = values.withColumn("rank", F.coalesce("rank", F.lit(0)))
    # (metric, rank) slots that exist per run: the top applications, and 0 when the rest is not zero
    rest = values.filter("rank = 0 and value <> 0").select("run_id", "metric").distinct()
    slots = names.unionByName(rest.select("run_id", "metric", F.lit(0).alias("rank"), F.lit("other").alias("series")))
    shown = values.join(axis, ["run_id", "rel_seconds"], "left_semi")
    sums = shown.groupBy("run_id", "rel_seconds", "metric", "rank").agg(F.sum("value").alias("value"))
    # At most 2 * (k + 1) slots per run: the join adds the zeros of a tick, it does not multiply data.
    grid = axis.join(slots, "run_id")
    d = grid.join(sums, ["run_id", "rel_seconds", "metric", "rank"], "left")
    return d.select("run_id", "metric", "series", "rel_seconds", F.coalesce("value", F.lit(0.0)).alias("value"))


def top_process_series(process: DataFrame, k: int = 6, target: int = 300) -> DataFrame:
    """CPU series of the ``k`` processes with the largest CPU sum of each run, thinned."""
    d = process.filter("pid is not null").select(
        "run_id", "pid", "row_ord", text_or_unknown("name").alias("name"),
        zero_if_null("rel_seconds").alias("rel_seconds"), zero_if_null("cpu_pct").alias("cpu_pct"),
    )
    sums = d.groupBy("run_id", "pid").agg(F.sum("cpu_pct").alias("total"), F.max_by("name", "row_ord").alias("name"))
    top = top_k(sums, ["run_id"], [F.desc("total"), F.asc("pid")], k)
    mine = d.drop("name").join(top.select("run_id", "pid"), ["run_id", "pid"], "left_semi")
    rows = dense_index(mine, ("run_id", "pid"), ("rel_seconds", "row_ord", "cpu_pct"), size="_n")
    thin = downsample_max(rows, "rel_seconds", ["cpu_pct"], target, ("run_id", "pid"))
    return thin.join(top.select("run_id", "pid", "rank", "name"), ["run_id", "pid"])


def overlay_series(system: DataFrame, metric: str = "cpu_total_pct", points: int = 400) -> DataFrame:
    """Every ``n // points``-th sample of each run."""
    d = _sized(indexed(system).select("run_id", "idx", "rel_seconds", zero_if_null(metric).alias(metric)), ("run_id",))
    step = F.when(F.col("_n") > points, F.floor(F.col("_n") / points)).otherwise(F.lit(1))
    return d.filter(F.col("idx") % step == 0).select("run_id", "idx", zero_if_null("rel_seconds").alias("rel_seconds"), metric)


def throughput_series(system: DataFrame, target: int = 500) -> DataFrame:
    """Network and disk throughput in MB/s, thinned."""
    columns = {
        "sent_mb_s": "net_sent_bytes_per_sec", "recv_mb_s": "net_recv_bytes_per_sec",
        "read_mb_s": "disk_read_bytes_per_sec", "write_mb_s": "disk_write_bytes_per_sec",
    }
    have = {n: c for n, c in columns.items() if c in system.columns}
    d = indexed(system).select("run_id", "idx", "rel_seconds", *[(zero_if_null(c) / MB).alias(n) for n, c in have.items()])
    return downsample_max(d, "rel_seconds", list(have), target)
