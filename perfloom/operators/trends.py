"""Leak candidates: growth trends of memory, handles and threads per process."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import text_or_unknown
from ..thresholds import Thresholds
from .series import dense_index, grouped_moving_averages, r2, top_k

METRICS = ("rss_bytes", "num_handles", "num_threads")
SERIES = ("run_id", "pid")
KEYS = (*SERIES, "metric")
PLATEAU_TOLERANCE = 0.02


def _points(process: DataFrame, metrics: tuple[str, ...], th: Thresholds) -> DataFrame:
    """Series (run, pid, idx) of enough points, with their number n and the length w of the trailing means.

    The process table is sorted once for all metrics; a missing value counts as 0.
    """
    base = process.filter(F.col("pid").isNotNull() & F.col("rel_seconds").isNotNull()).select(
        "run_id", "pid", "rel_seconds", "row_ord", text_or_unknown("name").alias("name"),
        *[F.coalesce(F.col(m).cast("bigint"), F.lit(0)).alias(m) for m in metrics],
    )
    points = th.attach(dense_index(base, SERIES, size="n"), "trend_min_points").filter(F.col("n") >= F.col("th_trend_min_points")).drop("th_trend_min_points")
    return points.withColumn("w", F.greatest(F.lit(5), F.floor(F.col("n") / 20)).cast("bigint"))


def smoothed_series(process: DataFrame, metrics: tuple[str, ...] = METRICS, th: Thresholds = Thresholds()) -> DataFrame:
    """Series (run, pid, idx) with the trailing means of all metrics over max(5, n // 20) points."""
    return grouped_moving_averages(_points(process, metrics, th), metrics, "w", "n", SERIES)


def trend_stats(process: DataFrame, metrics: tuple[str, ...] = METRICS, th: Thresholds = Thresholds()) -> DataFrame:
    """Slope, fit, monotonicity, plateau, ends and peak of each smoothed series, a row per metric.

    The name of a series' last point is joined: a text among the figures would have Spark sort all points once more.
    """
    points = _points(process, metrics, th)
    s = grouped_moving_averages(points.drop("name"), metrics, "w", "n", SERIES)
    names = points.filter(F.col("idx") == F.col("n") - 1).select(*SERIES, F.col("name").alias("process_name"))

    def figures(m: str) -> list[Column]:
        smooth, end = F.col(f"smooth_{m}"), F.col(f"end_{m}")
        outside = F.abs(smooth - end) > F.abs(end) * PLATEAU_TOLERANCE
        return [
            F.regr_slope(smooth, "rel_seconds").alias(f"{m}_slope"),
            r2(f"smooth_{m}", "rel_seconds").alias(f"{m}_r2"),
            F.avg(F.when(F.col("idx") > 0, (smooth >= F.col(f"prev_{m}")).cast("double"))).alias(f"{m}_mono"),
            F.min_by(smooth, "idx").alias(f"{m}_start_val"),
            F.max(end).alias(f"{m}_end_val"),
            F.max(smooth).alias(f"{m}_peak_val"),
            F.max(F.when(outside, F.col("idx"))).alias(f"{m}_out"),
        ]

    stats = s.groupBy(*SERIES, "n").agg(
        *[f for m in metrics for f in figures(m)],
        (F.max("rel_seconds") - F.min("rel_seconds")).alias("_span"),
    ).join(names, [*SERIES])
    figure_names = ("slope", "r2", "mono", "start_val", "end_val", "peak_val", "out")
    each = [F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}_{c}").alias(c) for c in figure_names]) for m in metrics]
    stats = stats.select(*SERIES, "n", "_span", "process_name", F.inline(F.array(*each))).filter("slope is not null")
    share = (F.col("n") - 1 - F.coalesce("out", F.lit(-1))) / F.col("n")
    return stats.select(
        *KEYS, "n", "end_val", "slope", "r2", "mono", "start_val", "peak_val", "process_name",
        F.when(F.col("end_val") > 0, share).otherwise(0.0).alias("plateau"),
        F.when(F.col("_span") > 0, F.col("_span")).otherwise(1.0).alias("duration"),
    )


def grade_confidence(slope: Column, unit: Column, growth_ratio: Column) -> Column:
    """Confidence tier from ``r2``, ``mono``, ``plateau`` and the slope; null when not a leak."""
    r2_, mono, plateau = F.col("r2"), F.col("mono"), F.col("plateau")
    ratio = slope / unit
    tier = (
        F.when((ratio >= 10) & (growth_ratio >= 0.5), F.lit(3))
        .when((ratio >= 3) & (growth_ratio >= 0.2), F.lit(2))
        .otherwise(F.lit(1))
    )
    # Each weak sign lowers one tier, in this order, so a tier can fall twice.
    tier = F.when((r2_ < 0.4) & (tier == 3), 2).otherwise(tier)
    tier = F.when((r2_ < 0.25) & (tier == 2), 1).otherwise(tier)
    tier = F.when((mono < 0.7) & (tier == 3), 2).otherwise(tier)
    tier = F.when((mono < 0.6) & (tier == 2), 1).otherwise(tier)
    disqualified = (slope < unit) | (mono < 0.55) | (plateau >= 0.35) | (r2_ < 0.15)
    names = F.element_at(F.array(F.lit("suspicious"), F.lit("likely"), F.lit("strong evidence")), tier)
    return F.when(~disqualified, names)


def _graded(stats: DataFrame, th, metric: str, slope: Column, unit: str, min_growth: str) -> DataFrame:
    d = th.attach(stats.filter(F.col("metric") == metric), unit, min_growth, "leak_min_duration_seconds")
    d = d.withColumns({"_slope": slope, "growth": F.col("end_val") - F.col("start_val")})
    d = d.withColumn("growth_ratio", F.when(F.col("start_val") > 0, F.greatest(F.col("growth"), F.lit(0.0)) / F.col("start_val")).otherwise(0.0))
    d = d.filter(
        (F.col("duration") >= F.col("th_leak_min_duration_seconds"))
        & (F.col("growth") >= F.col(f"th_{min_growth}"))
        & (F.col("_slope") >= F.col(f"th_{unit}"))
    )
    d = d.withColumn("confidence", grade_confidence(F.col("_slope"), F.col(f"th_{unit}"), F.col("growth_ratio")))
    return d.filter("confidence is not null")


LEAK_COLUMNS = ["run_id", "kind", "confidence", "pid", "process_name", "start_val", "end_val", "peak_val",
                "growth", "growth_ratio", "growth_per_min", "slope", "duration", "r2", "mono", "plateau"]


def memory_leaks(stats: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    d = _graded(stats, th, "rss_bytes", F.col("slope"), "leak_min_slope_bytes_per_sec", "leak_min_growth_bytes")
    return d.withColumns({"kind": F.lit("memory_leak_candidate"), "growth_per_min": F.col("slope") * 60}).select(*LEAK_COLUMNS)


def _count_leaks(stats, th, metric, kind, suspicious, likely, min_growth, strong_extra) -> DataFrame:
    d = _graded(stats, th, metric, F.col("slope") * 60, suspicious, min_growth)
    d = th.attach(d, likely, "handle_strong_end")
    weak = F.col("confidence") == "suspicious"
    steep = (F.col("_slope") >= F.col(f"th_{likely}") * 3) & ~weak & strong_extra
    raised = (
        F.when(steep, "strong evidence")
        .when((F.col("_slope") >= F.col(f"th_{likely}")) & weak, "likely")
        .otherwise(F.col("confidence"))
    )
    return d.withColumns(
        {"confidence": raised, "kind": F.lit(kind), "growth_per_min": F.col("_slope")}
    ).select(*LEAK_COLUMNS)


def handle_leaks(stats: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    return _count_leaks(
        stats, th, "num_handles", "handle_leak_candidate", "handle_growth_per_min_suspicious",
        "handle_growth_per_min_likely", "handle_min_growth", F.col("end_val") > F.col("th_handle_strong_end"),
    )


def thread_leaks(stats: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    return _count_leaks(
        stats, th, "num_threads", "thread_leak_candidate", "thread_growth_per_min_suspicious",
        "thread_growth_per_min_likely", "thread_min_growth", F.lit(True),
    )


def detect_leaks(process: DataFrame, th: Thresholds = Thresholds(), stats: DataFrame | None = None) -> DataFrame:
    stats = trend_stats(process, th=th) if stats is None else stats
    return reduce(DataFrame.unionByName, [memory_leaks(stats, th), handle_leaks(stats, th), thread_leaks(stats, th)])


def rank_leaks(leaks: DataFrame) -> DataFrame:
    """Report order: memory by growth, handles and threads by growth per minute."""
    key = F.when(F.col("kind") == "memory_leak_candidate", F.bround(F.col("growth") / (1024 * 1024), 1)).otherwise(
        F.bround("growth_per_min", 1)
    )


    return top_k(leaks.withColumn("_key", key), ["run_id", "kind"], [F.desc("_key"), F.asc("pid")], None).drop("_key")
