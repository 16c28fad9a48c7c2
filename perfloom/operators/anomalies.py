"""Sustained-load, swap and network anomalies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import parse_semicolon_list, text_or_unknown, zero_if_null
from ..thresholds import Thresholds
from .segments import Series, measured_windows
from .series import indexed, percentile_linear

SPAN_COLUMNS = ["run_id", "kind", "severity", "start_idx", "end_idx", "start_rel", "end_rel", "samples", "peak_pct", "avg_pct"]


# kind -> (column, limit, shortest length, bridged gap, sentence)
LOADS = {
    "cpu_sustained_high": ("cpu_total_pct", "cpu_sustained_pct", "cpu_sustained_seconds", "cpu_merge_gap", "CPU stayed"),
    "memory_pressure": ("mem_percent", "mem_used_pct_high", "mem_sustained_samples", "mem_merge_gap", "Memory usage held"),
    "disk_active_high": ("disk_active_pct_est", "disk_active_pct", "disk_active_seconds", "disk_merge_gap", "Disk active time held"),
}


def load_anomalies(system: DataFrame, th=Thresholds(), kinds=tuple(LOADS)) -> DataFrame:
    """Sustained windows of load columns, merged, with peak and mean over the whole span.

    All kinds come from one pass over the chunks of a run (`segments`).
    """
    names = lambda position: [LOADS[k][position] for k in kinds]
    columns = [zero_if_null(LOADS[k][0]).alias(f"v_{k}") for k in kinds]
    rows = indexed(system, columns=["rel_seconds", *names(0)]).select("run_id", "idx", "rel_seconds", *columns)
    rows = th.attach(rows, *names(1), *names(2), *names(3))

    def series(frame):
        rel = frame["rel_seconds"].to_numpy("float64")
        for k in kinds:
            _, limit, least, gap, _ = LOADS[k]
            v = frame[f"v_{k}"].to_numpy()
            yield Series(k, v >= frame[f"th_{limit}"].iloc[0], int(frame[f"th_{least}"].iloc[0]), int(frame[f"th_{gap}"].iloc[0]), [v, v == v], [v, rel], [rel])

    d = measured_windows(rows, series, {"sums": ["total", "samples"], "peaks": ["peak_pct", "end_rel"], "lows": ["start_rel"]})
    d = d.withColumns({"kind": F.col("label"), "samples": F.col("samples").cast("bigint"), "avg_pct": F.col("total") / F.col("samples")})
    d = th.attach(d, *names(1), "mem_used_pct_critical", "disk_peak_high")
    limit = F.lit(None)
    for k in kinds:
        limit = F.when(F.col("kind") == k, F.col(f"th_{LOADS[k][1]}")).otherwise(limit)
    memory = F.when(F.col("peak_pct") >= F.col("th_mem_used_pct_critical"), "high").otherwise("medium")
    disk = F.when(F.col("peak_pct") > F.col("th_disk_peak_high"), "high").otherwise("medium")
    severity = F.when(F.col("kind") == "memory_pressure", memory).when(F.col("kind") == "disk_active_high", disk).otherwise("high")
    subject = F.lit(None).cast("string")
    for k in kinds:
        subject = F.when(F.col("kind") == k, LOADS[k][4]).otherwise(subject)
    text = F.format_string("%s at %.0f%% or more over %d samples, %.1f%% at most.", subject, limit.cast("double"), F.col("samples"), F.col("peak_pct"))
    return d.withColumns({"severity": severity, "description": text}).select(*SPAN_COLUMNS, "description")


def cpu_sustained_high(system: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    return load_anomalies(system, th, ("cpu_sustained_high",))


def memory_pressure(system: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    return load_anomalies(system, th, ("memory_pressure",))


def disk_active_high(system: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    return load_anomalies(system, th, ("disk_active_high",))


def cpu_single_core_saturation(system: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """A core pinned while the mean of all other cores' values in the span stays low."""
    cores = F.col("cpu_per_core_pct")
    if dict(system.dtypes)["cpu_per_core_pct"] == "string":
        cores = parse_semicolon_list(cores)
    rows = indexed(system, columns=["rel_seconds", "cpu_per_core_pct"]).select("run_id", "idx", "rel_seconds", cores.alias("cores"))
    rows = th.attach(rows, "cpu_single_core_pct", "cpu_single_core_seconds", "core_merge_gap")

    def series(frame):
        import numpy as np

        rel = frame["rel_seconds"].to_numpy("float64")
        limit, least, gap = (frame[f"th_{n}"].iloc[0] for n in ("cpu_single_core_pct", "cpu_single_core_seconds", "core_merge_gap"))
        listed = [() if c is None else c for c in frame["cores"]]
        sizes = np.array([len(c) for c in listed])
        values = np.zeros((len(listed), max(1, sizes.max())))
        there = np.arange(values.shape[1]) < sizes[:, None]
        values[there] = np.concatenate([np.asarray(c, np.float64) for c in listed])
        total = values.sum(1)
        for core in range(sizes.max()):
            own, others = values[:, core], sizes - there[:, core]
            yield Series(str(core), there[:, core] & (own >= limit), int(least), int(gap), [np.ones(len(rel)), total - own, others], [own, rel], [rel])

    spans = measured_windows(rows, series, {"sums": ["samples", "_others", "_n_others"], "peaks": ["peak_pct", "end_rel"], "lows": ["start_rel"]})
    spans = spans.withColumns({"core": F.col("label").cast("int"), "samples": F.col("samples").cast("bigint")})
    others = F.when(F.col("_n_others") > 0, F.col("_others") / F.col("_n_others")).otherwise(0.0)
    spans = th.attach(
        spans.withColumn("other_cores_avg_pct", others), "core_others_avg_below", "cpu_single_core_pct"
    )
    return (
        spans.filter(F.col("other_cores_avg_pct") < F.col("th_core_others_avg_below"))
        .withColumns(
            {
                "kind": F.lit("cpu_single_core_saturation"),
                "severity": F.lit("medium"),
                "description": F.format_string(
                    "Core %d ran at %.0f%% or more over %d samples; the others at %.1f%% on average.",
                    F.col("core"), F.col("th_cpu_single_core_pct").cast("double"),
                    F.col("samples"), F.col("other_cores_avg_pct"),
                ),
            }
        )
        .select(*SPAN_COLUMNS[:-1], "core", "other_cores_avg_pct", "description")
    )


def swap_usage(system: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    v = zero_if_null("swap_percent")
    d = system.groupBy("run_id").agg(F.max(v).alias("peak_pct"), F.avg(v).alias("avg_pct"))
    d = th.attach(d, "swap_peak_report", "swap_peak_medium")
    medium = F.col("peak_pct") > F.col("th_swap_peak_medium")
    return d.filter(F.col("peak_pct") > F.col("th_swap_peak_report")).select(
        "run_id",
        F.lit("swap_usage").alias("kind"),
        F.when(medium, "medium").otherwise("low").alias("severity"),
        "peak_pct", "avg_pct",
        F.format_string("Up to %.1f%% of swap was in use, %.1f%% on average.", F.col("peak_pct"), F.col("avg_pct")).alias("description"),
    )


def _target_latency(latency: DataFrame) -> DataFrame:
    d = latency.withColumn("target", text_or_unknown("target"))
    return d.groupBy("run_id", "target").agg(
        F.count("avg_ms").alias("_n_rtt"),
        F.avg("avg_ms").alias("avg_ms"),
        F.max("avg_ms").alias("peak_ms"),
        F.avg(zero_if_null("loss_pct")).alias("loss_pct"),
    )


def network_unreachable(latency: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    d = th.attach(_target_latency(latency), "unreachable_loss_pct")
    hit = (F.col("_n_rtt") == 0) & (F.col("loss_pct") > 0) & (F.col("loss_pct") >= F.col("th_unreachable_loss_pct"))
    return d.filter(hit).select(
        "run_id",
        F.lit("network_unreachable").alias("kind"),
        F.lit("high").alias("severity"),
        "target", "loss_pct",
        F.format_string("No probe of %s was answered; %.1f%% were lost.", F.col("target"), F.col("loss_pct")).alias("description"),
    )


def network_latency_spike(latency: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    d = th.attach(_target_latency(latency), "net_latency_ms_high", "net_latency_ms_critical", "spike_loss_pct")
    d = d.filter("_n_rtt > 0").withColumn(
        "severity",
        F.when(F.col("peak_ms") >= F.col("th_net_latency_ms_critical"), "high")
        .when(F.col("peak_ms") >= F.col("th_net_latency_ms_high"), "medium")
        .otherwise("low"),
    )
    d = d.filter((F.col("severity") != "low") | (F.col("loss_pct") >= F.col("th_spike_loss_pct")))
    named = latency.withColumn("target", text_or_unknown("target"))
    p95 = percentile_linear(named, "avg_ms", 0.95, ("run_id", "target"), "p95_ms")
    return d.join(p95, ["run_id", "target"]).select(
        "run_id",
        F.lit("network_latency_spike").alias("kind"),
        "severity", "target", "avg_ms", "p95_ms", "peak_ms", "loss_pct",
        F.format_string(
            "Probes of %s: %.1f ms on average, 95%% within %.1f ms, %.1f ms at most, %.1f%% lost.",
            "target", "avg_ms", "p95_ms", "peak_ms", "loss_pct",
        ).alias("description"),
    )


def detect_anomalies(system: DataFrame, latency: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """All anomaly kinds under one schema."""
    rows = indexed(system)
    found = [
        load_anomalies(rows, th),
        cpu_single_core_saturation(rows, th),
        swap_usage(rows, th),
        network_unreachable(latency, th),
        network_latency_spike(latency, th),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
