"""Rates, snapshot diffs and rollups of raw samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.coerce import parse_semicolon_list, text_or_unknown, zero_if_null
from ..functions.naming import CRITICAL_NAMES, VPN_MARKERS
from ..functions.session import written
from .series import clip, dense_index, top_k, with_neighbours

# counter -> (rate column, decimals)
SYSTEM_RATES = {
    "disk_read_bytes": ("disk_read_bytes_per_sec", 1),
    "disk_write_bytes": ("disk_write_bytes_per_sec", 1),
    "disk_read_count": ("disk_read_count_per_sec", 2),
    "disk_write_count": ("disk_write_count_per_sec", 2),
    "net_bytes_sent": ("net_sent_bytes_per_sec", 1),
    "net_bytes_recv": ("net_recv_bytes_per_sec", 1),
    "net_packets_sent": ("net_packets_sent_per_sec", 2),
    "net_packets_recv": ("net_packets_recv_per_sec", 2),
    "net_errin": ("net_errin_per_sec", 2),
    "net_errout": ("net_errout_per_sec", 2),
    "net_dropin": ("net_dropin_per_sec", 2),
    "net_dropout": ("net_dropout_per_sec", 2),
}
CPU_RATES = {"ctx_switches": "ctx_switches_per_sec", "interrupts": "interrupts_per_sec"}
ADAPTER_RATES = {
    "bytes_sent": 1, "bytes_recv": 1, "packets_sent": 2, "packets_recv": 2,
    "errin": 2, "errout": 2, "dropin": 2, "dropout": 2,
}
MIN_DT = 1e-3


def _dt(now: str, before: str) -> Column:
    return F.greatest(F.col(now) - F.col(before), F.lit(MIN_DT))


def system_rates(counters: DataFrame, at: str = "mono") -> DataFrame:
    """Cumulative system counters -> per-second rates; only the counters present are derived.

    The first sample has rate 0 (disk, network) or null (context switches, interrupts);
    negative rates are kept.
    """
    have = system_counters(counters.columns)
    d = dense_index(counters, order=(at, "row_ord"))
    d = with_neighbours(d, {f"_p_{c}": (lambda w, c=c: F.lag(c).over(w)) for c in [at, *have]})
    return system_rates_after(d, counters.columns, at)


def system_counters(columns: Sequence[str]) -> list[str]:
    return [c for c in [*SYSTEM_RATES, *CPU_RATES, "disk_busy_ms"] if c in columns]


def system_rates_after(d: DataFrame, columns: Sequence[str], at: str = "mono") -> DataFrame:
    """`system_rates` of rows that have the values of the sample before as ``_p_*``."""
    have = system_counters(columns)
    d = d.withColumn("_dt", _dt(at, f"_p_{at}"))
    out: dict[str, Column] = {}
    for c in have:
        rate = (F.col(c) - F.col(f"_p_{c}")) / F.col("_dt")
        if c in SYSTEM_RATES:
            name, digits = SYSTEM_RATES[c]
            out[name] = F.coalesce(F.bround(rate.cast("double"), digits), F.lit(0.0))
        elif c in CPU_RATES:
            out[CPU_RATES[c]] = F.bround(rate.cast("double"), 1)
        else:
            busy = clip((rate / 1000.0 * 100.0).cast("double"))
            out["disk_active_pct_est"] = F.when(F.col(f"_p_{c}").isNull(), 0.0).otherwise(F.bround(busy, 2))
    return d.withColumns(out).select(*[c for c in columns if c not in have], *out)


def previous_tick(df: DataFrame, tick: str, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Distinct ticks of each run with the one before (null for the first)."""
    ticks = dense_index(df.select(*keys, tick).distinct(), keys, (tick,))
    return with_neighbours(ticks, {"prev_tick": lambda w: F.lag(tick).over(w)}, keys).select(
        *keys, tick, "prev_tick"
    )


def adapter_rates(counters: DataFrame, at: str = "mono") -> DataFrame:
    """Per-adapter rates against the run's previous tick; 0 when the adapter was not in it."""
    have = [c for c in ADAPTER_RATES if c in counters.columns]
    now = counters.join(previous_tick(counters, at), ["run_id", at])
    before = counters.select(
        "run_id", "adapter", F.col(at).alias("prev_tick"), *[F.col(c).alias(f"_p_{c}") for c in have]
    )
    return adapter_rates_after(now.join(before, ["run_id", "adapter", "prev_tick"], "left"), counters.columns, at)


def adapter_rates_after(d: DataFrame, columns: Sequence[str], at: str = "mono") -> DataFrame:
    """`adapter_rates` of rows that have the run's previous tick and the adapter's values in it."""
    have = [c for c in ADAPTER_RATES if c in columns]
    d = d.withColumn("_dt", _dt(at, "prev_tick"))
    rates = {
        f"{c}_per_sec": F.coalesce(
            F.bround(F.greatest(F.lit(0.0), (F.col(c) - F.col(f"_p_{c}")) / F.col("_dt")), ADAPTER_RATES[c]), F.lit(0.0)
        )
        for c in have
    }
    rates = {n: F.when(F.col(f"_p_{n[:-8]}").isNull(), 0.0).otherwise(e) for n, e in rates.items()}
    return d.withColumns(rates).select(*[c for c in columns if c not in have], *rates)


def process_io_rates(counters: DataFrame, at: str = "mono") -> DataFrame:
    """Per-process I/O rates: growth since the process was last seen over the run's tick gap."""
    ticks = previous_tick(counters, at)
    have = [c for c in ("read_bytes", "write_bytes") if c in counters.columns]
    d = dense_index(counters, ("run_id", "pid"), (at, "row_ord"))
    d = with_neighbours(
        d, {f"_p_{c}": (lambda w, c=c: F.lag(c).over(w)) for c in have}, ("run_id", "pid")
    )
    return process_io_rates_after(d.join(ticks, ["run_id", at]), counters.columns, at)


def process_io_rates_after(d: DataFrame, columns: Sequence[str], at: str = "mono") -> DataFrame:
    """`process_io_rates` of rows that have the run's previous tick and the process's values before."""
    have = [c for c in ("read_bytes", "write_bytes") if c in columns]
    dt = F.coalesce(_dt(at, "prev_tick"), F.lit(1.0))
    out = {}
    for c in have:
        rate = F.greatest(F.lit(0.0), (F.col(c) - F.col(f"_p_{c}")) / dt)
        out[f"io_{c.split('_')[0]}_bps"] = F.when(F.col(f"_p_{c}").isNull(), 0.0).otherwise(rate)
    return d.withColumns(out).select(*[c for c in columns if c not in have], *out)


def latency_probe_summary(replies: DataFrame) -> DataFrame:
    """Reply times (array or ``;`` text) and the probe count -> average, extremes, loss, jitter."""
    times = F.col("raw_times_ms")
    if dict(replies.dtypes)["raw_times_ms"] == "string":
        times = parse_semicolon_list(times)
    d = replies.withColumn("_t", times.cast("array<double>"))
    n = F.size("_t")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    steps = F.zip_with(
        F.slice("_t", F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice("_t", F.lit(1), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.abs(a - b),
    )
    loss = F.when(F.col("count") > 0, F.bround((1 - n / F.col("count")) * 100, 1)).otherwise(0.0)
    return d.withColumns(
        {
            "avg_ms": F.when(n > 0, total("_t") / n),
            "min_ms": F.array_min("_t"),
            "max_ms": F.array_max("_t"),
            "jitter_ms": F.when(n >= 2, F.bround(total(steps) / (n - 1), 2)),
            "loss_pct": F.when(n > 0, loss).otherwise(100.0),
        }
    ).drop("_t")


def flag_target(process: DataFrame, name: str | None = None, pid: int | None = None, path: str | None = None) -> DataFrame:
    hit = F.lit(False)
    if pid is not None:
        hit = hit | (F.col("pid") == pid)
    if name:
        hit = hit | (F.lower(text_or_unknown("name")) == name.lower())
    if path and "exe" in process.columns:
        hit = hit | (F.lower(F.coalesce("exe", F.lit(""))) == path.lower())
    return process.withColumn("is_target", F.coalesce(hit, F.lit(False)))


def candidate_processes(
    snapshot: DataFrame, n: int = 20, by: Sequence[str] = ("run_id", "rel_seconds"),
    name: str | None = None, pid: int | None = None, path: str | None = None,
) -> DataFrame:
    """Pids to sample: top ``n`` by CPU, memory, handles and I/O, plus targets and critical names.

    I/O ranks by the bytes read and written so far; a table without these counters ranks by its rates.
    """
    counters = [c for c in ("io_read_bytes", "io_write_bytes") if c in snapshot.columns] or ["io_read_bps", "io_write_bps"]
    d = flag_target(snapshot, name, pid, path).select(
        *by, "pid", text_or_unknown("name").alias("name"), "is_target",
        zero_if_null("cpu_pct").alias("cpu"),
        F.coalesce(F.col("rss_bytes"), F.lit(0)).cast("double").alias("rss"),
        F.coalesce(F.col("num_handles"), F.lit(0)).cast("double").alias("handles"),
        reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)).cast("double") for c in counters]).alias("io"),
    )
    long = d.unpivot([*by, "pid", "name"], ["cpu", "rss", "handles", "io"], "axis", "value")
    ranked = top_k(long, [*by, "axis"], [F.desc("value"), F.desc("pid"), F.desc("name")], n)
    always = d.filter(F.col("is_target") | F.lower("name").isin(*CRITICAL_NAMES))
    return ranked.select(*by, "pid").union(always.select(*by, "pid")).distinct()


def snapshot_ticks(snapshots: DataFrame, tick: str = "snapshot_ord") -> DataFrame:
    """Distinct snapshots of each run, numbered from 0, with the one after (null for the last): a row per snapshot."""
    ticks = dense_index(snapshots.select("run_id", tick).distinct(), order=(tick,))
    ticks = with_neighbours(ticks, {"next_ord": lambda w: F.lead(tick).over(w)}, ahead=1)
    return written(ticks.select("run_id", tick, F.col("idx").alias("_t"), "next_ord"))


def process_snapshot_diff(snapshots: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Processes started and ended between consecutive snapshots (matched by pid only).

    The rows of a process in order of snapshot numbers are its presence; a start is a row without one in the snapshot
    before, an end a row without one in the snapshot after. Rows that repeat a pid within a snapshot count once.
    ``ticks``: the `snapshot_ticks` of the snapshots, if they are cheaper to get from elsewhere.
    """
    ticks = snapshot_ticks(snapshots) if ticks is None else ticks
    w = W.partitionBy("run_id", "pid").orderBy("_t", "name")
    d = snapshots.select("run_id", "snapshot_ord", "pid", "name").join(ticks, ["run_id", "snapshot_ord"])
    d = d.withColumns({"_before": F.lag("_t").over(w), "_after": F.lead("_t").over(w)})
    starts = (F.col("_t") > 0) & (F.coalesce("_before", F.lit(-1)) < F.col("_t") - 1)
    ends = F.col("next_ord").isNotNull() & F.coalesce(F.col("_after") > F.col("_t") + 1, F.lit(True))
    fired = F.array_compact(F.array(
        F.when(starts, F.struct(F.col("snapshot_ord").alias("at"), F.lit("process_started").alias("event"))),
        F.when(ends, F.struct(F.col("next_ord").alias("at"), F.lit("process_ended").alias("event"))),
    ))
    return d.select("run_id", "pid", "name", F.explode(fired).alias("e")).select(
        "run_id", F.col("e.at").alias("snapshot_ord"), "e.event", "pid", "name"
    )


def service_snapshot_diff(snapshots: DataFrame) -> DataFrame:
    """Service events between consecutive snapshots; status and pid changes may both fire.

    As `process_snapshot_diff`; of rows that repeat a name within a snapshot the last by pid and status counts.
    """
    named = snapshots.filter(F.coalesce("name", F.lit("")) != "").select("run_id", "snapshot_ord", "name", "status", "pid")
    by = W.partitionBy("run_id", "name")
    w = by.orderBy("_t", "pid", "status")
    d = named.join(snapshot_ticks(snapshots.filter(F.coalesce("name", F.lit("")) != "")), ["run_id", "snapshot_ord"])
    d = d.withColumn("_after", F.lead("_t").over(w)).filter(F.coalesce(F.col("_after") != F.col("_t"), F.lit(True)))
    d = d.withColumns({f"_{c}": F.lag(c).over(w) for c in ("status", "pid", "_t")})
    there = F.col("__t") == F.col("_t") - 1
    added = (F.col("_t") > 0) & ~F.coalesce(there, F.lit(False))
    removed = F.col("next_ord").isNotNull() & F.coalesce(F.col("_after") > F.col("_t") + 1, F.lit(True))
    status = there & ~F.col("status").eqNullSafe(F.col("_status"))
    pid = there & ~F.col("pid").eqNullSafe(F.col("_pid")) & (F.coalesce("pid", F.lit(0)) != 0)
    event = lambda when, name, at="snapshot_ord": F.when(when, F.struct(F.col(at).alias("at"), F.lit(name).alias("event")))
    fired = [event(added, "service_added"), event(removed, "service_removed", "next_ord"),
             event(status, "service_status_change"), event(pid, "service_pid_change")]
    d = d.withColumn("e", F.explode(F.array_compact(F.array(*fired))))
    on = lambda ev, col: F.when(F.col("e.event") == ev, F.col(col))
    return d.select(
        "run_id", F.col("e.at").alias("snapshot_ord"), "e.event", "name",
        on("service_added", "status").alias("status"),
        on("service_status_change", "_status").alias("from_status"),
        on("service_status_change", "status").alias("to_status"),
        on("service_pid_change", "_pid").alias("from_pid"),
        on("service_pid_change", "pid").alias("to_pid"),
    )


def gpu_engine_rollup(counters: DataFrame) -> DataFrame:
    """Raw counter instances -> highest use per engine type, adapter and snapshot; idle engines drop out."""
    part = lambda pattern: F.regexp_extract("instance", pattern, 1)
    or_unknown = lambda c: F.when(c == "", "?").otherwise(c)
    d = counters.select(
        "run_id", "snapshot",
        or_unknown(part(r"(?i)engtype_([A-Za-z0-9]+)")).alias("engine_type"),
        or_unknown(part(r"(?i)luid_(0x[0-9A-Fa-f]+_0x[0-9A-Fa-f]+)")).alias("luid"),
        clip(F.col("value").cast("double")).alias("v"),
    )
    return (
        d.filter("v > 0")
        .groupBy("run_id", "snapshot", "engine_type", "luid")
        .agg(F.bround(F.max("v"), 2).alias("utilization_pct"))
    )


def gpu_process_memory_rollup(dedicated: DataFrame, shared: DataFrame) -> DataFrame:
    """Integer parts summed per pid and snapshot for both counters; a missing side is 0."""

    def summed(counters: DataFrame, name: str) -> DataFrame:
        pid = F.regexp_extract("instance", r"(?i)pid_(\d+)", 1)
        d = counters.withColumn("_pid", pid).filter("_pid <> ''")
        return d.groupBy("run_id", "snapshot", F.col("_pid").cast("bigint").alias("pid")).agg(
            F.sum(F.col("value").cast("bigint")).alias(name)
        )

    d = summed(dedicated, "dedicated_bytes").join(
        summed(shared, "shared_bytes"), ["run_id", "snapshot", "pid"], "full_outer"
    )
    return d.fillna(0, ["dedicated_bytes", "shared_bytes"])


# Disk event names that carry a byte count.
DISK_EVENTS = (
    "fileio", "diskio", "fileiow", "diskiow", "read", "write", "fileread", "filewrite",
    "diskread", "diskwrite",
)


def _disk_events(events: DataFrame) -> DataFrame:
    d = events.withColumn("_ev", F.lower("event_name"))
    ok = F.col("_ev").isin(*DISK_EVENTS) & (F.col("pid") > 0) & (F.col("bytes") > 0)
    read, write = F.col("_ev").contains("read"), F.col("_ev").contains("write")
    return d.withColumns(
        {
            "_ok": F.coalesce(ok, F.lit(False)),
            "_read": F.when(ok & read, F.col("bytes")),
            "_write": F.when(ok & ~read & write, F.col("bytes")),
        }
    )


def disk_io_by_process(events: DataFrame, n: int | None = 25) -> DataFrame:
    """Read and written bytes per process, largest first; untyped I/O events add no bytes."""
    d = _disk_events(events)
    name = (
        F.min_by("image", F.when(F.coalesce("image", F.lit("")) != "", F.col("row_ord")))
        if "image" in events.columns else F.lit(None).cast("string")
    )
    named = d.filter("_ok").groupBy("run_id", "pid").agg(
        F.coalesce(name, F.lit("?")).alias("name"),
        F.coalesce(F.sum("_read"), F.lit(0)).alias("read_bytes"),
        F.coalesce(F.sum("_write"), F.lit(0)).alias("write_bytes"),
        F.count("_read").alias("read_ops"),
        F.count("_write").alias("write_ops"),
    )
    busy = named.filter("read_ops + write_ops > 0").withColumn("total_bytes", F.expr("read_bytes + write_bytes"))
    return top_k(busy, ["run_id"], [F.desc("total_bytes"), F.asc("pid")], n)


def disk_io_totals(events: DataFrame) -> DataFrame:
    return _disk_events(events).groupBy("run_id").agg(
        F.coalesce(F.sum("_read"), F.lit(0)).alias("read_bytes"),
        F.coalesce(F.sum("_write"), F.lit(0)).alias("write_bytes"),
        F.count(F.lit(1)).alias("events_total"),
        F.count(F.when(F.col("_ok"), 1)).alias("events_attributed"),
    )


def established_connections(connections: DataFrame) -> DataFrame:
    hit = (F.col("status") == "ESTABLISHED") & (F.col("type") == "tcp")
    return connections.groupBy("run_id", "rel_seconds").agg(
        F.count(F.when(hit, 1)).alias("connections_established")
    )


def vpn_suspect_adapters(adapters: DataFrame) -> DataFrame:
    """Adapter names (column ``name``) that look like a VPN, once per run."""
    hit = F.lit(False)
    for marker in VPN_MARKERS:
        hit = hit | F.contains(F.lower("name"), F.lit(marker))
    return adapters.filter(hit).select("run_id", F.col("name").alias("adapter")).distinct()


def normalize_event_log(raw: DataFrame, runs: DataFrame) -> DataFrame:
    """Event time -> epoch seconds and seconds since the run's start; levels 1-3 inside the run.

    ``runs`` has ``run_id, start_wall, end_wall`` (epoch seconds). A time that cannot be parsed
    keeps its event with null positions.
    """
    text = F.regexp_replace("time", "Z$", "+00:00")
    at = F.unix_micros(text.try_cast("timestamp")) / 1e6
    d = raw.join(runs.select("run_id", "start_wall", "end_wall"), "run_id")
    d = d.withColumn("timestamp", at).withColumn(
        "rel_seconds", F.bround(F.col("timestamp") - F.col("start_wall"), 1)
    )
    inside = F.col("timestamp").isNull() | F.col("timestamp").between(F.col("start_wall"), F.col("end_wall"))
    return d.filter(F.col("level_code").isin(1, 2, 3) & inside).drop("start_wall", "end_wall")
