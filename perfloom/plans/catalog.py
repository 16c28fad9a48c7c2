"""Registered queries: every operator over the views, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import parse_semicolon_list, to_float, to_int
from ..functions.naming import app_key, display_name, event_bucket, strip_port
from ..operators import anomalies as an
from ..operators import apps as ap
from ..operators import charts as ch
from ..operators import compare as cm
from ..operators import derive as de
from ..operators import events as ev
from ..operators import gpu as gp
from ..operators import latency as la
from ..operators import network as ne
from ..operators import offenders as of
from ..operators import scores as sc
from ..operators import slowdowns as sl
from ..operators import trends as tr
from ..operators.series import (
    clip, dense_index, merge_windows, monotonic_ratio, moving_average,
    percentile_linear, plateau_fraction, r2, sustained_windows,
)
from ..sources import run_folders
from ..thresholds import Thresholds
from . import folders as fo
from .analysis import Analysis
from .oracles import query_sql
from .views import Views

# The defaults find nothing (or everything) on the given tables, so the queries pass these.
ANOMALY = Thresholds(
    cpu_sustained_pct=20.0, cpu_sustained_seconds=5, cpu_single_core_pct=20.0, cpu_single_core_seconds=4,
    core_others_avg_below=28.0, mem_used_pct_high=40.0, mem_sustained_samples=4,
    disk_active_pct=20.0, disk_active_seconds=4, net_latency_ms_critical=498.0,
)
SLOWDOWN = Thresholds(slowdown_swap_pct=35.0, slowdown_merge_gap_seconds=1)
LEAK = Thresholds(
    leak_min_slope_bytes_per_sec=0.3, leak_min_growth_bytes=1e6,
    handle_growth_per_min_suspicious=0.02, handle_growth_per_min_likely=0.2, handle_min_growth=1000.0,
    thread_growth_per_min_suspicious=0.001, thread_growth_per_min_likely=0.01, thread_min_growth=50.0,
)
GPU = Thresholds(gpu_engine_medium_pct=53.0, gpu_engine_high_pct=54.5)


class Inputs(Views):
    """The views, the findings over them, and a few inputs that several queries share."""

    @cached_property
    def analysis(self) -> Analysis:
        own = {"anomaly": ANOMALY, "slowdown": SLOWDOWN, "leak": LEAK, "gpu": GPU}
        return Analysis(Tables(self), **own)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return super().__getattr__(name)
        except AttributeError:
            if name.startswith("_"):
                raise
            return getattr(self.analysis, name)

    @cached_property
    def igrow(self) -> DataFrame:
        return dense_index(self.grow, ("run_id", "pid"))

    @cached_property
    def events_diff(self) -> DataFrame:
        return de.process_snapshot_diff(self.dealt("v_snap", "run_id", "pid"), de.snapshot_ticks(self.snap))

    @cached_property
    def engines(self) -> DataFrame:
        return de.gpu_engine_rollup(self.gpu)

    @cached_property
    def gpu_memory(self) -> DataFrame:
        counter = lambda value, instance: self.gpu.select(
            "run_id", "snapshot", F.expr(instance).alias("instance"), F.expr(value).alias("value")
        )
        # The shared counter names other processes, so either side of the join can be missing.
        return de.gpu_process_memory_rollup(counter("value*1048576", "instance"), counter("value*1e5D", "replace(instance,'pid_','pid_1')"))


class Tables(dict):
    """Analysis tables by name, made from the views on first use."""

    NAMES = {
        "runs": "runs", "system": "sys", "process": "proc", "trend_process": "grow", "latency": "lat",
        "connections": "conn", "process_events": "events_diff", "gpu_engine": "engines",
        "gpu_process": "gpu_memory", "gpu_adapter": "gad", "event_log": "evt", "disk_io_events": "io",
    }

    def __init__(self, inputs: Inputs):
        super().__init__(dict.fromkeys(self.NAMES))
        self.inputs = inputs

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self.inputs, self.NAMES[name])

    def get(self, name: str, default=None):
        return self[name] if name in self.NAMES else default


@dataclass(frozen=True)
class Query:
    build: Callable[[Inputs], DataFrame]
    sql: str | None
    rounds: dict[str, int]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Inputs(spark, folder))
        return df.withColumns({c: F.round(c, d) for c, d in self.rounds.items()}) if self.rounds else df

    def oracle(self) -> str | None:
        return None if self.sql is None else query_sql(self.sql, self.rounds)


QUERIES: dict[str, Query] = {}


def add(name: str, build: Callable[[Inputs], DataFrame], sql: str | None = None, **rounds: int) -> None:
    QUERIES[name] = Query(build, sql, rounds)


def text_list(column: str):
    return F.array_join(column, ";").alias(column)


# --- coercion and series primitives ----------------------------------------------------------
add("coerce_scalars",
    lambda i: i.txt.select("run_id", "row_ord", to_float("raw").alias("as_float"), to_int("raw").alias("as_int"), to_int("raw", -1).alias("as_int_or_minus_one")),
    "select run_id, row_ord, try_cast(raw as double) as_float, coalesce(trunc(try_cast(raw as double))::bigint,0) as_int, coalesce(trunc(try_cast(raw as double))::bigint,-1) as_int_or_minus_one from v_txt")
add("core_list",
    lambda i: i.sys.select("run_id", "row_ord", parse_semicolon_list("cpu_per_core_pct").alias("c")).select(
        "run_id", "row_ord", F.size("c").alias("cores"), F.aggregate("c", F.lit(0.0), lambda a, x: a + x).alias("total"), F.get("c", F.lit(2)).alias("third")),
    "select run_id, row_ord, len(c)::int cores, list_sum(c) total, c[3] third from (select *, list_transform(string_split(cpu_per_core_pct,';'), lambda x: coalesce(try_cast(x as double),0)) c from v_sys)")
add("percentile_linear",
    lambda i: percentile_linear(i.sys, "cpu_total_pct", 0.95, ("run_id",), "cpu_p95"),
    "select run_id, quantile_cont(cpu_total_pct,0.95) cpu_p95 from v_sys group by 1", cpu_p95=8)
add("moving_average",
    lambda i: moving_average(i.igrow, "rss_bytes", 8, ("run_id", "pid")).select("run_id", "pid", "row_ord", "smooth"),
    "select run_id, pid, row_ord, avg(rss_bytes) over (partition by run_id, pid order by rel_seconds, row_ord rows between 7 preceding and current row) smooth from v_grow", smooth=3)
add("trend_slope",
    lambda i: i.grow.groupBy("run_id", "pid").agg(F.regr_slope("rss_bytes", "rel_seconds").alias("slope")),
    "select run_id, pid, regr_slope(rss_bytes, rel_seconds) slope from v_grow group by 1,2", slope=6)
add("trend_r2",
    lambda i: i.grow.groupBy("run_id", "pid").agg(r2("rss_bytes", "rel_seconds").alias("r2")),
    "select run_id, pid, case when var_pop(rss_bytes)=0 then 0 else regr_r2(rss_bytes, rel_seconds) end r2 from v_grow group by 1,2", r2=6)
add("monotonic_ratio",
    lambda i: monotonic_ratio(i.igrow, "rss_bytes", ("run_id", "pid")),
    "select run_id, pid, coalesce(avg(case when p is not null then (rss_bytes>=p)::int end),0) monotonic_ratio from (select *, lag(rss_bytes) over (partition by run_id, pid order by rel_seconds, row_ord) p from v_grow) group by 1,2", monotonic_ratio=6)
add("plateau_fraction",
    lambda i: plateau_fraction(i.igrow, "rss_bytes", ("run_id", "pid")),
    "select run_id, pid, case when max(f)>0 then (max(n)-1-coalesce(max(case when abs(rss_bytes-f)>abs(f)*0.02 then k end),-1))/max(n) else 0 end plateau_fraction from (select *, row_number() over w - 1 k, count(*) over (partition by run_id, pid) n, last_value(rss_bytes) over (w rows between unbounded preceding and unbounded following) f from v_grow window w as (partition by run_id, pid order by rel_seconds, row_ord)) group by 1,2", plateau_fraction=6)
add("series_summary",
    lambda i: i.sys.groupBy("run_id").agg(
        F.avg("cpu_total_pct").alias("mean"), F.max("cpu_total_pct").alias("peak"), F.stddev_pop("cpu_total_pct").alias("pstdev"),
        clip(F.sum("cpu_total_pct")).alias("clipped_high"), clip(-F.sum("cpu_total_pct")).alias("clipped_low")),
    "select run_id, avg(cpu_total_pct) mean, max(cpu_total_pct) peak, stddev_pop(cpu_total_pct) pstdev, greatest(0,least(100,sum(cpu_total_pct))) clipped_high, greatest(0,least(100,-sum(cpu_total_pct)))::double clipped_low from v_sys group by 1", mean=6, pstdev=6)
_SE = ("start_idx", "end_idx")
add("sustained_windows",
    lambda i: sustained_windows(i.indexed_system, "cpu_total_pct", 20.0, 5).select("run_id", *_SE),
    "select run_id, s start_idx, e end_idx from cpu_ok")
add("merge_windows",
    lambda i: merge_windows(sustained_windows(i.indexed_system, "cpu_total_pct", 20.0, 5), 3).select("run_id", *_SE),
    "select run_id, s start_idx, e end_idx from cpu_merged")

# --- anomalies -------------------------------------------------------------------------------
_SPAN = "run_id, kind, severity, start_idx, end_idx, start_rel, end_rel, samples, peak_pct"
_no_text = lambda df: df.drop("description")
add("cpu_sustained_high", lambda i: _no_text(an.cpu_sustained_high(i.indexed_system, ANOMALY)), f"select {_SPAN}, avg_pct from a1", avg_pct=6)
add("cpu_single_core_saturation", lambda i: _no_text(an.cpu_single_core_saturation(i.indexed_system, ANOMALY)),
    f"select {_SPAN}, core, other_cores_avg_pct from a2", other_cores_avg_pct=6)
add("memory_pressure", lambda i: _no_text(an.memory_pressure(i.indexed_system, ANOMALY)), f"select {_SPAN}, avg_pct from a3", avg_pct=6)
add("swap_usage", lambda i: _no_text(an.swap_usage(i.sys, ANOMALY)), "select * from a4", avg_pct=6)
add("disk_active_high", lambda i: _no_text(an.disk_active_high(i.indexed_system, ANOMALY)), f"select {_SPAN}, avg_pct from a5", peak_pct=6, avg_pct=6)
add("network_unreachable", lambda i: _no_text(an.network_unreachable(i.lat, ANOMALY)), "select * from a6", loss_pct=6)
add("network_latency_spike", lambda i: _no_text(an.network_latency_spike(i.lat, ANOMALY)), "select * from a7", avg_ms=6, p95_ms=8, peak_ms=6, loss_pct=6)
add("detect_anomalies",
    lambda i: i.anomalies.select("run_id", "kind", "severity", "start_idx", "end_idx", "samples", "peak_pct", "core", "target"),
    "select run_id, kind, severity, start_idx, end_idx, samples, peak_pct, core, target from anomalies", peak_pct=6)

# --- slowdowns -------------------------------------------------------------------------------
add("pressure_mask",
    lambda i: sl.pressure_mask(i.sys, SLOWDOWN).select("run_id", "row_ord", text_list("reasons")),
    "select run_id, row_ord, concat_ws(';', case when r_cpu then 'cpu' end, case when r_memory then 'memory' end, case when r_swap then 'swap' end, case when r_disk then 'disk' end) reasons from mask")
_W = ("run_id", *_SE)
_PEAKS = ("peak_cpu_pct", "peak_mem_pct", "peak_disk_pct", "peak_swap_pct")
add("slowdown_windows", lambda i: i.windows.select(*_W, "start_rel", "end_rel", "samples", *_PEAKS), "select * from sd", peak_disk_pct=6)
add("slowdown_reasons", lambda i: sl.slowdown_reasons(i.windows), "select * from sd_reasons")
add("slowdown_latency_hits", lambda i: i.hits, "select * from sd_hits", latency_peak_ms=6)
add("slowdown_offenders", lambda i: i.suspects, "select * from sd_offenders", value=4)
add("slowdown_confidence",
    lambda i: i.slowdowns.select(*_W, "samples", text_list("reason_tags"), "latency_hits", "confidence"),
    "select run_id, start_idx, end_idx, samples, reason_tags, latency_hits, confidence from sd_full")

# --- trends ----------------------------------------------------------------------------------
_TREND = dict(slope=6, r2=6, mono=6, start_val=3, end_val=3, peak_val=3, plateau=6, duration=3)
_LEAK = dict(start_val=3, end_val=3, peak_val=3, growth=3, growth_ratio=6, growth_per_min=6, slope=6, duration=3, r2=6, mono=6, plateau=6)
add("trend_stats", lambda i: i.trends, "select * from trend", **_TREND)
add("grade_confidence",
    lambda i: i.leaks.groupBy("run_id", "kind", "confidence").agg(F.count(F.lit(1)).alias("n")),
    "select run_id, kind, confidence, count(*) n from leaks group by 1,2,3")
add("memory_leaks", lambda i: tr.memory_leaks(i.trends, LEAK), "select * from l3", **_LEAK)
add("handle_leaks", lambda i: tr.handle_leaks(i.trends, LEAK), "select * from l4", **_LEAK)
add("thread_leaks", lambda i: tr.thread_leaks(i.trends, LEAK), "select * from l5", **_LEAK)
add("detect_leaks",
    lambda i: tr.rank_leaks(i.leaks).select("run_id", "kind", "rank", "pid", "process_name", "confidence", "growth"),
    "select run_id, kind, row_number() over (partition by run_id, kind order by case when kind like 'memory%' then round_even(growth/(1024*1024),1) else round_even(growth_per_min,1) end desc, pid) rank, pid, process_name, confidence, growth from leaks", growth=3)

# --- processes and applications --------------------------------------------------------------
_PIDS = dict(cpu_pct_sum=4, io_read_bps_sum=2, io_write_bps_sum=2, io_read_bps_max=4, io_write_bps_max=4)
add("per_pid_aggregates", lambda i: i.pids, "select * from pids", **_PIDS)
add("rank_offenders", lambda i: i.offenders, "select * from offenders")
add("security_offenders", lambda i: i.security, "select * from security")
add("background_offenders", lambda i: i.background, "select * from background")
add("process_churn", lambda i: i.churn, "select * from churn")
add("top_spawners", lambda i: of.top_spawners(i.events_diff),
    "select * from (select run_id, name, starts, row_number() over (partition by run_id order by starts desc, name) rank from (select run_id, name, count(*) starts from proc_events where event='process_started' group by 1,2)) where rank<=10")
add("display_name",
    lambda i: i.proc.select("name").union(i.conn.select("name")).distinct().select(
        "name", app_key("name").alias("app_key"), display_name(app_key("name")).alias("display_name")),
    "select n.name, lower(trim(n.name)) app_key, coalesce(k.display, array_to_string(list_transform(regexp_extract_all(regexp_replace(lower(trim(n.name)),'\\.exe$',''),'[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]),'')) display_name from (select name from v_proc union select name from v_conn) n left join known_apps k on k.exe=lower(trim(n.name))")
_IO = ("io_read_bps", "io_write_bps")
add("app_ticks", lambda i: ap.app_ticks(i.proc), "select * from aticks", io_read_bps=4, io_write_bps=4)
add("app_aggregates", lambda i: ap.app_aggregates(i.proc).withColumn("pids", F.array_join(F.col("pids").cast("array<string>"), ";")), "select * from apps", io_read_bps_max=4, io_write_bps_max=4)
add("app_members", lambda i: ap.app_members(i.proc), "select distinct run_id, trim(lower(name)) app_key, pid from v_proc")
add("rank_apps", lambda i: ap.rank_apps(ap.app_aggregates(i.proc)), "select * from apps_ranked")

# --- raw sample derivations ------------------------------------------------------------------
add("system_rates", lambda i: de.system_rates(i.tot),
    "select run_id, row_ord, mono, coalesce(round_even((disk_read_bytes-lag(disk_read_bytes) over w)/dt,1),0.0) disk_read_bytes_per_sec, coalesce(round_even((disk_write_count-lag(disk_write_count) over w)/dt,2),0.0) disk_write_count_per_sec, coalesce(round_even((net_bytes_sent-lag(net_bytes_sent) over w)/dt,1),0.0) net_sent_bytes_per_sec, round_even((ctx_switches-lag(ctx_switches) over w)/dt,1) ctx_switches_per_sec, case when dt is null then 0.0 else round_even(greatest(0,least(100,(disk_busy_ms-lag(disk_busy_ms) over w)/(dt*1000)*100)),2) end disk_active_pct_est from (select *, case when lag(mono) over (partition by run_id order by mono, row_ord) is not null then greatest(mono-lag(mono) over (partition by run_id order by mono, row_ord),1e-3) end dt from v_tot) window w as (partition by run_id order by mono, row_ord)")
add("adapter_rates", lambda i: de.adapter_rates(i.nic),
    "select n.run_id, n.adapter, n.mono, coalesce(round_even(greatest(0,(n.bytes_sent-p.bytes_sent)/greatest(n.mono-t.prev,1e-3)),1),0.0) bytes_sent_per_sec, coalesce(round_even(greatest(0,(n.packets_recv-p.packets_recv)/greatest(n.mono-t.prev,1e-3)),2),0.0) packets_recv_per_sec from v_nic n join (select run_id, mono, lag(mono) over (partition by run_id order by mono) prev from (select distinct run_id, mono from v_nic)) t on n.run_id=t.run_id and n.mono=t.mono left join v_nic p on p.run_id=n.run_id and p.adapter=n.adapter and p.mono=t.prev")
add("process_io_rates", lambda i: de.process_io_rates(i.ctr),
    "select c.run_id, c.pid, c.row_ord, c.mono, coalesce(greatest(0,(c.read_bytes-c.p)/greatest(c.mono-t.prev,1e-3)),0) io_read_bps from (select *, lag(read_bytes) over (partition by run_id, pid order by mono, row_ord) p from v_ctr) c join (select run_id, mono, lag(mono) over (partition by run_id order by mono) prev from (select distinct run_id, mono from v_ctr)) t on c.run_id=t.run_id and c.mono=t.mono", io_read_bps=4)
add("latency_probe_summary", lambda i: de.latency_probe_summary(i.rep).drop("raw_times_ms"),
    "select run_id, row_ord, target, count, list_avg(t) avg_ms, list_min(t) min_ms, list_max(t) max_ms, case when len(t)>=2 then round_even(list_sum(list_transform(range(2,len(t)+1), lambda k: abs(t[k]-t[k-1])))/(len(t)-1),2) end jitter_ms, case when len(t)>0 then round_even((1-len(t)/count)*100,1) else 100.0 end loss_pct from (select *, case when raw_times_ms='' then [] else list_transform(string_split(raw_times_ms,';'), lambda x: x::double) end t from v_rep)", avg_ms=6)
add("candidate_processes", lambda i: de.candidate_processes(i.proc.withColumns({"io_read_bytes": F.expr("row_ord*1000"), "io_write_bytes": F.expr("pid*500000")}), n=1, pid=7),
    "select distinct run_id, rel_seconds, pid from (select *, row_number() over (partition by run_id, rel_seconds order by cpu_pct desc, pid desc, name desc) a, row_number() over (partition by run_id, rel_seconds order by rss_bytes desc, pid desc, name desc) b, row_number() over (partition by run_id, rel_seconds order by num_handles desc, pid desc, name desc) c, row_number() over (partition by run_id, rel_seconds order by row_ord*1000+pid*500000 desc, pid desc, name desc) d from v_proc) where a=1 or b=1 or c=1 or d=1 or pid=7 or lower(name) in (select nm from critical)")
add("flag_target",
    lambda i: de.flag_target(i.proc, "CHROME.exe", 7).groupBy("run_id", "pid", "is_target").agg(F.count(F.lit(1)).alias("n")),
    "select run_id, pid, (pid=7 or lower(name)='chrome.exe') is_target, count(*) n from v_proc group by 1,2,3")
add("process_snapshot_diff", lambda i: i.events_diff, "select * from proc_events")
add("service_snapshot_diff", lambda i: de.service_snapshot_diff(i.svc),
    "select c.run_id, c.snapshot_ord, 'service_added' event, c.name, c.status status, null::varchar from_status, null::varchar to_status, null::bigint from_pid, null::bigint to_pid from svc_now c anti join svc_before p using (run_id, snapshot_ord, name) "
    "union all select p.run_id, p.snapshot_ord, 'service_removed', p.name, null, null, null, null, null from svc_before p anti join svc_now c using (run_id, snapshot_ord, name) "
    "union all select c.run_id, c.snapshot_ord, 'service_status_change', c.name, null, p.status, c.status, null, null from svc_now c join svc_before p using (run_id, snapshot_ord, name) where c.status is distinct from p.status "
    "union all select c.run_id, c.snapshot_ord, 'service_pid_change', c.name, null, null, null, p.pid, c.pid from svc_now c join svc_before p using (run_id, snapshot_ord, name) where c.pid is distinct from p.pid and c.pid<>0")
add("gpu_engine_rollup", lambda i: i.engines, "select * from gpu_eng")
add("gpu_process_memory_rollup", lambda i: i.gpu_memory, "select * from gpu_mem")
add("disk_io_by_process", lambda i: de.disk_io_by_process(i.io),
    "select * from (select *, row_number() over (partition by run_id order by total_bytes desc, pid) rank from (select run_id, pid, '?' as name, coalesce(sum(bytes) filter (where ev like '%read%'),0)::bigint read_bytes, coalesce(sum(bytes) filter (where ev like '%write%'),0)::bigint write_bytes, count(*) filter (where ev like '%read%') read_ops, count(*) filter (where ev like '%write%') write_ops, coalesce(sum(bytes) filter (where ev like '%read%' or ev like '%write%'),0)::bigint total_bytes from (select *, lower(event_name) ev from v_io) where pid>0 and bytes>0 group by 1,2) where read_ops+write_ops>0) where rank<=25")
add("disk_io_totals", lambda i: de.disk_io_totals(i.io),
    "select run_id, coalesce(sum(bytes) filter (where pid>0 and bytes>0 and event_name='DiskRead'),0)::bigint read_bytes, coalesce(sum(bytes) filter (where pid>0 and bytes>0 and event_name='FileWrite'),0)::bigint write_bytes, count(*) events_total, count(*) filter (where pid>0 and bytes>0) events_attributed from v_io group by 1")
add("established_connections", lambda i: de.established_connections(i.conn),
    "select run_id, rel_seconds, count(*) filter (where status='ESTABLISHED' and type='tcp') connections_established from v_conn group by 1,2")

# --- network, latency, GPU, events -----------------------------------------------------------
add("strip_port",
    lambda i: i.conn.groupBy("raddr", strip_port("raddr").alias("host")).agg(F.count(F.lit(1)).alias("n")),
    "select raddr, case when raddr like '[%' then regexp_extract(raddr, '^\\[([^\\]]*)\\]', 1) else regexp_replace(raddr, ':[^:]*$', '') end host, count(*) n from v_conn group by 1,2")
_CONN = ("snapshots_with_conns", "total_conn_samples", "avg_concurrent_conns", "tcp_share_pct", "udp_share_pct", "unique_remote_count")
_order = "row_number() over (partition by run_id order by avg_concurrent_conns desc, unique_remote_count desc, {}) rank"
add("connections_by_pid",
    lambda i: ne.connections_by_pid(i.conn).select("run_id", "rank", "pid", "name", "app_key", "display_name", *_CONN, text_list("unique_remotes")),
    f"select * from (select {_order.format('pid')}, * from conn_pid) where rank<=10")
add("connections_by_app",
    lambda i: ne.connections_by_app(i.conn).select("run_id", "rank", "app_key", "display_name", "pid_count", *_CONN),
    f"select * from (select {_order.format('app_key')}, * from conn_app) where rank<=10")
add("pid_remotes", lambda i: ne.pid_remotes(i.conn), "select distinct run_id, pid, remote from conn where remote is not null")
add("top_remotes",
    lambda i: ne.top_remotes(i.conn, "pid").select("run_id", F.lit("pid").alias("by"), F.col("pid").cast("string").alias("owner"), "remote", "samples", "rank").union(
        ne.top_remotes(i.conn, "app_key").select("run_id", F.lit("app").alias("by"), "app_key", "remote", "samples", "rank")),
    "select run_id, 'pid' as \"by\", pid::varchar as owner, remote, samples, rank from (select *, row_number() over (partition by run_id, pid order by samples desc, remote) rank from (select run_id, pid, remote, count(*) samples from conn where remote is not null group by 1,2,3)) where rank<=5 union all select run_id, 'app', app_key, remote, samples, rank from (select *, row_number() over (partition by run_id, app_key order by samples desc, remote) rank from (select run_id, app_key, remote, count(*) samples from conn where remote is not null group by 1,2,3)) where rank<=10")
add("connection_status_counts",
    lambda i: ne.connection_status_counts(i.conn, "pid").select("run_id", F.lit("pid").alias("by"), F.col("pid").cast("string").alias("owner"), "status", "n").union(
        ne.connection_status_counts(i.conn, "app_key").select("run_id", F.lit("app").alias("by"), "app_key", "status", "n")),
    "select run_id, 'pid' as \"by\", pid::varchar as owner, status, count(*) n from conn where status<>'' group by all union all select run_id, 'app', app_key, status, count(*) from conn where status<>'' group by all")
add("latency_by_target", lambda i: la.latency_by_target(i.lat), "select * from targets",
    rtt_avg_ms=6, rtt_p95_ms=8, rtt_max_ms=6, jitter_avg_ms=6, avg_loss_pct=6, resolve_avg_ms=6, resolve_p95_ms=8)
add("dns_findings", lambda i: la.dns_findings(la.latency_by_target(i.lat)).drop("detail"),
    "select run_id, target, 'slow_dns' kind, case when resolve_avg_ms>=300 then 'high' else 'medium' end severity from targets where resolve_avg_ms>=100 union all select run_id, target, 'dns_failures', 'high' from targets where resolve_fail_samples/samples>=0.25")
add("gpu_engine_stats", lambda i: gp.gpu_engine_stats(i.engines), "select * from gpu_stats")
add("gpu_process_memory", lambda i: i.gpu_pids, "select * from gpu_pids")
add("gpu_app_memory", lambda i: gp.gpu_app_memory(i.gpu_pids),
    "select run_id, app_key, display_name, count(*) pid_count, max(dedicated_peak_mb) dedicated_peak_mb, sum(dedicated_avg_mb) dedicated_avg_mb, max(shared_peak_mb) shared_peak_mb from gpu_pids group by 1,2,3", dedicated_avg_mb=4)
add("gpu_adapter_stats", lambda i: gp.gpu_adapter_stats(i.gad),
    "select run_id, adapter, avg(temperature_c) temp_avg_c, max(temperature_c) temp_peak_c, avg(power_w) power_avg_w, max(power_w) power_peak_w, avg(mem_used_mb) mem_used_avg_mb, max(mem_used_mb) mem_used_peak_mb, avg(utilization_pct) util_avg_pct, max(utilization_pct) util_peak_pct from v_gad group by 1,2",
    temp_avg_c=6, power_avg_w=6, power_peak_w=6, mem_used_avg_mb=6, util_avg_pct=6)
add("gpu_findings", lambda i: gp.gpu_findings(gp.gpu_engine_stats(i.engines), GPU).drop("detail"),
    "select run_id, 'gpu_engine_saturated' kind, case when avg_pct>=54.5 then 'high' else 'medium' end severity, engine_type, luid, avg_pct, peak_pct from gpu_stats where avg_pct>=53")
add("event_bucket", lambda i: i.evt.groupBy("provider", event_bucket("provider").alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
    "select provider, bucket, count(*) n from ev group by 1,2")
_window_text = lambda: F.coalesce(F.array_join(F.transform("correlated_slowdowns", lambda w: w["kind"]), ";"), F.lit("")).alias("kinds")
add("correlate_events", lambda i: i.correlated.select("run_id", "row_ord", "bucket", "n_correlated", _window_text()),
    "select run_id, row_ord, bucket, n_correlated::int n_correlated, array_to_string(list_transform(case when windows='' then [] else string_split(windows,';') end, lambda x: split_part(x,':',2)),';') kinds from ev_full")
add("event_bucket_counts", lambda i: ev.event_bucket_counts(i.correlated),
    "select run_id, bucket, count(*) events, count(*) filter (where n_correlated>0) correlated from ev_full group by 1,2")
add("top_events", lambda i: ev.top_events(i.correlated).select("run_id", "rank", "row_ord", "level_code", "bucket", "rel_seconds", "n_correlated"),
    "select run_id, rank, row_ord, level_code, bucket, rel_seconds, n_correlated::int n_correlated from (select *, row_number() over (partition by run_id order by level_code, case when n_correlated>0 then 0 else 1 end, bucket, rel_seconds desc, row_ord) rank from ev_full) where rank<=15")

# --- bottlenecks, scores, verdict ------------------------------------------------------------
add("bottleneck_scores", lambda i: i.bottleneck_points.drop("ord"), "select run_id, dim, points from bscores", points=6)
add("classify_bottleneck", lambda i: i.bottlenecks.select("run_id", "primary", text_list("secondary")), "select * from bottleneck")
add("bottleneck_reasons", lambda i: i.bottleneck_reasons.drop("text"),
    "select run_id, dim, rank, kind, start_idx, core, target from (select *, row_number() over (partition by run_id, dim order by seq, ord, core, start_idx, place, target) rank from reason_rows) where rank<=5")
add("stability_score", lambda i: sc.stability_score(i.runs, i.sys, i.kept("anomalies")), "select * from x4", cpu_std=6, mem_std=6, stability=6)
add("efficiency_score", lambda i: sc.efficiency_score(i.runs, i.sys, i.background), "select * from x5", idle_pct=6, mem_free_pct=6, background_cpu=6, efficiency=6)
add("workload_score", lambda i: sc.workload_score(i.runs, i.sys, i.kept("slowdowns")), "select * from x6", workload=6)
add("security_score", lambda i: sc.security_score(i.runs, i.security), "select * from x7", cpu=4, rss=4, security=6)
add("network_score", lambda i: sc.network_score(i.runs, i.lat), "select * from x8", avg_ms=6, p95_ms=8, loss_pct=6, network=6)
add("hygiene_score", lambda i: sc.hygiene_score(i.runs, i.kept("leaks"), i.offenders), "select * from x9", penalty=4, hygiene=4)
add("run_scores", lambda i: i.scores, "select * from scores")
add("run_verdict", lambda i: i.verdicts.drop("verdict"), "select * from verdict")
add("recommendations",
    lambda i: sc.recommendations(i.bottlenecks, i.security, i.background, i.kept("leaks"), i.churn).groupBy("run_id", "ord", "rule").agg(F.count(F.lit(1)).alias("n")),
    "select run_id, ord, rule, count(*) n from (select run_id, 1 ord, concat('primary_',\"primary\") rule from bottleneck where \"primary\" in ('cpu','memory','disk','network','security') union all select run_id, 2, 'security_cpu' from security where rank<=3 group by run_id having sum(cpu_pct_avg)>15 union all select a, b, c from (select distinct run_id, 3, concat('leak_', replace(kind,'_leak_candidate','')), process_name from leaks where confidence in ('likely','strong evidence')) t(a,b,c,d) union all select run_id, 5, 'background_cpu' from background where rank<=3 group by run_id having sum(cpu_pct_avg)>10 union all select run_id, 6, 'churn' from churn where total_process_starts>200) group by 1,2,3")
add("score_class", lambda i: i.scores.select("run_id", sc.score_class("overall").alias("overall_class"), sc.score_class("network").alias("network_class"), sc.score_class("hygiene").alias("hygiene_class")),
    "select run_id, " + ", ".join(f"case when {c}>=80 then 'good' when {c}>=60 then 'med' else 'bad' end {c}_class" for c in ("overall", "network", "hygiene")) + " from scores")

# --- fleet -----------------------------------------------------------------------------------
add("comparison_matrix", lambda i: i.matrix, "select * from matrix")
add("comparison_rankings", lambda i: i.rankings, "select * from rankings")
_DELTA = (("overall", 5), ("cpu_avg", 3), ("mem_avg", 3), ("disk_avg", 3), ("latency_p95_ms", 20), ("anomalies", 3), ("slowdowns", 3))
add("pairwise_observations", lambda i: cm.pairwise_observations(i.matrix),
    " union all ".join(f"select a.run_id run_a, b.run_id run_b, '{m}' metric, a.{m}::double value_a, b.{m}::double value_b, round_even(a.{m}-b.{m},1)::double delta from matrix a join matrix b on a.run_id<b.run_id where abs(round_even(a.{m}-b.{m},1))>={t}" for m, t in _DELTA))
add("pairwise_successive", lambda i: cm.pairwise_observations(i.matrix, pairs=cm.successive_runs(i.matrix, "hostname", "run_id")),
    " union all ".join(f"select a.run_id run_a, b.run_id run_b, '{m}' metric, a.{m}::double value_a, b.{m}::double value_b, round_even(a.{m}-b.{m},1)::double delta from (select *, lag(run_id) over (partition by hostname order by run_id) prev from matrix) b join matrix a on a.run_id=b.prev where abs(round_even(a.{m}-b.{m},1))>={t}" for m, t in _DELTA))
add("common_and_unique_problems", lambda i: cm.common_and_unique_problems(i.runs, i.kept("anomalies"), i.kept("slowdowns")),
    "select 'common' as scope, null::varchar run_id, problem from kinds group by 3 having count(*)=(select count(*) from v_runs) union all select 'unique', max(run_id), problem from kinds group by 3 having count(*)=1")
add("comparison_winners", lambda i: cm.comparison_winners(i.rankings),
    "select " + ", ".join(f"max(run_id) filter (where ranking='{r}') {n}" for r, n in cm.WINNERS.items()) + " from rankings where rank=1")
add("run_summary", lambda i: cm.run_summary(i.runs, i.verdicts, i.kept("scores"), i.kept("bottlenecks")).withColumn("secondary", F.array_join("secondary", ";")).drop("verdict"),
    "select r.*, s.overall, s.confidence, b.\"primary\", b.secondary from v_runs r join scores s using (run_id) join bottleneck b using (run_id)")

# --- chart tables ----------------------------------------------------------------------------
add("downsample_max", lambda i: ch.downsample_max(i.indexed_system, "rel_seconds", ["cpu_total_pct"], 100),
    "select run_id, cast(case when n<=100 then idx else ceil((idx+1)/(n/100))-1 end as bigint) bucket, min(rel_seconds) rel_seconds, max(cpu_total_pct) cpu_total_pct from (select *, count(*) over (partition by run_id) n from ix_sys) group by 1,2")
add("core_heatmap", lambda i: ch.core_heatmap(i.indexed_system),
    "select run_id, core, cast(floor(idx/(case when n>400 then n//400+1 else 1 end)) as bigint) slot, max(coalesce(v,0)) as value from (select *, count(*) over (partition by run_id, core) n from core_rows) group by 1,2,3")
add("top_apps_stack", lambda i: ch.top_apps_stack(i.proc),
    "select s.run_id, s.metric, s.series, a.rel_seconds, coalesce(v.value,0)::double as value from grid_axis a join grid_series s using (run_id) left join (select run_id, metric, rel_seconds, series, sum(value) as value from grid_named group by 1,2,3,4) v on v.run_id=s.run_id and v.metric=s.metric and v.series=s.series and v.rel_seconds=a.rel_seconds", value=4)
add("top_process_series", lambda i: ch.top_process_series(i.proc),
    "select run_id, pid, rank, max(name) as name, cast(case when n<=300 then idx else ceil((idx+1)/(n/300))-1 end as bigint) bucket, min(rel_seconds) rel_seconds, max(cpu_pct) cpu_pct from ptop group by 1,2,3,5")
add("overlay_series", lambda i: ch.overlay_series(i.indexed_system),
    "select run_id, idx, rel_seconds, cpu_total_pct from (select *, count(*) over (partition by run_id) n from ix_sys) where idx % (case when n>400 then n//400 else 1 end)=0")
add("throughput_series", lambda i: ch.throughput_series(i.indexed_system),
    "select run_id, cast(case when n<=500 then idx else ceil((idx+1)/(n/500))-1 end as bigint) bucket, min(rel_seconds) rel_seconds, max(net_sent_bytes_per_sec/(1024*1024)) sent_mb_s, max(net_recv_bytes_per_sec/(1024*1024)) recv_mb_s from (select *, count(*) over (partition by run_id) n from ix_sys) group by 1,2", sent_mb_s=6, recv_mb_s=6)

# --- run folders, written from the views and read back ----------------------------------------
add("read_runs", lambda i: run_folders.read_runs(i.spark, fo.root(i)).select("run_id", "hostname", "mode", "duration_s", "th_cpu_sustained_pct", "th_mem_used_pct_critical"),
    "select run_id, hostname, mode, samples::double duration_s, (samples%100)::double th_cpu_sustained_pct, 93.0::double th_mem_used_pct_critical from v_runs")
add("discover_runs", lambda i: run_folders.discover_runs(i.spark, fo.root(i), 2).select("run_folder", "run_id"), "select run_id run_folder, run_id from v_runs")


def _in_order(df: DataFrame) -> DataFrame:
    """The place of each row in its run's files, from 0."""
    return dense_index(df, order=("row_ord",))


_nth = "row_number() over (partition by run_id order by rel_seconds, row_ord)-1 idx"
add("read_system",
    lambda i: _in_order(fo.read_timeline(i, "system")).select("run_id", "idx", "rel_seconds", "cpu_total_pct", "mem_percent", "swap_percent", "disk_active_pct_est",
        F.size("cpu_per_core_pct").alias("cores"), "net_sent_bytes_per_sec", "mem_total_bytes"),
    "select run_id, idx, rel_seconds, cpu_total_pct, mem_percent, swap_percent, disk_active_pct_est, len(string_split(cpu_per_core_pct,';'))::int cores, net_sent_bytes_per_sec, 0::bigint mem_total_bytes from ix_sys",
    disk_active_pct_est=9, net_sent_bytes_per_sec=6)
add("read_process",
    lambda i: _in_order(fo.read_timeline(i, "process")).select("run_id", "idx", "rel_seconds", "pid", "name", "cpu_pct", "rss_bytes", "num_threads", "num_handles", "io_read_bps", "ppid", "is_target", "vms_bytes"),
    f"select run_id, {_nth}, rel_seconds, pid, name, cpu_pct::double cpu_pct, rss_bytes, num_threads, num_handles, io_read_bps::double io_read_bps, ppid, is_target, 0::bigint vms_bytes from v_proc", io_read_bps=4)
add("read_network", lambda i: fo.read_timeline(i, "network").select("run_id", "rel_seconds", "adapter", "bytes_sent_per_sec", "connections_established"),
    "select run_id, mono rel_seconds, adapter, bytes_sent::double bytes_sent_per_sec, -1::bigint connections_established from v_nic")
add("read_latency",
    lambda i: _in_order(fo.read_timeline(i, "latency")).select("run_id", "idx", "target", "avg_ms", "max_ms", "jitter_ms", "loss_pct", "resolve_ms", "hostname_resolved", F.size("raw_times_ms").alias("n_times"), "count"),
    f"select run_id, {_nth}, target, avg_ms::double avg_ms, max_ms::double max_ms, jitter_ms, loss_pct, resolve_ms, hostname_resolved, 0 n_times, 0::bigint count from v_lat", avg_ms=9, max_ms=9)
add("read_connections", lambda i: _in_order(fo.read_timeline(i, "connections")).select("run_id", "idx", "rel_seconds", "pid", "name", "laddr", "raddr", "status", "type"),
    f"select run_id, {_nth}, rel_seconds, pid, name, laddr, raddr, status, type from v_conn")
add("read_gpu_engine", lambda i: fo.read_timeline(i, "gpu_engine").select("run_id", "rel_seconds", "engine_type", "luid", "utilization_pct"),
    "select run_id, snapshot::double rel_seconds, engine_type, luid, utilization_pct from gpu_eng", utilization_pct=2)
add("read_gpu_process", lambda i: fo.read_timeline(i, "gpu_process").select("run_id", "rel_seconds", "pid", "dedicated_bytes", "shared_bytes"),
    "select run_id, snapshot::double rel_seconds, pid, dedicated_bytes, shared_bytes from gpu_mem")
add("read_gpu_adapter", lambda i: fo.read_timeline(i, "gpu_adapter").select("run_id", "adapter", "temperature_c", "power_w", "mem_used_mb", "utilization_pct"),
    "select run_id, adapter, temperature_c, power_w::double power_w, mem_used_mb, utilization_pct from v_gad", power_w=9)
add("read_process_events", lambda i: fo.read_process_events(i).select("run_id", "rel_seconds", "event", "pid", "name"),
    "select run_id, snapshot_ord::double rel_seconds, event, pid, name from proc_events")
add("read_service_events", lambda i: fo.read_service_events(i).groupBy("run_id", "rel_seconds", "event", "name", "from_pid", "to_pid").agg(F.count(F.lit(1)).alias("n")),
    "select run_id, snapshot_ord::double rel_seconds, event, name, from_pid, to_pid, count(*) n from (" + QUERIES["service_snapshot_diff"].sql + ") group by all")
add("read_event_log", lambda i: fo.read_event_log(i).select("run_id", "time", "level_code", "provider"),
    "select run_id, strftime(make_timestamp((round(rel_seconds*1e6)+1704067200000000)::bigint), '%Y-%m-%dT%H:%M:%S.%fZ') as time, level_code, provider from v_evt")
add("normalize_event_log",
    lambda i: de.normalize_event_log(fo.read_event_log(i).drop("rel_seconds", "timestamp"), i.runs.select("run_id", F.lit(1704067200.0 + 86400).alias("start_wall"), F.lit(1704067200.0 + 20 * 86400).alias("end_wall")))
        .select("run_id", "level_code", "provider", "rel_seconds"),
    "select run_id, level_code, provider, round_even(rel_seconds-86400,1) rel_seconds from v_evt where rel_seconds between 86400 and 20*86400", rel_seconds=1)
add("read_snapshots",
    lambda i: fo.read_snapshots(i, "process").select("run_id", F.lit("process").alias("what"), "snapshot_ord", "pid", "name").unionByName(
        fo.read_snapshots(i, "service").select("run_id", F.lit("service").alias("what"), "snapshot_ord", "pid", "name")),
    "select run_id, 'process' what, snapshot_ord%2 snapshot_ord, pid, name from v_snap union all select run_id, 'service', snapshot_ord%2, pid, name from v_svc")
add("read_inventory", lambda i: fo.read_inventory(i)[0], "select distinct run_id, concat('Scanner ',adapter) product from v_nic where adapter<>'eth2'")
add("vpn_suspect_adapters", lambda i: de.vpn_suspect_adapters(fo.read_inventory(i)[1]), "select distinct run_id, concat('WireGuard ',adapter) adapter from v_nic where adapter='eth1'")
add("write_tables", lambda i: fo.kept_tables(i), "select run_id, row_ord, rel_seconds, cpu_total_pct + case when run_id='run1' then 1000 else 0 end cpu_total_pct from v_sys where run_id<>'run2'", cpu_total_pct=6)
add("write_findings", lambda i: fo.kept_findings(i),
    "select run_id, 'anomalies' as name, count(*)::double as value from anomalies group by 1 union all select run_id, 'overall', overall::double from scores union all select run_id, unnest(['avg_ms','p95_ms','loss_pct']), unnest([avg_ms, p95_ms, loss_pct]) from x8", value=6)
add("write_comparison", lambda i: fo.kept_comparison(i), "select * replace (nullif(tags,'') as tags) from matrix")
