"""DuckDB SQL for the registered queries, as named steps that refer to each other.

`query_sql` prepends the steps a query needs. The steps follow the operator descriptions, one
plain window or join each, and know nothing of how Spark splits the work.
"""

from __future__ import annotations

import re

from ..functions.naming import BACKGROUND_NAMES, CRITICAL_NAMES, DISPLAY_NAMES, PROVIDER_BUCKETS, SCANNER_NAMES, SECURITY_NAMES
from .views import VIEWS, duckdb_view


def _in(names) -> str:
    return "(" + ",".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


def _values(table: dict[str, str], a: str, b: str) -> str:
    rows = ",".join("('{}','{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in table.items())
    return f"select * from (values {rows}) t({a},{b})"


def islands(source: str, flag: str, keys: str = "run_id") -> str:
    return (
        f"select {keys}, min(idx) s, max(idx) e from (select {keys}, idx, idx - row_number() over "
        f"(partition by {keys} order by idx) g from {source} where {flag}) group by {keys}, g"
    )


def merged(source: str, gap: int, keys: str = "run_id") -> str:
    return (
        f"select {keys}, min(s) s, max(e) e from (select *, sum(b) over (partition by {keys} order by s) grp from "
        f"(select *, case when s - lag(e) over (partition by {keys} order by s) <= {gap} then 0 else 1 end b from {source})) "
        f"group by {keys}, grp"
    )


def spans(windows: str, col: str) -> str:
    return (
        f"select w.run_id, s start_idx, e end_idx, min(rel_seconds) start_rel, max(rel_seconds) end_rel, count(*) samples, "
        f"max({col}) peak_pct, avg({col}) avg_pct from {windows} w join ix_sys r on w.run_id=r.run_id and r.idx between s and e group by 1,2,3"
    )


def ranked(source: str, columns: str, axis: str, order: str, n: int | None, tie: str, where: str = "true") -> str:
    cut = f" where rank<={n}" if n else ""
    return (
        f"select * from (select run_id, '{axis}' axis, row_number() over (partition by run_id order by {order}, {tie}) rank, {columns} "
        f"from {source} where {where}){cut}"
    )


def union(parts) -> str:
    return " union all ".join(parts)


def by_name(parts) -> str:
    return " union all by name ".join(parts)


_RANK = "pid, name, ppid, samples, cpu_pct_avg, cpu_pct_max, rss_mb_max, num_handles_max, handle_growth, num_threads_max, thread_growth, io_read_bps_avg, io_write_bps_avg, is_target"
_APP = "app_key, display_name, pid_count, samples, cpu_pct_avg, cpu_pct_max, rss_mb_max, num_handles_max, num_threads_max, io_read_bps_avg, io_write_bps_avg"
_MB = "(1024*1024)"


def _title(key: str) -> str:
    base = f"regexp_replace({key}, '\\.exe$', '')"
    return f"array_to_string(list_transform(regexp_extract_all({base},'[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]),'')"


def _display(key: str) -> str:
    return f"coalesce((select k.display from known_apps k where k.exe={key}), {_title(key)})"


def _point(dim: str, points: str, source: str) -> str:
    return f"select run_id, '{dim}' dim, {points} points from {source}"


def _grade(metric: str, kind: str, slope: str, unit: float, min_growth: float, final: str) -> str:
    return f"""
select run_id, '{kind}' kind, {final} confidence, pid, process_name, start_val, end_val, peak_val, growth, growth_ratio,
 slope*60 growth_per_min, slope, duration, r2, mono, plateau from (
select *, case when r2<0.15 or mono<0.55 or plateau>=0.35 then null when t4=3 then 'strong evidence' when t4=2 then 'likely' else 'suspicious' end grade from (
select *, case when mono<0.6 and t3=2 then 1 else t3 end t4 from (
select *, case when mono<0.7 and t2=3 then 2 else t2 end t3 from (
select *, case when r2<0.25 and t1=2 then 1 else t1 end t2 from (
select *, case when r2<0.4 and t0=3 then 2 else t0 end t1 from (
select *, case when sl/{unit}>=10 and growth_ratio>=0.5 then 3 when sl/{unit}>=3 and growth_ratio>=0.2 then 2 else 1 end t0 from (
select *, {slope} sl, end_val-start_val growth, case when start_val>0 then greatest(end_val-start_val,0)/start_val else 0 end growth_ratio
from trend where metric='{metric}') where duration>=120 and growth>={min_growth} and sl>={unit}))))) ) where grade is not null"""


STEPS: dict[str, str] = {v: duckdb_view(v) for v in VIEWS}
STEPS |= {
    "known_apps": _values(DISPLAY_NAMES, "exe", "display"),
    "known_providers": _values(PROVIDER_BUCKETS, "provider", "bucket"),
    "ix_sys": "select *, row_number() over (partition by run_id order by rel_seconds, row_ord)-1 idx from v_sys",
    # sustained load
    "cpu_isl": islands("ix_sys", "cpu_total_pct>=20"),
    "cpu_ok": "select * from cpu_isl where e-s+1>=5",
    "cpu_merged": merged("cpu_ok", 3),
    "a1": f"select *, 'cpu_sustained_high' kind, 'high' severity from ({spans('cpu_merged', 'cpu_total_pct')})",
    "mem_isl": islands("ix_sys", "mem_percent>=40"),
    "mem_ok": "select * from mem_isl where e-s+1>=4",
    "mem_merged": merged("mem_ok", 5),
    "a3": f"select *, 'memory_pressure' kind, case when peak_pct>=93 then 'high' else 'medium' end severity from ({spans('mem_merged', 'mem_percent')})",
    "dsk_isl": islands("ix_sys", "disk_active_pct_est>=20"),
    "dsk_ok": "select * from dsk_isl where e-s+1>=4",
    "dsk_merged": merged("dsk_ok", 3),
    "a5": f"select *, 'disk_active_high' kind, case when peak_pct>95 then 'high' else 'medium' end severity from ({spans('dsk_merged', 'disk_active_pct_est')})",
    "core_rows": "select run_id, idx, rel_seconds, c.core, try_cast(list_extract(string_split(cpu_per_core_pct,';'), c.core+1) as double) v from ix_sys, (select unnest([0,1,2,3]) core) c",
    "core_isl": islands("core_rows", "v>=20", "run_id, core"),
    "core_ok": "select * from core_isl where e-s+1>=4",
    "core_merged": merged("core_ok", 3, "run_id, core"),
    "a2": "select w.run_id, w.core, s start_idx, e end_idx, min(rel_seconds) start_rel, max(rel_seconds) end_rel, cast(count(*)/4 as bigint) samples, max(v) filter (where r.core=w.core) peak_pct, avg(v) filter (where r.core<>w.core) other_cores_avg_pct, 'cpu_single_core_saturation' kind, 'medium' severity from core_merged w join core_rows r on w.run_id=r.run_id and r.idx between s and e group by w.run_id, w.core, s, e having avg(v) filter (where r.core<>w.core) < 28",
    "a4": "select run_id, 'swap_usage' kind, case when max(swap_percent)>40 then 'medium' else 'low' end severity, max(swap_percent) peak_pct, avg(swap_percent) avg_pct from v_sys group by 1 having max(swap_percent)>20",
    "lat_t": "select run_id, target, count(avg_ms) n, avg(avg_ms) avg_ms, quantile_cont(avg_ms,0.95) p95_ms, max(avg_ms) peak_ms, avg(coalesce(loss_pct,0)) loss_pct from v_lat group by 1,2",
    "a6": "select run_id, 'network_unreachable' kind, 'high' severity, target, loss_pct from lat_t where n=0 and loss_pct>=50",
    "a7": "select run_id, 'network_latency_spike' kind, case when peak_ms>=498 then 'high' when peak_ms>=200 then 'medium' else 'low' end severity, target, avg_ms, p95_ms, peak_ms, loss_pct from lat_t where n>0 and (peak_ms>=200 or loss_pct>=5)",
    "anomalies": by_name(f"select * from a{i}" for i in range(1, 8)),
    # slowdown windows
    "mask": "select *, cpu_total_pct>=85 r_cpu, mem_percent>=85 r_memory, swap_percent>=35 r_swap, disk_active_pct_est>=85 r_disk from ix_sys",
    "sd_isl": islands("mask", "r_cpu or r_memory or r_swap or r_disk"),
    "sd_merged": merged("sd_isl", 1),
    "sd_ok": "select * from sd_merged where e-s+1>=3",
    "sd": "select w.run_id, s start_idx, e end_idx, min(rel_seconds) start_rel, max(rel_seconds) end_rel, count(*) samples, max(cpu_total_pct) peak_cpu_pct, max(mem_percent) peak_mem_pct, max(disk_active_pct_est) peak_disk_pct, max(swap_percent) peak_swap_pct from sd_ok w join mask m on w.run_id=m.run_id and m.idx between s and e group by 1,2,3",
    "sd_reason_rows": "select w.run_id, s start_idx, e end_idx, m.idx, x.ord, x.reason from sd_ok w join mask m on w.run_id=m.run_id and m.idx between s and e, lateral (select unnest([1,2,3,4]) ord, unnest(['cpu','memory','swap','disk']) reason, unnest([r_cpu,r_memory,r_swap,r_disk]) hit) x where x.hit",
    "sd_reasons": "select run_id, start_idx, end_idx, row_number() over (partition by run_id, start_idx order by n desc, first_idx, ord) rank, reason, n from (select run_id, start_idx, end_idx, reason, ord, count(*) n, min(idx) first_idx from sd_reason_rows group by 1,2,3,4,5)",
    "sd_hits": "select run_id, start_idx, end_idx, count(*) latency_hits, max(avg_ms) latency_peak_ms from (select w.run_id, start_idx, end_idx, avg_ms from sd w join v_lat l on w.run_id=l.run_id and l.rel_seconds between w.start_rel-10 and w.end_rel+10 where avg_ms>=200) group by 1,2,3",
    "sd_peaks": f"select w.run_id, start_idx, end_idx, name, max(cpu_pct) cpu, max(rss_bytes/{_MB}) rss_mb, max(io_read_bps+io_write_bps) io_bps from sd w join v_proc p on w.run_id=p.run_id and p.rel_seconds between w.start_rel and w.end_rel group by 1,2,3,4",
    "sd_offenders": "select * from (select run_id, start_idx, end_idx, name, axis, value, row_number() over (partition by run_id, start_idx, axis order by value desc, name) rank from (" + union(f"select run_id, start_idx, end_idx, name, '{a}' axis, {a} as value from sd_peaks" for a in ("cpu", "rss_mb", "io_bps")) + ") where value>0) where rank<=5",
    "sd_tags": "select run_id, start_idx, rank, reason from sd_reasons union all select run_id, start_idx, 99, 'network' from sd_hits",
    "sd_taglist": "select run_id, start_idx, string_agg(reason, ';' order by rank) reason_tags, count(*) n_tags, arg_min(reason, rank) first_tag from sd_tags group by 1,2",
    "sd_full": "select sd.*, t.reason_tags, t.first_tag, coalesce(h.latency_hits,0) latency_hits, case when samples>=20 and n_tags>=2 then 'strong evidence' when samples>=10 then 'likely' else 'suspicious' end confidence from sd left join sd_taglist t using (run_id, start_idx) left join sd_hits h using (run_id, start_idx)",
    # trends
    "grow_long": union(f"select run_id, pid, name, rel_seconds, row_ord, '{m}' metric, {m} as value from v_grow" for m in ("rss_bytes", "num_handles", "num_threads")),
    "grow_n": "select *, count(*) over (partition by run_id, pid, metric) n, row_number() over (partition by run_id, pid, metric order by rel_seconds, row_ord)-1 idx from grow_long",
    "grow_s": "select *, avg(value) over (partition by run_id, pid, metric order by rel_seconds, row_ord rows between greatest(5, n//20)-1 preceding and current row) smooth from grow_n where n>=20",
    "grow_l": "select *, lag(smooth) over (partition by run_id, pid, metric order by idx) prev, last_value(smooth) over (partition by run_id, pid, metric order by idx rows between unbounded preceding and unbounded following) final from grow_s",
    "trend": "select run_id, pid, metric, n, regr_slope(smooth, rel_seconds) slope, coalesce(case when var_pop(smooth)=0 then 0 else regr_r2(smooth, rel_seconds) end,0) r2, avg(case when prev is not null then (smooth>=prev)::int end) mono, arg_min(smooth, idx) start_val, max(final) end_val, max(smooth) peak_val, arg_max(name, idx) process_name, case when max(final)>0 then (n-1-coalesce(max(case when abs(smooth-final)>abs(final)*0.02 then idx end),-1))/n else 0 end plateau, case when max(rel_seconds)>min(rel_seconds) then max(rel_seconds)-min(rel_seconds) else 1.0 end duration from grow_l group by 1,2,3,4",
    "l3": _grade("rss_bytes", "memory_leak_candidate", "slope", 0.3, 1000000, "grade"),
    "l4": _grade("num_handles", "handle_leak_candidate", "slope*60", 0.02, 1000, "case when sl>=0.2*3 and grade<>'suspicious' and end_val>5000 then 'strong evidence' when sl>=0.2 and grade='suspicious' then 'likely' else grade end"),
    "l5": _grade("num_threads", "thread_leak_candidate", "slope*60", 0.001, 50, "case when sl>=0.01*3 and grade<>'suspicious' then 'strong evidence' when sl>=0.01 and grade='suspicious' then 'likely' else grade end"),
    "leaks": union(f"select * from l{i}" for i in (3, 4, 5)),
    # processes
    "pids": f"select *, round_even(cpu_pct_sum/samples,2) cpu_pct_avg, round_even(io_read_bps_sum/samples,1) io_read_bps_avg, round_even(io_write_bps_sum/samples,1) io_write_bps_avg, round_even(rss_bytes_max/{_MB},1) rss_mb_max, num_handles_max-num_handles_min handle_growth, num_threads_max-num_threads_min thread_growth from (select run_id, pid, max(name) as name, min(ppid) ppid, count(*) samples, sum(cpu_pct) cpu_pct_sum, max(cpu_pct) cpu_pct_max, max(rss_bytes) rss_bytes_max, coalesce(max(num_handles) filter (where num_handles>0),0) num_handles_max, coalesce(min(num_handles) filter (where num_handles>0),0) num_handles_min, coalesce(max(num_threads) filter (where num_threads>0),0) num_threads_max, coalesce(min(num_threads) filter (where num_threads>0),0) num_threads_min, sum(io_read_bps) io_read_bps_sum, sum(io_write_bps) io_write_bps_sum, max(io_read_bps) io_read_bps_max, max(io_write_bps) io_write_bps_max, max(is_target)=1 is_target, min(rel_seconds) first_seen, max(rel_seconds) last_seen from v_proc group by 1,2)",
    "offenders": union([
        ranked("pids", _RANK, "top_cpu", "cpu_pct_avg desc, cpu_pct_max desc", 10, "pid"),
        ranked("pids", _RANK, "top_rss", "rss_mb_max desc", 10, "pid"),
        ranked("pids", _RANK, "top_handles", "num_handles_max desc", 10, "pid"),
        ranked("pids", _RANK, "top_handle_growth", "handle_growth desc", 10, "pid", "handle_growth>0"),
        ranked("pids", _RANK, "top_threads", "num_threads_max desc", 10, "pid"),
        ranked("pids", _RANK, "top_thread_growth", "thread_growth desc", 10, "pid", "thread_growth>0"),
        ranked("pids", _RANK, "top_io", "io_read_bps_avg+io_write_bps_avg desc", 10, "pid"),
    ]),
    "security": ranked("pids", _RANK, "security", "cpu_pct_avg+io_read_bps_avg/1e6 desc", 10, "pid", f"lower(name) in {_in(SECURITY_NAMES)}"),
    "background": ranked("pids", _RANK, "background_noise", "cpu_pct_avg+rss_mb_max/100 desc", 10, "pid", f"lower(name) in {_in(BACKGROUND_NAMES)}"),
    "snap_ord": "select run_id, snapshot_ord, lag(snapshot_ord) over (partition by run_id order by snapshot_ord) prev_ord from (select distinct run_id, snapshot_ord from v_snap)",
    "proc_events": "select s.run_id, s.snapshot_ord, 'process_started' event, s.pid, s.name from v_snap s join snap_ord o on s.run_id=o.run_id and s.snapshot_ord=o.snapshot_ord where o.prev_ord is not null and not exists (select 1 from v_snap p where p.run_id=s.run_id and p.snapshot_ord=o.prev_ord and p.pid=s.pid) union all select s.run_id, o.snapshot_ord, 'process_ended', s.pid, s.name from v_snap s join snap_ord o on s.run_id=o.run_id and s.snapshot_ord=o.prev_ord where not exists (select 1 from v_snap p where p.run_id=s.run_id and p.snapshot_ord=o.snapshot_ord and p.pid=s.pid)",
    "churn": "select run_id, count(*) filter (where event='process_started') total_process_starts, count(*) filter (where event='process_ended') total_process_ends from proc_events group by 1",
    # applications
    "aticks": "select run_id, trim(lower(name)) app_key, rel_seconds, sum(cpu_pct) cpu_pct, sum(rss_bytes)::double rss_bytes, sum(num_handles)::double num_handles, sum(num_threads)::double num_threads, sum(io_read_bps) io_read_bps, sum(io_write_bps) io_write_bps, max(is_target)=1 is_target from v_proc group by 1,2,3",
    "apid": "select run_id, app_key, count(*) pid_count, array_to_string(list_sort(list(pid))[:25],';') pids from (select distinct run_id, trim(lower(name)) app_key, pid from v_proc) group by 1,2",
    "apps": f"select a.*, pid_count, pids, {_display('a.app_key')} display_name from (select run_id, app_key, count(*) samples, round_even(avg(cpu_pct),2) cpu_pct_avg, max(cpu_pct) cpu_pct_max, round_even(max(rss_bytes)/{_MB},1) rss_mb_max, max(num_handles)::bigint num_handles_max, max(num_threads)::bigint num_threads_max, round_even(avg(io_read_bps),1) io_read_bps_avg, round_even(avg(io_write_bps),1) io_write_bps_avg, max(io_read_bps) io_read_bps_max, max(io_write_bps) io_write_bps_max, bool_or(is_target) is_target, min(rel_seconds) first_seen, max(rel_seconds) last_seen from aticks group by 1,2) a join apid using (run_id, app_key)",
    "apps_ranked": union([
        ranked("apps", _APP, "top_cpu", "cpu_pct_avg desc, cpu_pct_max desc", 10, "app_key", "app_key<>'system idle process'"),
        ranked("apps", _APP, "top_rss", "rss_mb_max desc", 10, "app_key", "app_key<>'system idle process'"),
        ranked("apps", _APP, "top_handles", "num_handles_max desc", 10, "app_key", "app_key<>'system idle process'"),
        ranked("apps", _APP, "top_threads", "num_threads_max desc", 10, "app_key", "app_key<>'system idle process'"),
        ranked("apps", _APP, "top_io", "io_read_bps_avg+io_write_bps_avg desc", 10, "app_key", "app_key<>'system idle process'"),
        ranked("apps", _APP, "all_apps", "cpu_pct_avg+rss_mb_max/100 desc", None, "app_key", "app_key<>'system idle process'"),
    ]),
    # connections
    "conn": "select *, case when host in ('','0.0.0.0','::','127.0.0.1','::1') then null else host end remote from (select *, trim(lower(name)) app_key, case when raddr like '[%' then regexp_extract(raddr, '^\\[([^\\]]*)\\]', 1) else regexp_replace(raddr, ':[^:]*$', '') end host from v_conn where pid>0)",
    "conn_pid": f"select c.*, trim(lower(name)) app_key, {_display('trim(lower(name))')} display_name from (select run_id, pid, arg_min(name,row_ord) as name, count(distinct rel_seconds) snapshots_with_conns, count(*) total_conn_samples, round_even(count(*)/count(distinct rel_seconds),1) avg_concurrent_conns, round_even(100*count(*) filter (where type='tcp')/count(*),1) tcp_share_pct, round_even(100*count(*) filter (where type='udp')/count(*),1) udp_share_pct, count(distinct remote) unique_remote_count, array_to_string(list_sort(list(distinct remote) filter (where remote is not null))[:25],';') unique_remotes from conn group by 1,2) c",
    "conn_app": f"select c.*, {_display('app_key')} display_name from (select run_id, app_key, count(distinct pid) pid_count, count(distinct rel_seconds) snapshots_with_conns, count(*) total_conn_samples, round_even(count(*)/count(distinct rel_seconds),1) avg_concurrent_conns, round_even(100*count(*) filter (where type='tcp')/count(*),1) tcp_share_pct, round_even(100*count(*) filter (where type='udp')/count(*),1) udp_share_pct, count(distinct remote) unique_remote_count from conn group by 1,2) c",
    # latency
    "targets": "select *, row_number() over (partition by run_id order by loss_rate_pct desc, round_even(coalesce(rtt_avg_ms,0),2) desc, target) rank from (select run_id, target, coalesce(arg_min(hostname_resolved,row_ord) filter (where hostname_resolved<>''),'') hostname_resolved, count(*) samples, count(*) filter (where loss_pct>=100) fully_lost_samples, round_even(100*count(*) filter (where loss_pct>=100)/count(*),1) loss_rate_pct, avg(avg_ms) rtt_avg_ms, quantile_cont(avg_ms,0.95) rtt_p95_ms, max(max_ms) rtt_max_ms, avg(jitter_ms) jitter_avg_ms, avg(loss_pct) avg_loss_pct, avg(resolve_ms) resolve_avg_ms, quantile_cont(resolve_ms,0.95) resolve_p95_ms, max(resolve_ms) resolve_max_ms, count(*) filter (where resolve_ms is null) resolve_fail_samples, round_even(100*count(*) filter (where resolve_ms is null)/count(*),1) resolve_fail_rate_pct from v_lat group by 1,2)",
    # gpu
    "svc_ord": "select run_id, snapshot_ord, lag(snapshot_ord) over (partition by run_id order by snapshot_ord) prev_ord from (select distinct run_id, snapshot_ord from v_svc)",
    "svc_now": "select v.*, prev_ord from v_svc v join svc_ord using (run_id, snapshot_ord) where prev_ord is not null",
    "svc_before": "select v.run_id, o.snapshot_ord, v.name, v.status, v.pid from v_svc v join svc_ord o on v.run_id=o.run_id and v.snapshot_ord=o.prev_ord",
    "gpu_eng": "select run_id, snapshot, engine_type, luid, round_even(max(v),2) utilization_pct from (select *, case when et='' then '?' else et end engine_type, case when lu='' then '?' else lu end luid, greatest(0,least(100,value)) v from (select *, regexp_extract(instance,'engtype_([A-Za-z0-9]+)',1,'i') et, regexp_extract(instance,'luid_(0x[0-9A-Fa-f]+_0x[0-9A-Fa-f]+)',1,'i') lu from v_gpu)) where v>0 group by 1,2,3,4",
    "gpu_stats": "select run_id, engine_type, luid, round_even(avg(utilization_pct),2) avg_pct, round_even(max(utilization_pct),2) peak_pct, count(*) samples from gpu_eng group by 1,2,3",
    "gpu_raw": "select *, cast(regexp_extract(instance,'pid_(\\d+)',1) as bigint) pid, value*1048576 ded, value*1e5 shr from v_gpu",
    "gpu_mem": "select run_id, snapshot, pid, coalesce(d.b,0)::bigint dedicated_bytes, coalesce(s.b,0)::bigint shared_bytes from (select run_id, snapshot, pid, sum(trunc(ded)::bigint) b from gpu_raw group by 1,2,3) d full join (select run_id, snapshot, concat('1',pid)::bigint pid, sum(trunc(shr)::bigint) b from gpu_raw group by 1,2,3) s using (run_id, snapshot, pid)",
    "proc_names": "select run_id, pid, max(name) as name from v_proc where pid>0 group by 1,2",
    "gpu_pids": f"select m.run_id, m.pid, coalesce(n.name,'?') as name, m.dedicated_peak_mb, m.dedicated_avg_mb, m.shared_peak_mb, trim(lower(coalesce(n.name,'?'))) app_key, {_display('trim(lower(coalesce(n.name,chr(63))))')} display_name from (select run_id, pid, round_even(max(dedicated_bytes)/{_MB},1) dedicated_peak_mb, round_even(avg(dedicated_bytes)/{_MB},1) dedicated_avg_mb, round_even(max(shared_bytes)/{_MB},1) shared_peak_mb from gpu_mem where pid>0 group by 1,2) m left join proc_names n using (run_id, pid)",
    # events
    "ev": "select e.*, coalesce(p.bucket,'other') bucket from v_evt e left join known_providers p on e.provider=p.provider",
    "ev_match": "select e.run_id, e.row_ord, count(*) n_correlated, string_agg(concat(w.start_idx,':',w.first_tag), ';' order by w.start_rel) windows from ev e join sd_full w on e.run_id=w.run_id and e.rel_seconds between greatest(0,w.start_rel-15) and w.end_rel+15 group by 1,2",
    "ev_full": "select ev.*, coalesce(m.n_correlated,0) n_correlated, coalesce(m.windows,'') windows from ev left join ev_match m using (run_id, row_ord)",
    # bottlenecks and scores
    "points": union([
        _point("cpu", "100*avg((cpu_total_pct>=80)::int)", "v_sys group by 1"),
        _point("memory", "100*avg((mem_percent>=80)::int)", "v_sys group by 1"),
        _point("disk", "100*avg((disk_active_pct_est>=80)::int)", "v_sys group by 1"),
        "select run_id, case when kind like 'cpu%' then 'cpu' when kind in ('memory_pressure','swap_usage') then 'memory' when kind='disk_active_high' then 'disk' else 'network' end, case kind when 'cpu_sustained_high' then 25 when 'cpu_single_core_saturation' then 10 when 'memory_pressure' then 25 when 'swap_usage' then 10 when 'disk_active_high' then 25 when 'network_latency_spike' then 20 else 25 end * case when severity='high' then 1.5 else 1 end from anomalies",
        "select run_id, 'network', 10 from v_lat group by 1 having avg(avg_ms)>=200",
        "select run_id, reason, 5 from sd_tags where reason in ('cpu','memory','disk','network')",
        f"select run_id, 'security', 10 from sd_offenders where axis='cpu' and rank<=3 and lower(name) in {_in(SCANNER_NAMES)}",
    ]),
    "reason_rows": union([
        *[f"select run_id, '{d}' dim, 0 seq, 0 ord, 'pressure' kind, null::bigint start_idx, null::int core, null::varchar target, null::int place from v_sys group by 1 having avg(({c}>=80)::int)>0.1" for d, c in (("cpu", "cpu_total_pct"), ("memory", "mem_percent"), ("disk", "disk_active_pct_est"))],
        "select run_id, case when kind like 'cpu%' then 'cpu' when kind in ('memory_pressure','swap_usage') then 'memory' when kind='disk_active_high' then 'disk' else 'network' end, 1, case when kind in ('cpu_single_core_saturation','swap_usage') then 1 else 0 end, kind, start_idx, core, target, null from anomalies",
        "select run_id, 'network', 2, 0, 'mean_latency', null, null, null, null from v_lat group by 1 having avg(avg_ms)>=200",
        f"select run_id, 'security', 3, 0, 'scanner', start_idx, null, lower(name), rank from sd_offenders where axis='cpu' and rank<=3 and lower(name) in {_in(SCANNER_NAMES)}",
    ]),
    "dims": "select d.ord, d.dim, r.run_id from (select unnest([1,2,3,4,5,6]) ord, unnest(['cpu','memory','disk','network','security','background_noise']) dim) d, (select distinct run_id from v_sys) r",
    "bscores": "select d.run_id, d.dim, d.ord, coalesce(sum(p.points),0)::double points from dims d left join points p using (run_id, dim) group by 1,2,3",
    "branked": "select *, row_number() over (partition by run_id order by points desc, ord) rank from bscores",
    "bottleneck": 'select run_id, max(dim) filter (where rank=1 and points>15) "primary", coalesce(string_agg(dim, \';\' order by rank) filter (where rank between 2 and 4 and points>10),\'\') secondary from branked group by 1',
    "x4": "select s.run_id, cpu_std, mem_std, coalesce(n,0) anomaly_count, greatest(0,least(100,100-greatest(0,least(40,cpu_std*1.2))-greatest(0,least(30,mem_std*1.5))-greatest(0,least(40,coalesce(n,0)*5)))) stability from (select run_id, stddev_pop(cpu_total_pct) cpu_std, stddev_pop(mem_percent) mem_std from v_sys group by 1) s left join (select run_id, count(*) n from anomalies where severity in ('medium','high') group by 1) a using (run_id)",
    "x5": "select s.run_id, idle_pct, mem_free_pct, coalesce(b,0) background_cpu, greatest(0,least(100,idle_pct*0.5+mem_free_pct*0.4-coalesce(b,0)*0.2+20)) efficiency from (select run_id, avg(100-cpu_total_pct) idle_pct, avg(100-mem_percent) mem_free_pct from v_sys group by 1) s left join (select run_id, sum(cpu_pct_avg) b from background group by 1) using (run_id)",
    "x6": "select r.run_id, r.mode, t.n total_samples, coalesce(s.n,0)::bigint slowdown_samples, case when mode='workload' then greatest(0,least(100,100-coalesce(s.n,0)/t.n*100)) else 50.0 end workload from v_runs r left join (select run_id, count(*) n from v_sys group by 1) t using (run_id) left join (select run_id, sum(samples) n from sd group by 1) s using (run_id)",
    "x7": "select r.run_id, cpu, rss, case when cpu is null then 90.0 else greatest(0,least(100,100-cpu*1.5-rss*0.05)) end security from v_runs r left join (select run_id, sum(cpu_pct_avg) cpu, sum(rss_mb_max) rss from security where rank<=3 group by 1) using (run_id)",
    "x8": "select r.run_id, avg_ms, p95_ms, loss_pct, case when loss_pct is null then 70.0 when avg_ms is null then greatest(0,least(100,100-loss_pct)) else greatest(0,least(100,100-avg_ms*0.2-p95_ms*0.1-loss_pct*2)) end network from v_runs r left join (select run_id, avg(avg_ms) avg_ms, quantile_cont(avg_ms,0.95) p95_ms, avg(coalesce(loss_pct,0)) loss_pct from v_lat group by 1) using (run_id)",
    "x9": "select r.run_id, coalesce(p,0)::double penalty, coalesce(g,0) growers, greatest(0,least(100,100-coalesce(p,0)-coalesce(g,0)*1.5))::double hygiene from v_runs r left join (select run_id, sum(case confidence when 'strong evidence' then 20 when 'likely' then 10 else 3 end) p from leaks group by 1) using (run_id) left join (select run_id, count(*) g from offenders where axis='top_handle_growth' group by 1) using (run_id)",
    "scores": "select run_id, round_even(stability,1) stability, round_even(efficiency,1) efficiency, round_even(workload,1) workload, round_even(security,1) security, round_even(network,1) network, round_even(hygiene,1) hygiene, round_even(stability*0.25+efficiency*0.15+workload*0.15+security*0.10+network*0.15+hygiene*0.20,1) overall, case when total_samples<60 then 'low (short run)' when total_samples>=600 then 'high' else 'medium' end confidence, total_samples sample_count from x4 join x5 using (run_id) join x6 using (run_id) join x7 using (run_id) join x8 using (run_id) join x9 using (run_id)",
    "verdict": 'select s.run_id, coalesce(a.n,0) total_anomalies, coalesce(a.h,0) high_severity, coalesce(w.n,0) total_slowdown_windows, coalesce(l.n,0) total_leak_candidates, b."primary" primary_bottleneck from scores s left join bottleneck b using (run_id) left join (select run_id, count(*) n, count(*) filter (where severity=\'high\') h from anomalies group by 1) a using (run_id) left join (select run_id, count(*) n from sd group by 1) w using (run_id) left join (select run_id, count(*) n from leaks group by 1) l using (run_id)',
    # fleet
    "matrix": "select r.run_id, r.hostname, r.mode, '' tags, cast(null as double) duration_s, m.samples, s.overall, s.stability, s.efficiency, s.workload, s.security, s.network, s.hygiene, b.\"primary\", m.cpu_avg, m.cpu_p95, m.mem_avg, m.disk_avg, l.latency_p95_ms, v.total_anomalies anomalies, v.total_slowdown_windows slowdowns, coalesce(k.m,0) memory_leaks, coalesce(k.h,0) handle_leaks, coalesce(c.total_process_starts,0) process_starts from v_runs r join scores s using (run_id) join bottleneck b using (run_id) join (select run_id, count(*) samples, round_even(avg(cpu_total_pct),1) cpu_avg, round_even(quantile_cont(cpu_total_pct,0.95),1) cpu_p95, round_even(avg(mem_percent),1) mem_avg, round_even(avg(disk_active_pct_est),1) disk_avg from v_sys group by 1) m using (run_id) left join (select run_id, round_even(quantile_cont(avg_ms,0.95),1) latency_p95_ms from v_lat group by 1) l using (run_id) join verdict v using (run_id) left join (select run_id, count(*) filter (where kind='memory_leak_candidate') m, count(*) filter (where kind='handle_leak_candidate') h from leaks group by 1) k using (run_id) left join churn c using (run_id)",
    "rankings": "select ranking, row_number() over (partition by ranking order by k, run_id) rank, run_id, value from (" + union(
        [f"select 'best_{m}' ranking, run_id, {m}::double as value, -{m} k from matrix" for m in ("overall", "stability", "efficiency", "workload", "security", "network", "hygiene")]
        + [f"select '{n}', run_id, {m}::double, {m} from matrix" for n, m in (("lowest_cpu_avg", "cpu_avg"), ("lowest_latency_p95", "latency_p95_ms"), ("fewest_anomalies", "anomalies"))]
    ) + ") where value is not null",
    "kinds": "select run_id, kind problem from anomalies union select run_id, concat('slowdown_',reason) from sd_tags",
    # charts
    "grid_ticks": "select *, row_number() over (partition by run_id order by rel_seconds)-1 idx, count(*) over (partition by run_id) n from (select distinct run_id, rel_seconds from v_proc)",
    "grid_axis": "select run_id, rel_seconds from grid_ticks where idx % (case when n>400 then n//400+1 else 1 end) = 0",
    "grid_vals": union(f"select run_id, app_key, rel_seconds, '{m}' metric, {e} as value from aticks where app_key<>'system idle process'" for m, e in (("cpu", "cpu_pct"), ("rss_mb", f"rss_bytes/{_MB}"))),
    "grid_top": "select * from (select run_id, metric, app_key, row_number() over (partition by run_id, metric order by total desc, app_key) rank from (select run_id, metric, app_key, case when metric='cpu' then sum(value) else max(value) end total from grid_vals group by 1,2,3)) where rank<=6",
    "grid_named": "select v.run_id, v.metric, v.rel_seconds, coalesce(t.app_key,'other') series, v.value from grid_vals v left join grid_top t on v.run_id=t.run_id and v.metric=t.metric and v.app_key=t.app_key",
    "grid_series": "select distinct run_id, metric, app_key series from grid_top union select run_id, metric, 'other' from grid_named where series='other' group by 1,2 having max(value)>0",
    "psum": "select *, row_number() over (partition by run_id order by total desc, pid) rank from (select run_id, pid, max(name) as name, sum(cpu_pct) total from v_proc group by 1,2)",
    "ptop": "select p.*, t.rank, row_number() over (partition by p.run_id, p.pid order by rel_seconds, row_ord, cpu_pct)-1 idx, count(*) over (partition by p.run_id, p.pid) n from v_proc p join psum t on p.run_id=t.run_id and p.pid=t.pid where t.rank<=6",
    "critical": f"select unnest({list(CRITICAL_NAMES)}) nm",
}

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def query_sql(sql: str, rounds: dict[str, int]) -> str:
    """``sql`` with the steps it needs in front and the given columns rounded."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(_WORD.findall(text)):
            if word in STEPS and word not in needed:
                body = STEPS[word]
                if re.search(rf"\b(from|join)\s+{word}\b", text):
                    visit(body)
                    if word not in needed:
                        needed.append(word)

    visit(sql)
    head = "with " + ", ".join(f"{n} as ({STEPS[n]})" for n in needed) + " " if needed else ""
    if rounds:
        cut = ", ".join(f'round("{c}", {d}) as "{c}"' for c, d in rounds.items())
        return f"{head}select * replace ({cut}) from ({sql})"
    return head + sql
