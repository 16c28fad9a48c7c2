"""Telemetry tables derived from the given star-schema tables, in two SQL dialects.

The text of a view is shared; the places where the dialects differ are filled in from
``SPARK`` / ``DUCKDB``. Two views need a running total per process; Spark derives that with
`prefix_sums` so that no process has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import configure
from ..operators.series import dense_index, prefix_sums

_PICK = "'chrome.exe','MsMpEng.exe','svchost.exe','OneDrive.exe','python.exe','foo-bar.exe','System Idle Process','Teams.exe'"
_SLOT = "cast(l_suppkey%8+1 as int)"
SPARK = {
    "US": "unix_micros(cast(ts as timestamp))",
    "JS": "get_json_object(props,'$.k')",
    "DAY": "datediff(l_shipdate, date'1995-01-01')",
    "ODAY": "datediff(o_orderdate, date'1995-01-01')",
    "PICK": f"element_at(array({_PICK}), {_SLOT})",
}
DUCKDB = {
    "US": "epoch_us(ts)",
    "JS": "json_extract_string(props,'$.k')",
    "DAY": "date_diff('day', date '1995-01-01', l_shipdate::date)",
    "ODAY": "date_diff('day', date '1995-01-01', o_orderdate::date)",
    "PICK": f"([{_PICK}])[{_SLOT}]",
}
_REL = "({US}-1704067200000000)/1e6"
_NO_REPLY = "(o_orderkey%10=0 or (o_orderpriority='5-LOW' and o_custkey%4=3))"
_STEP = "cast(floor(value*100) as bigint) * case when user_id%50%3=0 then -1 when user_id%50%3=1 and event_id%3=0 then -9 else 10 end"

VIEWS = {
    "v_runs": "select concat('run',cast(user_id%4 as string)) run_id, concat('HOST',cast(user_id%2 as string)) hostname, case when user_id%4=3 then 'support' else 'workload' end mode, count(*) samples from events group by 1,2,3",
    "v_sys": f"select concat('run',cast(user_id%4 as string)) run_id, event_id row_ord, {_REL} rel_seconds, least(value,100.0) cpu_total_pct, cast({{JS}} as double) mem_percent, cast((event_id*7)%40 as double) swap_percent, least(value*0.8,100.0) disk_active_pct_est, concat_ws(';', cast(cast(floor(least(value,100.0)) as int) as string), cast(event_id%60 as string), cast((event_id*3)%60 as string), cast((event_id*11)%60 as string)) cpu_per_core_pct, value*1e5 net_sent_bytes_per_sec, value*3e4 net_recv_bytes_per_sec from events",
    "v_proc": "select concat('run',cast(l_orderkey%4 as string)) run_id, l_orderkey*10+l_linenumber row_ord, l_suppkey pid, l_suppkey%7 ppid, {PICK} name, cast({DAY}*1037 as double) rel_seconds, l_quantity cpu_pct, cast(floor(l_extendedprice*1000) as bigint) rss_bytes, cast(l_linenumber as bigint) num_threads, l_partkey num_handles, l_extendedprice*l_discount io_read_bps, l_extendedprice*l_tax io_write_bps, case when l_linestatus='O' and l_suppkey%10=0 then 1 else 0 end is_target from lineitem",
    "v_grow": f"select *, cast(floor(rss_bytes/1000.0) as bigint) num_handles, cast(floor(rss_bytes/20000.0) as bigint) num_threads from (select concat('run',cast(user_id%50%4 as string)) run_id, event_id row_ord, user_id%50 pid, concat('app',cast(user_id%50%9 as string),'.exe') name, {_REL} rel_seconds, cast(sum({_STEP}) over (partition by user_id%50 order by event_id) + 5000000 as bigint) rss_bytes from events) g",
    "v_lat": f"select concat('run',cast(o_custkey%4 as string)) run_id, o_orderkey row_ord, o_orderpriority target, cast({{ODAY}}*1037 as double) rel_seconds, case when {_NO_REPLY} then null else o_totalprice/1000 end avg_ms, case when {_NO_REPLY} then null else o_totalprice/800 end max_ms, cast(o_orderkey%7 as double) jitter_ms, cast(case when {_NO_REPLY} then 100 when o_orderkey%5=1 then 50 else 0 end as double) loss_pct, case when o_orderkey%4=0 then null else cast(o_custkey%400 as double) end resolve_ms, case when o_orderkey%3=0 then '' else concat('host-',lower(o_orderpriority)) end hostname_resolved from orders",
    "v_rep": "select concat('run',cast(o_custkey%4 as string)) run_id, o_orderkey row_ord, o_orderpriority target, 4 count, case o_orderkey%4 when 0 then '' when 1 then cast(o_orderkey%50 as string) when 2 then concat_ws(';',cast(o_orderkey%50 as string),cast(o_orderkey%31 as string)) else concat_ws(';',cast(o_orderkey%50 as string),cast(o_orderkey%31 as string),cast(o_orderkey%17 as string),cast(o_orderkey%23 as string)) end raw_times_ms from orders",
    "v_svc": "select concat('run',cast(o_custkey%4 as string)) run_id, cast(floor({ODAY}/30) as bigint) snapshot_ord, concat('svc',cast(o_custkey%30 as string)) name, max(o_orderstatus) status, max(o_orderkey%6) pid from orders group by 1,2,3",
    "v_txt": "select concat('run',cast(user_id%4 as string)) run_id, event_id row_ord, case event_id%5 when 0 then '' when 1 then event_type when 2 then cast(event_id as string) when 3 then concat(cast(event_id as string),'.9') else concat('-',cast(event_id as string),'.7') end raw from events",
    "v_conn": "select concat('run',cast(o_custkey%4 as string)) run_id, o_orderkey row_ord, cast({ODAY}*1037 as double) rel_seconds, o_custkey%50 pid, concat('app',cast(o_custkey%50%9 as string),'.exe') name, concat('192.168.0.1:',cast(o_orderkey%60000 as string)) laddr, case when o_orderkey%9=0 then '' when o_orderkey%9=1 then concat('[fe80::',cast(o_custkey%5 as string),']:443') when o_orderkey%9=2 then '127.0.0.1:80' else concat('10.0.',cast(o_custkey%3 as string),'.',cast(o_orderkey%40 as string),':443') end raddr, case o_orderstatus when 'O' then 'ESTABLISHED' when 'F' then 'TIME_WAIT' else '' end status, case when o_orderkey%5=0 then 'udp' else 'tcp' end type from orders",
    "v_evt": f"select concat('run',cast(user_id%4 as string)) run_id, event_id row_ord, {_REL} rel_seconds, event_id%3+1 level_code, case event_id%4 when 0 then 'disk' when 1 then 'Service Control Manager' when 2 then 'Application Error' else 'Unlisted' end provider from events",
    "v_io": "select concat('run',cast(l_orderkey%4 as string)) run_id, l_orderkey*10+l_linenumber row_ord, case l_returnflag when 'A' then 'DiskRead' when 'N' then 'FileWrite' else 'FileIo' end event_name, l_suppkey%60 pid, l_partkey bytes from lineitem",
    "v_snap": "select distinct concat('run',cast(l_orderkey%4 as string)) run_id, cast(floor({DAY}/30) as bigint) snapshot_ord, l_suppkey pid, {PICK} name from lineitem",
    "v_gpu": "select concat('run',cast(user_id%4 as string)) run_id, event_id row_ord, cast(floor(({US}-1704067200000000)/3600000000) as bigint) snapshot, concat('pid_',cast(user_id as string),'_luid_0x00000000_0x0000A2',cast(user_id%2 as string),'_phys_0_eng_3_engtype_',case event_id%3 when 0 then '3D' when 1 then 'Copy' else 'VideoDecode' end) instance, value from events",
    "v_ctr": f"select concat('run',cast(user_id%4 as string)) run_id, user_id pid, event_id row_ord, {_REL} mono, sum(cast(floor(value*1000) as bigint)) over (partition by user_id order by event_id) read_bytes from events",
    "v_tot": f"select concat('run',cast(user_id%4 as string)) run_id, event_id row_ord, {_REL} mono, cast(event_id*1000+floor(value*100) as bigint) disk_read_bytes, cast(event_id*3 as bigint) disk_write_count, cast(event_id*2000+floor(value*5000) as bigint) disk_busy_ms, cast(event_id*500 as bigint) net_bytes_sent, cast(event_id*7 as bigint) ctx_switches from events",
    "v_nic": "select concat('run',cast(o_custkey%4 as string)) run_id, concat('eth',cast(o_custkey%3 as string)) adapter, cast({ODAY}*1037 as double) mono, max(o_orderkey)*100 bytes_sent, max(o_orderkey) packets_recv from orders group by 1,2,3",
    "v_gad": "select concat('run',cast(o_custkey%4 as string)) run_id, concat('gpu',cast(o_custkey%3 as string)) adapter, case when o_orderkey%7=0 then null else cast(o_orderkey%90 as double) end temperature_c, o_totalprice/2000 power_w, cast(o_custkey%800 as double) mem_used_mb, cast(o_orderkey%101 as double) utilization_pct from orders",
}
_TABLE = {v: next(t for t in ("events", "lineitem", "orders") if f"from {t}" in sql) for v, sql in VIEWS.items()}


def duckdb_view(name: str) -> str:
    return VIEWS[name].format(**DUCKDB)


class Views:
    """Lazy access to the views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._build(f"v_{name}")
        return self._made[name]

    def _build(self, view: str) -> DataFrame:
        if view == "v_grow":
            return self._grow()
        if view == "v_ctr":
            return self._counters()
        table = _TABLE[view]
        sql = VIEWS[view].format(**SPARK).replace(f"from {table}", "from {" + table + "}")
        return self.spark.sql(sql, **{table: self.table(table)})

    def dealt(self, view: str, *keys: str) -> DataFrame:
        """The rows of a ``select distinct`` view, sent once by ``keys``: what is keyed by them later needs no second shuffle."""
        table = _TABLE[view]
        sql = VIEWS[view].format(**SPARK).replace(f"from {table}", "from {" + table + "}")
        return self.spark.sql(sql.replace("select distinct", "select", 1), **{table: self.table(table)}).repartition(*keys).distinct()

    def _events(self) -> DataFrame:
        rel = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6
        return self.table("events").withColumn("rel_seconds", rel)

    def _grow(self) -> DataFrame:
        d = self._events().select(
            F.expr("concat('run',cast(user_id%50%4 as string))").alias("run_id"),
            F.col("event_id").alias("row_ord"), F.expr("user_id%50").alias("pid"),
            F.expr("concat('app',cast(user_id%50%9 as string),'.exe')").alias("name"),
            "rel_seconds", F.expr(_STEP).alias("_step"),
        )
        keys = ("run_id", "pid")
        d = prefix_sums(dense_index(d, keys, ("row_ord",)), {"_sum": F.col("_step")}, keys)
        d = d.withColumn("rss_bytes", F.col("_sum") + 5000000).drop("_sum", "_step", "idx")
        return d.withColumns(
            {"num_handles": F.expr("cast(floor(rss_bytes/1000.0) as bigint)"), "num_threads": F.expr("cast(floor(rss_bytes/20000.0) as bigint)")}
        )

    def _counters(self) -> DataFrame:
        d = self._events().select(
            F.expr("concat('run',cast(user_id%4 as string))").alias("run_id"), F.col("user_id").alias("pid"),
            F.col("event_id").alias("row_ord"), F.col("rel_seconds").alias("mono"),
            F.expr("cast(floor(value*1000) as bigint)").alias("_step"),
        )
        keys = ("run_id", "pid")
        d = prefix_sums(dense_index(d, keys, ("row_ord",)), {"read_bytes": F.col("_step")}, keys)
        return d.drop("_step", "idx")
