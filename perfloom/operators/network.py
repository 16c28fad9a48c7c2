"""Connections attributed to processes and applications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import text_or_unknown
from ..functions.naming import app_key, display_name, is_remote, strip_port
from .series import top_k


def _owned(connections: DataFrame) -> DataFrame:
    """Rows with an owner, the application key and the remote host (null when local)."""
    host = strip_port("raddr")
    return connections.filter(F.col("pid") > 0).select(
        "run_id", "rel_seconds", "pid", "row_ord",
        text_or_unknown("name").alias("name"),
        app_key("name").alias("app_key"),
        F.when(is_remote(host), host).alias("remote"),
        "status", "type",
    )


def _summary(rows: DataFrame, by: list[str], extra: list) -> DataFrame:
    total = F.count(F.lit(1))
    share = lambda kind: F.bround(100 * F.count(F.when(F.col("type") == kind, 1)) / total, 1)
    return rows.groupBy(*by).agg(
        F.count_distinct(F.coalesce("rel_seconds", F.lit(float("nan")))).alias("snapshots_with_conns"),
        total.alias("total_conn_samples"),
        share("tcp").alias("tcp_share_pct"),
        share("udp").alias("udp_share_pct"),
        F.count_distinct("remote").alias("unique_remote_count"),
        *extra,
    ).withColumn(
        "avg_concurrent_conns", F.bround(F.col("total_conn_samples") / F.col("snapshots_with_conns"), 1)
    )


def _ranked(d: DataFrame, tie: str, n: int | None) -> DataFrame:
    return top_k(d, ["run_id"], [F.desc("avg_concurrent_conns"), F.desc("unique_remote_count"), F.asc(tie)], n)


def pid_remotes(connections: DataFrame) -> DataFrame:
    """All (run, pid, remote host), a row each."""
    return _owned(connections).filter("remote is not null").select("run_id", "pid", "remote").distinct()


def connections_by_pid(connections: DataFrame, n: int | None = 10, listed: int | None = 25) -> DataFrame:
    """``listed``: how many remote hosts are named per process (None: all)."""
    rows = _owned(connections)
    top = _ranked(_summary(rows, ["run_id", "pid"], [F.min_by("name", "row_ord").alias("name")]), "pid", n)
    first = top_k(pid_remotes(connections), ["run_id", "pid"], [F.asc("remote")], listed, "_pos").groupBy("run_id", "pid").agg(F.array_sort(F.collect_list("remote")).alias("unique_remotes"))
    d = top.join(first, ["run_id", "pid"], "left")
    return d.withColumns(
        {
            "unique_remotes": F.coalesce("unique_remotes", F.array().cast("array<string>")),
            "app_key": app_key("name"),
            "display_name": display_name(app_key("name")),
        }
    )


def connections_by_app(connections: DataFrame, n: int | None = 10) -> DataFrame:
    rows = _owned(connections)
    d = _summary(rows, ["run_id", "app_key"], [F.count_distinct("pid").alias("pid_count")])
    return _ranked(d, "app_key", n).withColumn("display_name", display_name("app_key"))


def top_remotes(connections: DataFrame, by: str = "pid", n: int | None = None) -> DataFrame:
    """Most contacted hosts: 5 per pid, 10 per application unless ``n`` says otherwise."""
    counts = _owned(connections).filter("remote is not null").groupBy("run_id", by, "remote").agg(
        F.count(F.lit(1)).alias("samples")
    )
    n = n or (5 if by == "pid" else 10)
    return top_k(counts, ["run_id", by], [F.desc("samples"), F.asc("remote")], n)


def connection_status_counts(connections: DataFrame, by: str = "pid") -> DataFrame:
    rows = _owned(connections).filter(F.coalesce("status", F.lit("")) != "")
    return rows.groupBy("run_id", by, "status").agg(F.count(F.lit(1)).alias("n"))
