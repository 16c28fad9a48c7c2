"""Run folders made of the views, so that the readers and writers are checked on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import scratch_folder, written
from ..operators import compare, derive
from ..sources import run_folders, store, writers

START = 1704067200  # epoch seconds of the views' rel_seconds 0


def manifests(i) -> DataFrame:
    """A manifest per run; one limit is overridden per run, one name is unknown."""
    limits = F.create_map(F.lit("cpu_sustained_pct"), (F.col("samples") % 100).cast("string"), F.lit("no_such_limit"), F.lit("1"))
    document = F.struct("run_id", "hostname", "mode", F.col("samples").cast("double").alias("duration_actual_seconds"), limits.alias("thresholds"))
    return i.runs.select(F.col("run_id").alias("run_folder"), F.lit("manifest.json").alias("file"), F.to_json(document).alias("text"))


def event_log(i) -> DataFrame:
    time = F.date_format(F.timestamp_micros((F.round(F.col("rel_seconds") * 1e6) + START * 1_000_000).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    events = i.evt.select("run_id", "row_ord", time.alias("time"), "level_code", "provider")
    files = writers.array_files(events, "event_log", "row_ord")
    return files.withColumn("text", F.concat(F.lit('{"events":'), "text", F.lit("}")))


def snapshots(df: DataFrame, what: str) -> DataFrame:
    """Snapshots with an even number as those at the start, the others as those at the end.

    They are written once, as each of the two is read twice for its order.
    """
    df = written(df)
    kind = lambda rest, name: writers.array_files(df.filter(F.col("snapshot_ord") % 2 == rest).withColumn("at", F.xxhash64("snapshot_ord", "name")).drop("snapshot_ord"), f"{what}_{name}", "at")
    both = kind(0, "start").unionByName(kind(1, "end"))
    return both.withColumn("file", F.regexp_replace("file", r"\.json$", "_snapshot.json"))


def inventory(i) -> DataFrame:
    names = i.nic.select("run_id", "adapter").distinct().groupBy("run_id").agg(F.array_sort(F.collect_list("adapter")).alias("a"))
    tunnel = F.transform("a", lambda x: F.struct(F.when(x == "eth1", F.concat(F.lit("WireGuard "), x)).otherwise(x).alias("Name")))
    products = F.transform(F.filter("a", lambda x: x != "eth2"), lambda x: F.struct(F.concat(F.lit("Scanner "), x).alias("displayName")))
    document = F.struct(F.struct(products.alias("antivirus_products")).alias("security"), F.struct(tunnel.alias("adapters_wmi")).alias("network"))
    return names.select(F.col("run_id").alias("run_folder"), F.lit("static_snapshot.json").alias("file"), F.to_json(document).alias("text"))


def timeline(i, kind: str) -> DataFrame:
    df = {
        "system": lambda: i.sys, "process": lambda: i.proc, "latency": lambda: i.lat, "connections": lambda: i.conn,
        "network": lambda: i.nic.select("run_id", F.col("mono").alias("rel_seconds"), "adapter", F.col("bytes_sent").alias("bytes_sent_per_sec"), F.lit("").alias("connections_established")),
        "gpu_engine": lambda: i.engines.withColumn("rel_seconds", F.col("snapshot").cast("double")),
        "gpu_process": lambda: i.gpu_memory.withColumn("rel_seconds", F.col("snapshot").cast("double")),
        "gpu_adapter": lambda: i.gad.withColumn("rel_seconds", F.col("mem_used_mb")),
    }[kind]()
    return writers.timeline_files(df, kind, 5_000)


def root(i, *files: DataFrame) -> str:
    """A new root folder with the manifests and these files."""
    path = f"{scratch_folder(i.spark)}/runs-{uuid.uuid4().hex}"
    writers.write_run_folders([manifests(i), *files], path)
    return path


def read_timeline(i, kind: str) -> DataFrame:
    return run_folders.read_timeline(i.spark, root(i, timeline(i, kind)), kind)


def read_process_events(i) -> DataFrame:
    events = i.events_diff.withColumn("rel_seconds", F.col("snapshot_ord").cast("double"))
    return run_folders.read_process_events(i.spark, root(i, writers.array_files(events, "process_events", "snapshot_ord")))


def read_service_events(i) -> DataFrame:
    events = derive.service_snapshot_diff(i.svc).withColumn("rel_seconds", F.col("snapshot_ord").cast("double"))
    return run_folders.read_service_events(i.spark, root(i, writers.array_files(events, "service_events", "snapshot_ord")))


def read_event_log(i) -> DataFrame:
    return run_folders.read_event_log(i.spark, root(i, event_log(i)))


def read_snapshots(i, what: str) -> DataFrame:
    df = i.snap if what == "process" else i.svc
    read = run_folders.read_process_snapshots if what == "process" else run_folders.read_service_snapshots
    return read(i.spark, root(i, snapshots(df, what)))


def kept_tables(i) -> DataFrame:
    """System rows in a store: all runs first, then two of them again with other values, then one of these without rows."""
    path = f"{scratch_folder(i.spark)}/store-{uuid.uuid4().hex}"
    rows = i.sys.select("run_id", "row_ord", "rel_seconds", "cpu_total_pct")
    again = rows.filter("run_id in ('run1', 'run2')").withColumn("cpu_total_pct", F.col("cpu_total_pct") + 1000)
    store.put(rows, path, ("rel_seconds", "row_ord"))
    store.put(again, path, ("rel_seconds", "row_ord"))
    gone = rows.filter("run_id = 'run2'").select("run_id").distinct()
    store.put(rows.limit(0), path, runs=gone)
    return store.get(i.spark, path, rows.schema)


def kept_findings(i) -> DataFrame:
    """Anomalies, scores and their inputs of all runs in a store, counted after reading."""
    path = f"{scratch_folder(i.spark)}/store-{uuid.uuid4().hex}"
    tables = {"anomalies": i.kept("anomalies"), "scores": i.kept("scores"), "score_inputs": i.kept("score_inputs")}
    store.put_findings({"anomalies": tables["anomalies"]}, tables["scores"], tables["score_inputs"], i.runs, path)
    back = {n: store.get(i.spark, f"{path}/{n}", df.schema) for n, df in tables.items()}
    rows = [
        back["anomalies"].groupBy("run_id").agg(F.count(F.lit(1)).cast("double").alias("value")).select("run_id", F.lit("anomalies").alias("name"), "value"),
        back["scores"].select("run_id", F.lit("overall").alias("name"), F.col("overall").cast("double").alias("value")),
        back["score_inputs"].filter("score = 'network'").select("run_id", F.col("input").alias("name"), "value"),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def kept_comparison(i) -> DataFrame:
    """The matrix of a written comparison."""
    path = f"{scratch_folder(i.spark)}/comparison-{uuid.uuid4().hex}"
    matrix = i.kept("matrix")
    observations = compare.pairwise_observations(matrix)
    problems = compare.common_and_unique_problems(i.runs, i.kept("anomalies"), i.kept("slowdowns"))
    writers.write_comparison(matrix, i.rankings, observations, problems, compare.comparison_winners(i.rankings), path)
    return i.spark.read.schema(matrix.schema).option("header", True).csv(f"{path}/matrix")


def read_inventory(i) -> tuple[DataFrame, DataFrame]:
    return run_folders.read_inventory(i.spark, root(i, inventory(i)))
