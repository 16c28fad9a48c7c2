"""Read the CSV timelines and JSON documents of many run folders under one root."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import parse_semicolon_list, to_float, to_int
from ..schemas import (
    EVENT_LOG, INVENTORY, MANIFEST, PROCESS_EVENT, PROCESS_SNAPSHOT, SERVICE_EVENT,
    SERVICE_SNAPSHOT, TIMELINES,
)
from ..thresholds import MANIFEST_FIELDS, Thresholds
from .folder_files import registered


def coerce_timeline(df: DataFrame, kind: str) -> DataFrame:
    """Text columns of a timeline -> their types; further columns (run, order) are kept."""

    def typed(name: str, how: str) -> Column:
        c = {
            "f": lambda: to_float(name),
            "i": lambda: to_int(name),
            "i-1": lambda: to_int(name, -1),
            "cores": lambda: parse_semicolon_list(name),
            "times": lambda: parse_semicolon_list(name, "bigint"),
            "s": lambda: F.col(name),
        }[how]()
        return c.alias(name)

    columns = TIMELINES[kind]
    return df.select(*[c for c in df.columns if c not in columns], *[typed(c, how) for c, how in columns.items()])


def folder_of(path: Column) -> Column:
    """The folder that a file is in. It is asked for every row of a document; a pattern that is tried at each place
    of a long path takes most of the reading time."""
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def _read(reader, fmt: str, spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A missing file is an empty table."""
    try:
        df = reader.schema(schema).format(fmt).load(path)
        return df.select(
            folder_of(F.col("_metadata.file_path")).alias("run_folder"),
            F.monotonically_increasing_id().alias("row_ord"),  # a document is read whole by one task
            F.col("_metadata.file_name").alias("file_name"), "*",
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"run_folder string, row_ord bigint, file_name string, {schema}")


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _read(spark.read.option("multiLine", True), "json", spark, schema, path)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per manifest, with the run's limits as ``th_*`` columns (unknown names are ignored)."""
    d = _documents(spark, f"{root}/*/manifest.json", MANIFEST).drop("row_ord", "file_name")
    base = Thresholds()
    own = {
        f"th_{n}": F.coalesce(
            F.try_element_at("thresholds", F.lit(n)).try_cast("double"), F.lit(float(getattr(base, n)))
        )
        for n in MANIFEST_FIELDS
    }
    d = d.withColumn("run_id", F.coalesce("run_id", "run_folder"))
    return d.withColumns(own).drop("thresholds").withColumn("duration_s", F.col("duration_actual_seconds"))


def discover_runs(spark: SparkSession, root: str, at_least: int = 1) -> DataFrame:
    """Runs under ``root`` (folders with a manifest); an error if there are too few to compare."""
    runs = read_runs(spark, root)
    found = len(runs.select("run_id").take(at_least))
    if found < at_least:
        raise ValueError(f"need at least {at_least} run folders under {root}, found {found}")
    return runs


def read_timeline(spark: SparkSession, root: str, kind: str, runs: DataFrame | None = None) -> DataFrame:
    runs = read_runs(spark, root) if runs is None else runs
    raw = registered(spark).read.format("run_timeline").option("table", kind).load(root)
    return coerce_timeline(runs.select("run_folder", "run_id").join(raw, "run_folder").drop("run_folder"), kind)


def read_system(spark, root, runs=None) -> DataFrame:
    return read_timeline(spark, root, "system", runs)


def read_process(spark, root, runs=None) -> DataFrame:
    return read_timeline(spark, root, "process", runs)


def read_network(spark, root, runs=None) -> DataFrame:
    return read_timeline(spark, root, "network", runs)


def read_latency(spark, root, runs=None) -> DataFrame:
    return read_timeline(spark, root, "latency", runs)


def read_connections(spark, root, runs=None) -> DataFrame:
    return read_timeline(spark, root, "connections", runs)


def read_gpu_engine(spark, root, runs=None) -> DataFrame:
    return read_timeline(spark, root, "gpu_engine", runs)


def read_gpu_process(spark, root, runs=None) -> DataFrame:
    return read_timeline(spark, root, "gpu_process", runs)


def read_gpu_adapter(spark, root, runs=None) -> DataFrame:
    return read_timeline(spark, root, "gpu_adapter", runs)


def _run_documents(spark, root, name, schema, runs) -> DataFrame:
    runs = read_runs(spark, root) if runs is None else runs
    docs = _documents(spark, f"{root}/*/{name}", schema)
    return runs.select("run_folder", "run_id").join(docs, "run_folder").drop("run_folder")


def read_process_events(spark, root, runs=None) -> DataFrame:
    return _run_documents(spark, root, "process_events*.json", PROCESS_EVENT, runs).drop("file_name")


def read_service_events(spark, root, runs=None) -> DataFrame:
    return _run_documents(spark, root, "service_events*.json", SERVICE_EVENT, runs).drop("file_name")


def read_event_log(spark, root, runs=None) -> DataFrame:
    """One row per event of each run's log, in log order (``row_ord``)."""
    d = _run_documents(spark, root, "event_log*.json", EVENT_LOG, runs)
    d = d.select("run_id", F.posexplode("events").alias("row_ord", "e"))
    return d.select("run_id", F.col("row_ord").cast("bigint").alias("row_ord"), "e.*")


def _snapshots(spark, root, what, schema, runs) -> DataFrame:
    d = _run_documents(spark, root, f"{what}_*snapshot.json", schema, runs)
    order = F.when(F.col("file_name").contains("_start_"), 0).otherwise(1)
    return d.withColumn("snapshot_ord", order.cast("bigint")).drop("file_name")


def read_process_snapshots(spark, root, runs=None) -> DataFrame:
    """Process lists of a run; ``snapshot_ord`` 0 is the one at the start."""
    return _snapshots(spark, root, "process", PROCESS_SNAPSHOT, runs)


def read_service_snapshots(spark, root, runs=None) -> DataFrame:
    return _snapshots(spark, root, "service", SERVICE_SNAPSHOT, runs)


def read_inventory(spark, root, runs=None) -> tuple[DataFrame, DataFrame]:
    """(antivirus products, adapter names) of each run's inventory document."""
    d = _run_documents(spark, root, "static_snapshot.json", INVENTORY, runs)
    products = d.select("run_id", F.explode("security.antivirus_products").alias("p"))
    products = products.select("run_id", F.col("p.displayName").alias("product"))
    names = F.concat(
        F.coalesce(F.transform("network.adapters_wmi", lambda a: a["Name"]), F.array().cast("array<string>")),
        F.coalesce(F.transform("network.adapters_psutil", lambda a: a["name"]), F.array().cast("array<string>")),
    )
    adapters = d.select("run_id", F.explode(names).alias("name")).filter("name is not null")
    return products, adapters


def read_all(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables of the runs under ``root``, named as `Analysis` expects them."""
    runs = read_runs(spark, root)
    tables = {kind: read_timeline(spark, root, kind, runs) for kind in TIMELINES}
    antivirus, adapters = read_inventory(spark, root, runs)
    return {
        **tables, "runs": runs, "antivirus": antivirus, "adapters": adapters,
        "process_events": read_process_events(spark, root, runs),
        "service_events": read_service_events(spark, root, runs),
        "event_log": read_event_log(spark, root, runs),
    }
