"""Live variants: timelines as they are flushed, and operators that look back across batches.

Operators that need earlier rows (rates, snapshot diffs, candidates) keep a state per run (`keyed`); what they do with a
row and the values before it is the batch operator's own expression, so a stream gives the batch result.

Batches may split a tick, snapshot or window, and rows may come late. A run's rows are held back until one
has come that is newer by more than ``lateness``, or, in a query that goes on, until no row of the run has come for ``idle``
seconds: a timer then releases what an ended run has left. Released rows are written as ``batch=<id>``, once and for
good. A query that ends with its input (``once``) has no timers; it also writes what is still held back, as
``batch=open``, which the next batch replaces. Rows that come after their results were written, and rows without a
moment, are no part of any result; they are kept under ``_late``.

A checkpoint belongs to one kind of query, with or without timers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.coerce import zero_if_null
from ..functions.naming import app_key
from ..operators import derive
from ..schemas import FILES, TIMELINES
from ..sources.run_folders import coerce_timeline
from . import keyed

#: State is kept incrementally on disk and in the checkpoint, so a batch writes only what it changed.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE, FORGET, EVERY = 60.0, 30 * 86400.0, "1 second"
_FOLDER = r"([^/]+)/[^/]+$"


def stream_timelines(spark: SparkSession, root: str, kind: str, files_per_trigger: int | None = None) -> DataFrame:
    """Timeline rows from ``root/<run>/<timeline>*.csv``; every flush must be a finished file.

    The folder name serves as ``run_id``.
    """
    schema = ", ".join(f"`{c}` string" for c in TIMELINES[kind])
    reader = spark.readStream.schema(schema).option("header", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.csv(f"{root}/*/{FILES[kind].removesuffix('.csv')}*.csv")
    raw = raw.select(F.regexp_extract("_metadata.file_path", _FOLDER, 1).alias("run_id"), "*")
    return coerce_timeline(raw, kind)


def append_timelines(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").partitionBy("run_id").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _keyed(
    rows: DataFrame,
    held: type[keyed.Held],
    finish: Callable[[DataFrame], DataFrame],
    at: str,
    state: str,
    path: str,
    checkpoint: str,
    once: bool,
    lateness: float,
    idle: float,
    forget: float,
    **own,
) -> StreamingQuery:
    """``held`` decides per run when rows are final and adds the values before them; ``finish`` makes results of them."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    processor = held(rows.schema, at, lateness, None if once else idle, forget, **own)
    found = rows.groupBy("run_id").transformWithState(processor, processor.shape, "Append", "None" if once else "ProcessingTime")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            of = lambda kind: batch.filter(F.col(keyed.KIND) == kind)
            finish(of(keyed.FINAL)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            of(keyed.LATE).select(*rows.columns).write.mode("overwrite").parquet(f"{path}/_late/{batch_id}")
            if once:
                still = of(keyed.OPEN)
                if batch_id:
                    old = batch.sparkSession.read.schema(processor.shape).parquet(f"{state}/{batch_id - 1}")
                    still = old.join(of(keyed.SEEN).select("run_id"), "run_id", "left_anti").select(*old.columns).unionByName(still)
                still.write.mode("overwrite").parquet(f"{state}/{batch_id}")
                still = batch.sparkSession.read.schema(processor.shape).parquet(f"{state}/{batch_id}")
                finish(still).write.mode("overwrite").parquet(f"{path}/batch=open")
        finally:
            batch.unpersist()

    writer = found.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=EVERY)).start()


def stream_system_rates(
    rows, state, path, checkpoint, at: str = "mono", once: bool = True, lateness: float = 10, idle: float = IDLE, forget: float = FORGET
) -> StreamingQuery:
    finish = lambda d: derive.system_rates_after(d, rows.columns, at)
    return _keyed(rows, keyed.Samples, finish, at, state, path, checkpoint, once, lateness, idle, forget,
                  before=[at, *derive.system_counters(rows.columns)])


def stream_adapter_rates(
    rows, state, path, checkpoint, at: str = "mono", once: bool = True, lateness: float = 10, idle: float = IDLE, forget: float = FORGET
) -> StreamingQuery:
    finish = lambda d: derive.adapter_rates_after(d, rows.columns, at)
    return _keyed(rows, keyed.Adapters, finish, at, state, path, checkpoint, once, lateness, idle, forget,
                  entity="adapter", before=[c for c in derive.ADAPTER_RATES if c in rows.columns])


def stream_process_io_rates(
    rows, state, path, checkpoint, at: str = "mono", once: bool = True, lateness: float = 10, idle: float = IDLE, forget: float = FORGET
) -> StreamingQuery:
    finish = lambda d: derive.process_io_rates_after(d, rows.columns, at)
    return _keyed(rows, keyed.Processes, finish, at, state, path, checkpoint, once, lateness, idle, forget,
                  entity="pid", before=[c for c in ("read_bytes", "write_bytes") if c in rows.columns])


def stream_snapshot_diff(
    rows, state, path, checkpoint, services: bool = False, once: bool = True, lateness: int = 1, idle: float = IDLE, forget: float = FORGET
) -> StreamingQuery:
    """Process (or service) events; a snapshot is open until one newer by more than ``lateness`` snapshots has come, or no
    row of its run for ``idle`` seconds.

    A released snapshot goes to the batch operator together with the one before, whose own events are left out.
    """
    diff = derive.service_snapshot_diff if services else derive.process_snapshot_diff

    def finish(d: DataFrame) -> DataFrame:
        events = diff(d.select(*rows.columns))
        known = d.filter(F.col(keyed.EARLIER)).select("run_id", "snapshot_ord").distinct()
        return events.join(known, ["run_id", "snapshot_ord"], "left_anti").select(*events.columns)

    return _keyed(rows, keyed.Snapshots, finish, "snapshot_ord", state, path, checkpoint, once, lateness, idle, forget)


def stream_app_ticks(process: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Application totals per one-second window of the sample time (``timestamp``, epoch seconds)."""
    at = F.timestamp_micros((F.col("timestamp") * 1e6).cast("bigint"))
    d = process.filter(F.col("timestamp").isNotNull()).withColumn("at", at).withWatermark("at", lateness)
    return d.groupBy(F.window("at", "1 second"), "run_id", app_key("name").alias("app_key")).agg(
        F.sum(zero_if_null("cpu_pct")).alias("cpu_pct"),
        *[
            F.sum(F.coalesce(c, F.lit(0)).cast("double")).alias(c)
            for c in ("rss_bytes", "num_handles", "num_threads", "io_read_bps", "io_write_bps")
        ],
    ).withColumn("second", F.col("window.start").cast("double")).drop("window")


def refresh_candidates(process: DataFrame, n: int = 20, every: int = 10) -> DataFrame:
    """Candidate pids of each ``every``-second window, from the first tick in it."""
    d = process.withColumn("refresh", F.floor(F.col("rel_seconds") / every) * every)
    first = d.groupBy("run_id", "refresh").agg(F.min("rel_seconds").alias("rel_seconds"))
    d = d.join(first, ["run_id", "refresh", "rel_seconds"], "left_semi")
    return derive.candidate_processes(d, n, ("run_id", "refresh"))


def stream_candidates(
    process: DataFrame, path: str, checkpoint: str, n: int = 20, once: bool = True, every: int = 10, lateness: float = 10,
    idle: float = IDLE, forget: float = FORGET,
) -> StreamingQuery:
    """`refresh_candidates`; a window is open until one has come that begins later by more than ``lateness`` seconds, or no
    row of its run for ``idle`` seconds."""
    rows = process.withColumn("refresh", F.floor(F.col("rel_seconds") / every) * every)
    finish = lambda d: refresh_candidates(d.select(*process.columns), n, every)
    return _keyed(rows, keyed.Windows, finish, "refresh", f"{path}/_state", path, checkpoint, once, lateness, idle, forget)
