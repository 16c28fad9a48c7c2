"""Tables of many runs in few files, with a manifest that says which file holds which run.

A write sorts its rows by run, so a file holds whole ranges of runs however many there are, and adds one version
of the manifest: the runs it brought point to its files, all others stay where they were. A run that is written again
replaces its rows alone; rows of the old file that no version points to any more are not read. Readers see the newest
version whose write has ended.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import written

ENTRY = "run_id string, batch string, file string, row_count bigint"


def manifest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The newest version's number (0: none) and its entries: run, batch, file and rows."""
    try:
        entries = spark.read.schema(f"{ENTRY}, version int").parquet(f"{path}/manifest")
        newest = entries.agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, spark.createDataFrame([], ENTRY)
    return newest, entries.filter(F.col("version") == newest).drop("version")


def put(df: DataFrame, path: str, order: tuple[str, ...] = (), runs: DataFrame | None = None) -> None:
    """Write ``df`` (run_id and any columns); its runs replace those of the same name.

    ``runs`` (run_id) names further runs that were done again: those without a row in ``df`` end up with none.
    """
    spark, batch = df.sparkSession, uuid.uuid4().hex
    keys = ["run_id", *[c for c in order if c in df.columns]]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{path}/data/{batch}")
    own = spark.read.schema(df.schema).parquet(f"{path}/data/{batch}").groupBy("run_id", F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("row_count"))
    own = written(own.select("run_id", F.lit(batch).alias("batch"), "file", "row_count"))
    version, before = manifest(spark, path)
    new = own.select("run_id") if runs is None else own.select("run_id").unionByName(runs.select("run_id"))
    stay = before.join(new.distinct(), "run_id", "left_anti").select(*own.columns)
    stay.unionByName(own).coalesce(1).write.parquet(f"{path}/manifest/version={version + 1}")


def get(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the newest version."""
    _, entries = manifest(spark, path)
    batches = [r.batch for r in entries.select("batch").distinct().collect()]  # a row per write that still holds a run
    if not batches:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{path}/data/{b}" for b in batches]).withColumn("_file", F.col("_metadata.file_name"))
    listed = entries.select(F.col("run_id").alias("_run"), F.col("file").alias("_held"))
    return rows.join(listed, rows["run_id"].eqNullSafe(F.col("_run")) & (F.col("_file") == F.col("_held")), "left_semi").drop("_file")


def put_findings(findings: dict[str, DataFrame], scores: DataFrame, inputs: DataFrame, runs: DataFrame, path: str) -> None:
    """Every family of findings, the scores and what they were made of; all ``runs`` are replaced in each of them."""
    for family, df in {**findings, "scores": scores, "score_inputs": inputs}.items():
        put(df, f"{path}/{family}", runs=runs)
