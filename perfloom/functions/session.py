"""Session settings and intermediate tables."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="perfloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_JOB: contextvars.ContextVar[str | None] = contextvars.ContextVar("perfloom_job", default=None)


@contextlib.contextmanager
def scratch_job(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for the tables that are `written` inside the block; `removed` when nothing reads them any more."""
    folder = f"{scratch_folder(spark)}/perfloom-{uuid.uuid4().hex}"
    token = _JOB.set(folder)
    try:
        yield folder
    finally:
        _JOB.reset(token)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of `scratch_job`, in whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the scratch folder: computed once, safe against lost executors.

    Readers prune its columns, and its file sizes tell the optimizer what may be broadcast.
    """
    path = f"{_JOB.get() or scratch_folder(df.sparkSession)}/perfloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
