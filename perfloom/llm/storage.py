"""Files that tasks write themselves: a fresh shared folder per output, and a commit by manifest.

Every task attempt writes under a name of its own and returns a manifest row when its file is
closed. The manifest is then written as Parquet, so it holds exactly the files of the attempts that
Spark accepted; files of failed or repeated attempts are never read.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.session import scratch_folder, written

__all__ = ["free_names", "worker_memory", "new_folder", "open_output", "open_input", "attempt_name", "written"]


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder name in the shared scratch place that no other job uses."""
    return f"{scratch_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have, for an operator's own columns beside those of its caller."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


_HELD: dict = {}


def worker_memory(name, make):
    """What a Python worker remembers from task to task under ``name``. A worker holds one thing at a time: what
    another operator left in it is given back first, so that memories do not add up over the stages of a job."""
    if name not in _HELD:
        _HELD.clear()
        gc.collect()
        with contextlib.suppress(ImportError):
            import pyarrow

            pyarrow.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # gives free pages back where the C library can
            ctypes.CDLL(None).malloc_trim(0)
        _HELD[name] = make()
    return _HELD[name]


def attempt_name(suffix: str) -> str:
    """A file name of this task attempt alone."""
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    return f"part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def partition_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_output(path: str):
    """A stream to a new file; ``path`` is any location the cluster's tasks reach."""
    system, inner = _file_system(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def open_input(path: str):
    """A seekable file."""
    system, inner = _file_system(path)
    return system.open_input_file(inner)


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
