"""Files of run folders as a Spark data source: timelines with their exact line order, and documents.

``run_timeline`` reads ``<root>/<run>/<timeline>.csv``, or the files ``<timeline>_<number>.csv`` of several flushes, of folders
that hold a manifest. Large files are cut into blocks. A row's ``row_ord`` is the place of its line: the bytes of the
run's earlier files plus the bytes before the line, so it is exact however files are cut into blocks.
``run_document`` writes rows (run_folder, file, text) as files; they get their names when the whole job has succeeded.
Lines end at line breaks, also inside quotes; a missing column is null, as is an empty value without quotes.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..schemas import FILES, TIMELINES

BLOCK = 32 << 20
MANIFEST_FILE = "manifest.json"


def open_root(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


@dataclass
class Blocks(InputPartition):
    """Parts of files that one task reads: path, run folder, first byte, byte after the last, bytes of earlier files."""

    parts: list[tuple[str, str, int, int, int]]


class TimelineReader(DataSourceReader):
    def __init__(self, root: str, columns: list[str], pattern: str, block: int):
        self.root, self.columns, self.pattern, self.block = root, columns, pattern, block

    def partitions(self) -> list[Blocks]:
        from pyarrow import fs

        system, inner = open_root(self.root)
        found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
        files = [(*f.path.rsplit("/", 2)[-2:], f) for f in found if f.type == fs.FileType.File]
        runs = {folder for folder, name, _ in files if name == MANIFEST_FILE}
        wanted = sorted((folder, name, f.path, f.size) for folder, name, f in files if folder in runs and re.fullmatch(self.pattern, name))
        out, group, weight, before, last = [], [], 0, 0, None
        for folder, _, path, size in wanted:
            before = before if folder == last else 0
            last = folder
            for at in range(0, size, self.block):
                group.append((path, folder, at, min(at + self.block, size), before))
                weight += min(self.block, size - at)
                if weight >= self.block:
                    out.append(Blocks(group))
                    group, weight = [], 0
            before += size
        return [*out, Blocks(group)] if group else out or [Blocks([])]

    def read(self, partition: Blocks) -> Iterator:
        import pyarrow as pa

        system, _ = open_root(self.root)
        kinds = [pa.string(), pa.int64(), *[pa.string()] * len(self.columns)]
        for path, folder, first, end, before in partition.parts:
            with system.open_input_file(path) as file:
                header, data, starts = lines(file, first, end)
            if not len(starts):
                continue
            table = parsed(header, data, len(starts))
            columns = [table[c].combine_chunks() if c in table.column_names else pa.nulls(len(starts), pa.string()) for c in self.columns]
            own = [pa.array([folder] * len(starts), pa.string()), pa.array(starts + before), *columns]
            whole = pa.Table.from_arrays([c.cast(k) for c, k in zip(own, kinds, strict=True)], names=["run_folder", "row_ord", *self.columns])
            yield from whole.to_batches(max_chunksize=10_000)


def lines(file, first: int, end: int):
    """The header, the bytes of the lines that begin in a block, and where each of them begins in the file."""
    import numpy as np

    file.seek(0)
    header = b""
    while b"\n" not in header and (more := file.read(1 << 16)):
        header += more
    header = header.partition(b"\n")[0] + b"\n"
    begin = max(first, len(header))
    file.seek(begin - 1)
    data = file.read(max(0, end - begin + 1))
    while data and not data.endswith(b"\n") and (more := file.read(1 << 16)):
        head, found, _ = more.partition(b"\n")
        data += head + found
    skipped = data.find(b"\n") + 1  # the line that began before the block
    if not skipped:
        return header, b"", np.zeros(0, np.int64)
    data = data[skipped:]
    marks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    starts = np.concatenate([[0], marks + 1]).astype(np.int64)
    sizes = np.diff(np.concatenate([starts, [len(data)]]))
    blank = [n == 0 or data[a : a + n].strip(b"\r\n") == b"" for a, n in zip(starts, sizes, strict=True)]
    return header, data, starts[~np.array(blank)] + begin - 1 + skipped


def parsed(header: bytes, data: bytes, n: int):
    """Lines as a table of text columns. Lines with too few or too many values are read as far as they go."""
    import csv

    import pyarrow as pa
    from pyarrow import csv as arrow

    names = next(csv.reader([header.decode("utf-8-sig").rstrip("\r\n")]))
    convert = arrow.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False)
    try:
        table = arrow.read_csv(io.BytesIO(data), read_options=arrow.ReadOptions(column_names=names), convert_options=convert)
        if table.num_rows == n:
            return table
    except pa.ArrowInvalid:
        pass
    texts = [line.rstrip("\r") for line in data.decode(errors="replace").split("\n")]
    rows = [next(csv.reader([t], quoting=csv.QUOTE_NOTNULL)) for t in texts if t]  # no quotes and no value: null
    rows = [r[: len(names)] + [None] * (len(names) - len(r)) for r in rows]
    return pa.table([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)


class RunTimeline(DataSource):
    """Options: path, table (a key of `TIMELINES`), block (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "run_timeline"

    def schema(self) -> StructType:
        columns = [StructField(c, StringType()) for c in TIMELINES[self.options["table"]]]
        return StructType([StructField("run_folder", StringType()), StructField("row_ord", LongType()), *columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        table = self.options["table"]
        pattern = re.escape(FILES[table].removesuffix(".csv")) + r"(_[0-9]+)?\.csv"
        return TimelineReader(self.options["path"], list(TIMELINES[table]), pattern, int(self.options.get("block", BLOCK)))


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class DocumentWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.staging = root, f".writing-{uuid.uuid4().hex}"

    def write(self, iterator) -> Staged:
        system, inner = open_root(self.root)
        system.create_dir(f"{inner}/{self.staging}", recursive=True)
        done = []
        for row in iterator:
            path = f"{inner}/{self.staging}/{uuid.uuid4().hex}"
            with system.open_output_stream(path, compression=None) as out:
                out.write((row["text"] or "").encode())
            done.append((path, f"{inner}/{row['run_folder']}/{row['file']}"))
        return Staged(done)

    def commit(self, messages) -> None:
        system, inner = open_root(self.root)
        for message in messages:
            for staged, final in message.files if message else ():
                system.create_dir(final.rpartition("/")[0], recursive=True)
                system.move(staged, final)
        self._tidy(system, inner)

    def abort(self, messages) -> None:
        self._tidy(*open_root(self.root))

    def _tidy(self, system, inner) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{inner}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.staging}")


class RunDocument(DataSource):
    """Option: path."""

    @classmethod
    def name(cls) -> str:
        return "run_document"

    def schema(self) -> str:
        return "run_folder string, file string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    for source in (RunTimeline, RunDocument):
        spark.dataSource.register(source)
    return spark
