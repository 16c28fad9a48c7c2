"""Token ids as length-delimited binary records with an offset index, and their readers.

A record file is a sequence of frames: length (8 bytes), masked checksum of the length (4), the
serialized sequence, masked checksum of it (4), little-endian. The checksum is CRC-32 rotated and
shifted by a constant, so that a checksum of stored checksums is not degenerate. A serialized sequence
is a flag (1 byte: has an id), the width of a token id (1), the document id (8) and the token ids (2 or 4 each). The index file holds
offset and size (8 bytes each) of every frame, so a reader can fetch frames in any order.

Rows are dealt by ranges of (doc_id, hash of the text), so files are in ascending doc_id order,
and one task holds one batch at a time. Cases: a null text is an empty sequence with the end id; a
null doc_id sorts first and stays null; repeated rows are repeated records; an empty table writes no
file. Extra columns are ignored. A frame that fails its checksum raises ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import storage
from .text_ids import text_ids

MASK_DELTA = 0xA282EAD8  # fixed value of the record format
HEADER, TRAILER, OWNER, ENTRY = "<QI", "<I", "<?Bq", "<QQ"
HEADER_SIZE, TRAILER_SIZE, OWNER_SIZE = map(struct.calcsize, (HEADER, TRAILER, OWNER))
MANIFEST = "shard long, file string, offsets string, records long, ids long"
RECORD = "shard long, ordinal long, doc_id long, before long, ids binary"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def framed(data: bytes) -> bytes:
    size = len(data).to_bytes(8, "little")
    return b"".join((size, struct.pack(TRAILER, masked(size)), data, struct.pack(TRAILER, masked(data))))


def unframed(frame: bytes) -> bytes:
    """The data of one whole frame."""
    size, check = struct.unpack_from(HEADER, frame)
    data = frame[HEADER_SIZE : HEADER_SIZE + size]
    if masked(frame[:8]) != check or len(data) != size or masked(data) != struct.unpack_from(TRAILER, frame, HEADER_SIZE + size)[0]:
        raise ValueError("a record does not match its checksum")
    return data


def write_records(docs: DataFrame, vocabulary: str, end: int, keeps_blanks: bool = True, folder: str | None = None, width: int = 2) -> DataFrame:
    """Write the ids of every text in ascending doc_id order; the manifest of the files.

    ``width``: bytes of an id in the files, 2 for vocabularies of at most 65,536 ids, else 4.
    """
    folder = folder or storage.new_folder(docs.sparkSession, "records")

    def shard(batches):
        import pyarrow as pa

        encoder = text_ids(vocabulary, keeps_blanks, end, width)
        out, name = None, storage.attempt_name("")
        entries, at, ids = [], 0, 0
        for batch in batches:
            for part, encoded in encoder.parts(batch):
                frames = []
                for doc, tokens in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    frames.append(framed(struct.pack(OWNER, doc is not None, width, doc or 0) + tokens))
                    entries.append(struct.pack(ENTRY, at, len(frames[-1])))
                    at += len(frames[-1])
                    ids += len(tokens) // width
                out = out or storage.open_output(f"{folder}/{name}.rec")
                out.write(b"".join(frames))
        if out:
            out.close()
            with storage.open_output(f"{folder}/{name}.idx") as index:
                index.write(b"".join(entries))
            row = {"shard": storage.partition_number(), "file": f"{folder}/{name}.rec", "offsets": f"{folder}/{name}.idx", "records": len(entries), "ids": ids}
            yield pa.RecordBatch.from_pylist([row])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return storage.written(ordered.mapInArrow(shard, MANIFEST))


def read_records(manifest: DataFrame) -> DataFrame:
    """All records in file order; ``before``: ids of all records before this one."""
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("base", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))
    return files.repartition(max(1, manifest.count())).mapInArrow(_whole_files, RECORD)


def _whole_files(batches):
    storage.worker_memory("records", dict)  # the words that a worker remembers for writing are given back
    for batch in batches:
        for row in batch.to_pylist():
            yield from _batches(_frames(row))


def _frames(row: dict):
    before = row["base"]
    with storage.open_input(row["file"]) as source:
        for ordinal in range(row["records"]):
            head = source.read(HEADER_SIZE)
            data = unframed(head + source.read(struct.unpack(HEADER, head)[0] + TRAILER_SIZE))
            yield _record(row["shard"], ordinal, before, data)
            before += (len(data) - OWNER_SIZE) // data[1]


def read_shuffled(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """All records in a random order that ``seed`` fixes, fetched through the offset index.

    ``before`` is null: a record met out of order does not know what precedes it.
    """
    def entries(batches):
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                with storage.open_input(row.offsets) as index:
                    at = list(struct.iter_unpack(ENTRY, index.read()))
                yield pd.DataFrame({"shard": row.shard, "file": row.file, "ordinal": range(len(at)), "at": [x for x, _ in at], "size": [n for _, n in at]})

    def fetch(batches):
        storage.worker_memory("records", dict)
        for batch in batches:
            sources: dict = {}
            found = []
            for row in batch.to_pylist():
                source = sources.get(row["file"]) or sources.setdefault(row["file"], storage.open_input(row["file"]))
                source.seek(row["at"])
                found.append(_record(row["shard"], row["ordinal"], None, unframed(source.read(row["size"]))))
            for source in sources.values():
                source.close()
            yield from _batches(found)

    spread = manifest.repartition(max(1, manifest.count())).mapInPandas(entries, "shard long, file string, ordinal long, at long, size long")
    drawn = spread.withColumn("_draw", F.xxhash64(F.lit(seed), "shard", "ordinal"))
    return drawn.repartitionByRange("_draw", "shard", "ordinal").sortWithinPartitions("_draw", "shard", "ordinal").drop("_draw").mapInArrow(fetch, RECORD)


def _record(shard: int, ordinal: int, before: int | None, data: bytes) -> dict:
    has, width, doc = struct.unpack_from(OWNER, data)
    ids = data[OWNER_SIZE:]
    return {"shard": shard, "ordinal": ordinal, "doc_id": doc if has else None, "before": before, "ids": array("I", array("H", ids)).tobytes() if width == 2 else ids}


def _batches(rows, size: int = 1024):
    import pyarrow as pa

    schema = pa.schema([("shard", pa.int64()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("ids", pa.binary())])
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row["ids"])
        if len(held) == size or weight > 1 << 24:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
