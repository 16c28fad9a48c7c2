"""WARC archives compressed record by record with a shared Zstandard dictionary, and their reader.

The dictionary is built from archived payloads: ``SAMPLES`` records at most, of ``SAMPLE_BYTES`` at
most, chosen by a hash of the page id. Every file starts with a skippable frame that holds it, then has
one Zstandard frame per record, so a file can be read alone. Payloads that occur again are revisit
records without payload.

Which rows are copies is decided on (id, digest, size) alone: the least id of each digest that
occurs twice is joined back by digest, so a digest with very many rows is pre-aggregated and its rows are
split by the join. A task holds one batch of pages.

Cases: a null html is an empty payload; a null url leaves its header out; control characters in a url
are percent-encoded; a null page_id is always a response and is never referred to; rows that repeat the
least page_id of their payload are responses each; an empty table writes no file. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

SAMPLES = 512
SAMPLE_BYTES = 32 * 1024
DICTIONARY_BYTES = 64 * 1024
REVISIT_FROM = 100
LEVEL = 3
SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")  # fixed value: the frame type of embedded dictionaries
PAGE_URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
MANIFEST = "shard long, file string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, and the id of the response of the same payload for revisits."""
    payload: Column = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    again = F.col("size") >= REVISIT_FROM
    firsts = rows.filter(again & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.filter("n > 1").drop("n")
    marked = rows.join(firsts, "digest", "left")
    later = again & F.col("page_id").isNotNull() & (F.col("page_id") > F.col("first"))
    return marked.select("page_id", "url", "payload", "digest", F.when(later, F.col("first")).alias("refers_to"))


def build_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of the payloads; empty if there is too little to learn from.

    The share of the payloads whose hash is low enough for the sample follows from their number, so that tasks send
    few rows to the driver, however many tasks there are.
    """
    import zstandard

    html = F.col("html").cast("string")
    size = F.octet_length(html)
    rows = pages.filter((size > 0) & (size <= SAMPLE_BYTES)).select(html.alias("html"), F.xxhash64("page_id", html).alias("draw"))
    share = 0.75 * SAMPLES / max(1, rows.count())  # beyond `SAMPLES` of them by more than six deviations
    drawn = rows.filter(F.pmod("draw", F.lit(1 << 40)) < F.lit(int(min(1.0, share) * (1 << 40)))).dropDuplicates(["draw"])
    sample = [r.html.encode() for r in drawn.orderBy("draw").limit(SAMPLES).collect()]  # bounded: 16 MB
    if sum(map(len, sample)) < 1024:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:  # too few samples: their text itself is the dictionary
        return b"".join(sample)[-DICTIONARY_BYTES:]


def record(row: dict, date: str) -> bytes:
    """One WARC record; the HTTP header of a revisit still tells its payload's size."""
    payload, first = row["payload"], row["refers_to"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{PAGE_URN}{'' if row['page_id'] is None else row['page_id']}>", f"WARC-Date: {date}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in row["url"]))
    if first is not None:
        head += [f"WARC-Refers-To: <{PAGE_URN}{first}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{row['digest']}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write all pages; the manifest of the files. ``date`` is the capture time all records carry."""
    folder = folder or storage.new_folder(pages.sparkSession, "warc")
    words = build_dictionary(pages)

    def archive(batches):
        import pyarrow as pa
        import zstandard

        dictionary = zstandard.ZstdCompressionDict(words) if words else None
        if dictionary:
            dictionary.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
        out, name, count, size = None, storage.attempt_name(".warc.zst"), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                data = b"".join(packer.compress(record(row, date)) for row in batch.slice(at, 256).to_pylist())
                if out is None:
                    out = storage.open_output(f"{folder}/{name}")
                    if words:
                        data = SKIPPABLE + len(words).to_bytes(4, "little") + words + data
                out.write(data)
                size += len(data)
            count += batch.num_rows
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": storage.partition_number(), "file": f"{folder}/{name}", "records": count, "bytes": size}])

    return storage.written(mark_revisits(pages).mapInArrow(archive, MANIFEST))


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives, as its headers and its block tell it."""

    def records(batches):
        import pyarrow as pa

        types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema(list(types.items()))
        for batch in batches:
            for file in batch.column("file").to_pylist():
                held, weight = [], 0
                for row in parse(file):
                    held.append(row)
                    weight += len(row["payload"])
                    if weight > 1 << 23 or len(held) == 1024:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return manifest.repartition(max(1, manifest.count())).mapInArrow(records, RECORD)


def parse(file: str):
    """The records of one archive file."""
    import io

    import zstandard

    with storage.open_input(file) as source:
        dictionary, start = None, source.read(8)
        if start[:4] == SKIPPABLE:
            dictionary = zstandard.ZstdCompressionDict(source.read(int.from_bytes(start[4:], "little")))
        else:
            source.seek(0)
        stream = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True)
        text = io.BufferedReader(stream, 1 << 17)
        while text.readline().startswith(b"WARC/"):
            head = headers(text)
            block = text.read(int(head["content-length"]))
            text.read(4)
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(headers(io.BytesIO(http.partition(b"\r\n")[2]))["content-length"])
            kind = head["warc-type"]
            yield {
                "page_id": page_of(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": kind,
                "refers_to": page_of(head.get("warc-refers-to", "")), "payload_digest": head["warc-payload-digest"].removeprefix("sha256:"),
                "payload_bytes": size, "payload": payload,
            }


def headers(text) -> dict[str, str]:
    found = {}
    while line := text.readline().rstrip(b"\r\n"):
        name, _, value = line.decode().partition(": ")
        found[name.lower()] = value
    return found


def page_of(uri: str) -> int | None:
    number = uri.strip("<>").removeprefix(PAGE_URN)
    return int(number) if number else None
