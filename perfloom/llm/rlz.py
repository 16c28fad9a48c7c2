"""Passages that occurred earlier in a corpus, by relative Lempel-Ziv parsing against indexed reference blocks.

A text is a sequence of words; a window is `WINDOW` consecutive words. A word is repeated if a window over it also
starts earlier, in an earlier text or further up in the same one. Texts are in order of doc_id.

1. Of texts that are alike as a whole (128 bits of SHA-256) the first is parsed; each later one is one factor.
2. Windows are anchored at the least hash of their grams of `GRAM` words. One pass cuts every text into runs of window
   starts with the same anchor. Anchors that occur once have no earlier window; their runs end here.
3. The words of the other runs go to reference blocks by anchor, so each text is factored against every block that
   indexes one of its windows, and equal windows meet in one block. A block takes its pieces in order of
   the corpus. It looks a piece's next window up in its index, follows the reference word by word to the longest factor,
   and goes on at the first window that crosses the factor's end, as that one may have another source. A window without
   a source is new and is added to the index. Words are compared by their bytes.
4. Anchors of more than `CROWD` runs (words that many texts share, in ever different surroundings) would make one block
   without bound. Their windows are single entries, told by 128 bits of SHA-256 and reduced before the shuffle
   to the first place of each. A text's windows of such runs are repeated but for its first places, so
   no join by window is needed, and no group of equal windows meets in one task.
5. Factors of a text are joined where they touch or overlap.

Cases: null texts have no words; texts shorter than a window have no repeated word, even if they are alike; null doc_ids
come after others; different texts with equal doc_ids are documents of their own, in order of their digests; rows that
repeat doc_id and text are one document and get equal results; an empty table gives no rows; texts above
`SLICE` bytes are anchored in slices. Extra columns are kept in `row`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

WINDOW = 20
GRAM = 6
BLOCK = 1 << 20
CROWD = 2048
SLICE = 1 << 20
SENT = 500_000  # repeated texts (about 30 MB) that a broadcast may have
REMEMBERED, LONGEST = 300_000, 48  # hashes of words kept by a task, and the longest word among them
RUN = "key binary, doc long, gram long, first int, last int"
PIECE = "gram long, doc long, key binary, first int, words binary"
SPANS = "array<struct<start:int,end:int>>"


def words_of(text: Column) -> Column:
    """The words between ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def kept_words(words: Column, spans: Column) -> Column:
    """Words outside the spans."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(words)))
    return F.when(F.size(spans) == 0, words).otherwise(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(words, a + 1, b - a))))


def repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`row`, the columns of ``docs`` (doc_id, text and any others), and `spans`, the ranges of its words that
    windows which also start earlier cover."""
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc"), text.alias("text"))
    keyed = keyed.withColumn("key", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    copies = keyed.filter("text is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("one")).filter("n > 1")
    copies = written(copies.withColumnRenamed("key", "copied").drop("n"))
    if copies.count() <= SENT:
        copies = F.broadcast(copies)  # its size is checked; beyond it the join shuffles
    marked = keyed.join(copies, F.col("key") == F.col("copied"), "left")
    first = F.col("copied").isNull() | F.col("one").eqNullSafe(F.col("doc"))
    narrow = marked.filter(first & F.col("text").isNotNull()).select("doc", "key", "text", F.col("copied").isNotNull().alias("again"))
    texts = narrow.filter(~F.col("again")).drop("again").unionByName(narrow.filter("again").drop("again").dropDuplicates(["key"]))
    spans = _joined(_factors(texts, window))
    parsed = marked.filter(first).join(spans.withColumnRenamed("key", "parsed").hint("merge"), F.col("key") == F.col("parsed"), "left")
    parsed = parsed.select("row", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    size = F.size(words_of(F.col("text")))
    whole = F.array(F.struct(F.lit(0).alias("start"), size.alias("end"))).cast(SPANS)
    later = marked.filter(~first).select("row", F.when(size >= window, whole).otherwise(F.array().cast(SPANS)).alias("spans"))
    return parsed.unionByName(later)


class Hashes(dict):
    """64-bit hashes of words; bounded, as it is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


def slices(data: bytes):
    """The words of a text in lists of about `SLICE` bytes."""
    if len(data) <= SLICE:
        yield data.split()
        return
    at, blank = 0, b" \t\n\r\x0b\x0c"
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and data[end] not in blank:
            end += 1
        yield data[at:end].split()
        at = end


def anchored(hashed, window: int):
    """Anchor, first and last start of the runs of windows over words with these hashes."""
    import numpy as np

    n = len(hashed) - GRAM + 1
    grams = hashed[:n].copy()
    for j in range(1, GRAM):
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(31)
        grams += hashed[j : j + n]
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(32)
    low = np.uint64((1 << 21) - 1)
    least = (grams & ~low) | np.arange(n, dtype=np.uint64)  # the leftmost of equal grams is the least
    width, reach = window - GRAM + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(hashed) - window + 1], least[width - reach :])
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:] - 1, len(least) - 1]
    return grams[(least[first] & low).astype(np.int64)].astype(np.int64), first, last


def _runs(texts: DataFrame, window: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        memory = Hashes()
        names = [c.split()[0] for c in RUN.split(", ")]

        def batch_of(found):
            keys, docs, grams, firsts, lasts = zip(*found, strict=True)
            sizes = np.array([len(g) for g in grams])
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            columns = [pa.array(keys, pa.binary()).take(at), pa.array(docs, pa.int64()).take(at), pa.array(np.concatenate(grams))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.concatenate(x).astype(np.int32)) for x in (firsts, lasts))], names)

        for batch in batches:
            found, size = [], 0
            for doc, key, text in zip(batch["doc"].to_pylist(), batch["key"].to_pylist(), batch["text"], strict=True):
                before, tail = 0, np.zeros(0, np.uint64)  # words before those at hand, and the last of them
                for words in slices(text.as_py().encode()):
                    hashed = np.concatenate([tail, np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))])
                    if len(hashed) >= window:
                        grams, first, last = anchored(hashed, window)
                        found.append((key, doc, grams, first + before, last + before))
                        size += len(grams)
                    tail = hashed[-(window - 1) :]
                    before += len(hashed) - len(tail)
                if size > 100_000:
                    yield batch_of(found)
                    found, size = [], 0
            if found:
                yield batch_of(found)

    return written(texts.select("doc", "key", "text").filter(F.octet_length("text") >= 2 * window - 1).mapInArrow(run, RUN))


def _factors(texts: DataFrame, window: int) -> DataFrame:
    """key, start and end of repeated stretches, not yet joined."""
    runs = _runs(texts, window)
    grams = written(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    chosen = runs.join(grams.hint("merge"), "gram")  # a plain join, so that Spark can split a crowded gram
    listed = chosen.groupBy("key").agg(F.collect_list(F.struct("gram", "first", "last", (F.col("n") > CROWD).alias("crowded"))).alias("runs"))
    listed = written(listed.withColumnRenamed("key", "of"))
    total = listed.agg(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + window))).first()[0] or 0
    cut = texts.join(listed.hint("merge"), F.col("key") == F.col("of")).select("doc", "key", "text", "runs")
    blocks = max(1, -(-total * 8 // BLOCK))  # eight bytes a word
    pieces = cut.mapInArrow(_pieces(window), PIECE).withColumn("block", F.pmod(F.xxhash64("gram"), F.lit(blocks)))
    found = written(pieces.groupBy("block").applyInPandas(_block(window), "key binary, start int, end int"))
    if grams.filter(F.col("n") > CROWD).isEmpty():
        return found
    single = cut.mapInArrow(_windows(window), "window binary, doc long, key binary, start int")
    place = F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "key", "start")).alias("place")
    firsts = single.groupBy("window").agg(place).groupBy(F.col("place.key").alias("at")).agg(F.collect_list("place.start").alias("firsts"))
    candidates = listed.select("of", F.filter("runs", lambda r: r["crowded"]).alias("runs")).filter(F.size("runs") > 0)
    later = candidates.join(written(firsts).hint("merge"), F.col("of") == F.col("at"), "left").select(F.col("of").alias("key"), "runs", "firsts")
    return found.unionByName(written(later.mapInArrow(_but_first(window), "key binary, start int, end int")))


def _batches(rows, kinds, names):
    """Arrow batches of bounded size from an iterator of tuples."""
    from itertools import islice

    import pyarrow as pa

    while part := list(islice(rows, 50_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names)


def _of(batches, crowded: bool):
    """key, doc, words and runs (gram, first, last) of each text that has runs whose anchors are ``crowded`` or not."""
    for batch in batches:
        for key, doc, text, runs in zip(batch["key"].to_pylist(), batch["doc"].to_pylist(), batch["text"], batch["runs"].to_pylist(), strict=True):
            if wanted := [(r["gram"], r["first"], r["last"]) for r in runs if r["crowded"] == crowded]:
                yield key, doc, text.as_py().encode().split(), wanted


def _pieces(window: int):
    def run(batches):
        import pyarrow as pa

        rows = ((gram, doc, key, first, b" ".join(words[first : last + window])) for key, doc, words, runs in _of(batches, False) for gram, first, last in runs)
        yield from _batches(rows, [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()], ["gram", "doc", "key", "first", "words"])

    return run


def _windows(window: int):
    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        rows = (
            (sha256(b" ".join(words[at : at + window])).digest()[:16], doc, key, at)
            for key, doc, words, runs in _of(batches, True) for _, first, last in runs for at in range(first, last + 1)
        )
        yield from _batches(rows, [pa.binary(), pa.int64(), pa.binary(), pa.int32()], ["window", "doc", "key", "start"])

    return run


def _but_first(window: int):
    def run(batches):
        import pyarrow as pa

        def spans():
            for batch in batches:
                for key, runs, firsts in zip(*(batch[c].to_pylist() for c in ("key", "runs", "firsts")), strict=True):
                    first = set(firsts or ())
                    for r in runs:
                        starts = [at for at in range(r["first"], r["last"] + 1) if at not in first]
                        for a, b in stretches(starts):
                            yield key, a, b + window

        yield from _batches(spans(), [pa.binary(), pa.int32(), pa.int32()], ["key", "start", "end"])

    return run


def stretches(starts: list[int]):
    """First and last of consecutive numbers."""
    at = 0
    for i in range(1, len(starts) + 1):
        if i == len(starts) or starts[i] != starts[i - 1] + 1:
            yield starts[at], starts[i - 1]
            at = i


def _block(window: int):
    def run(frame):
        import pandas as pd

        frame = frame.sort_values(["doc", "key", "first"], na_position="last")
        index = Reference(window)
        out = []
        for key, first, words in zip(frame["key"], frame["first"], frame["words"], strict=True):
            out.extend((key, first + a, first + b) for a, b in index.factors(words))
        return pd.DataFrame(out, columns=["key", "start", "end"]).astype({"start": "int32", "end": "int32"})

    return run


class Reference:
    """A block's reference: pieces of text and an index of the first place of each window in them."""

    def __init__(self, window: int):
        self.window = window
        self.places: dict[bytes, tuple[bytes, int]] = {}  # a window's piece and the byte after it there
        self.whole: dict[bytes, int] = {}

    def factors(self, piece: bytes) -> list[tuple[int, int]]:
        """Word ranges of a piece that have an earlier source, greedily the longest; its new windows are added."""
        window, places = self.window, self.places
        if piece in self.whole:
            return [(0, self.whole[piece])]
        begins, at = [0], piece.find(b" ")
        while at >= 0:
            begins.append(at + 1)
            at = piece.find(b" ", at + 1)
        n = len(begins)
        self.whole[piece] = n
        begins.append(len(piece) + 1)
        found = []
        i = 0
        while i + window <= n:
            end = begins[i + window] - 1
            source = places.get(content := piece[begins[i] : end])
            if source is None:
                places[content] = (piece, end)
                i += 1
                continue
            words, (reference, there) = i + window, source
            while words < n and reference[there : there + 1] == b" ":
                word = piece[begins[words] - 1 : begins[words + 1] - 1]  # with the blank before it
                stop = there + len(word)
                if reference[there:stop] != word or reference[stop : stop + 1] not in (b" ", b""):
                    break
                words, there = words + 1, stop
            found.append((i, words))
            i = words - window + 1  # the first window that crosses the factor's end
        return found


def _joined(found: DataFrame) -> DataFrame:
    """key and spans of each text with factors."""

    def join(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for listed in batch["spans"].to_pylist():
                spans: list[dict] = []
                for s in sorted(listed, key=lambda s: s["start"]):
                    if spans and s["start"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], s["end"])
                    else:
                        spans.append(s)
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(out, kind)], ["key", "spans"])

    listed = found.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return written(listed.mapInArrow(join, f"key binary, spans {SPANS}"))
