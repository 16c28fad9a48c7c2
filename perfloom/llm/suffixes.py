"""Passages that repeat anywhere in a corpus, by difference-cover suffix sorting.

Two equal windows of `WINDOW` bytes have the same content, so any function of the content deals suffixes to
buckets in which all equal windows meet. Here it is the least hash of the window's `GRAM`-byte grams.

1. Texts that occur as a whole more than once (told by 128 bits of SHA-256) are removed as
   a whole and sorted once. One pass cuts each other text into runs of window starts with the same least gram. Runs whose gram hash
   occurs once can hold no repeated window and end here.
2. The bytes of the other runs are dealt by gram hash to buckets of about `BUCKET` bytes, at most `CROWD` runs of a gram.
   Runs of a gram with more (a passage or phrase that many documents share) send no bytes. They are cut into `PARTS`
   pieces by the gram's place in the window, which is equal in equal windows too. All windows of a piece have all but a
   few bytes in common, so 128 bits of a hash of the common bytes and the few bytes around them tell windows apart.
   Pieces are counted by that hash before a shuffle; where the bytes around differ, windows are counted. No group meets
   in one task, whatever its size.
3. A bucket sorts its suffixes by the difference-cover algorithm: triples at two of three positions are sorted and
   named, the names are sorted recursively, the remaining suffixes follow from one symbol and the rank after it, and
   are merged in. Runs with equal bytes are sorted once and counted.
4. Neighbours in that order are compared over `WINDOW` bytes; what is equal is a repeated window.

Recursion ends when names span a window. Which windows are equal is decided by their bytes, for crowded grams by the
hash of the common bytes and the bytes around.

Cases: null texts are empty; texts shorter than a window have no repeated part; a null doc_id and rows
that repeat a doc_id are documents like others; rows that repeat both doc_id and text repeat each
other; an empty table gives no rows. Extra columns are kept in `row`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.session import removed, scratch_job
from .storage import worker_memory, written

WINDOW = 400
GRAM = 32
BUCKET = 1 << 19
CROWD = 2048
PARTS = 64
SLICE = 1 << 20
SENT = 500_000  # copied texts (about 20 MB) that a broadcast may have
RUN = "doc_id long, text_hash long, gram long, place long, first long, last long"
SPANS = "array<struct<start:bigint,end:bigint>>"


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`row`, the columns of ``docs`` (doc_id, text and any others), and `spans`, the maximal byte ranges of its text
    that repeated windows cover."""
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_doc"), text.alias("text"))
    keyed = keyed.withColumns({"_hash": F.xxhash64("text"), "_size": F.octet_length("text").cast("bigint")})
    keyed = keyed.withColumn("_whole", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    copies = written(
        keyed.filter(F.col("_size") >= window).groupBy("_whole")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("_doc").isNotNull().alias("some"), "_doc")).alias("one")).filter("n > 1")
        .select(F.col("_whole").alias("copied"), F.col("one._doc").alias("one"))
    )
    if copies.count() <= SENT:
        copies = F.broadcast(copies)  # its size is checked; beyond it the join shuffles
    keyed = keyed.join(copies, F.col("_whole") == F.col("copied"), "left").drop("_whole")
    whole = F.col("copied").isNotNull()
    single = keyed.filter(~whole | F.col("one").eqNullSafe(F.col("_doc")))  # one text of each kind
    with scratch_job(docs.sparkSession) as job:
        found = _repeats(single.select("_doc", "_hash", "text"), window)
    spans = _merged(found)
    removed(docs.sparkSession, job)  # runs, grams and pieces; the spans are written beside them
    out = _with(keyed, spans)
    all_of_it = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("_size").alias("end")))
    return out.select("row", F.when(whole, all_of_it).otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"))


def kept_bytes(text: Column, spans: Column) -> Column:
    """A text's bytes outside its spans."""
    data = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    end = F.octet_length(data).cast("bigint")
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(end))
    gaps = F.zip_with(starts, ends, lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(F.size(spans) == 0, data).otherwise(F.aggregate(gaps, F.lit(b""), lambda whole, part: F.concat(whole, part)))


def _with(keyed: DataFrame, found: DataFrame, kept: str = "") -> DataFrame:
    """``keyed`` with the columns found for its (doc_id, text_hash), only rows that have ``kept`` if it is given. Both sides are shuffled and sorted whatever
    their sizes, so that memory and disk behave alike on small and large corpora."""
    same = keyed["_doc"].eqNullSafe(found["doc_key"]) & (keyed["_hash"] == found["text_hash"])
    out = keyed.join(found.hint("merge"), same, "left").drop("doc_key", "text_hash", "count_of_spans")
    return out.filter(F.col(kept).isNotNull()) if kept else out


def gram_hashes(data):
    """Hash of the gram at every position."""
    import numpy as np

    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), np.uint64, data, 0, (1,))
    out = words[:n].copy()
    for at in range(8, GRAM, 8):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += words[at : at + n]
    for _ in range(2):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def least_grams(data, window: int):
    """For runs of window starts: hash and place of their windows' least gram, first and last start."""
    import numpy as np

    hashed = gram_hashes(data)
    width = window - GRAM + 1
    low = np.uint64(SLICE - 1)
    coded = (hashed & ~low) | np.arange(len(hashed), dtype=np.uint64)  # the leftmost of equal hashes is the least
    rows = -(-len(coded) // width)
    table = np.full(rows * width, ~np.uint64(0))
    table[: len(coded)] = coded
    table = table.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(coded) - width + 1
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:] - 1, n - 1]
    return (least[first] >> np.uint64(20)).astype(np.int64), (least[first] & low).astype(np.int64), first, last


def _runs(keyed: DataFrame, window: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        worker_memory("suffixes", dict)
        names = [x.split()[0] for x in RUN.split(", ")]
        step = SLICE - window
        for batch in batches:
            found, size = [], 0
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("_doc", "_hash", "text")), strict=True):
                whole = (text or "").encode()
                for at in range(0, max(1, len(whole) - window + 1), step):
                    part = whole[at : at + step + window - 1]
                    if len(part) < window:
                        continue
                    gram, place, first, last = least_grams(np.frombuffer(part, np.uint8), window)
                    found.append((pa.array([doc] * len(gram), pa.int64()), pa.array([key] * len(gram), pa.int64()), gram, place + at, first + at, last + at))
                    size += len(gram)
                if size > 50_000:
                    yield joined(found, names, pa, np)
                    found, size = [], 0
            if found:
                yield joined(found, names, pa, np)

    def joined(found, names, pa, np):
        ids, keys, *numbers = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(keys), *(pa.array(np.concatenate(x)) for x in numbers)], names)

    return written(keyed.select("_doc", "_hash", F.col("text").cast("string")).filter(F.octet_length("text") >= window).mapInArrow(run, RUN))


def _repeats(keyed: DataFrame, window: int) -> DataFrame:
    """doc_key, text_hash, start and end of repeated stretches, not yet merged."""
    runs = _runs(keyed, window)
    grams = written(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    chosen = runs.join(grams.hint("merge"), "gram")  # two plain shuffles, so that Spark can split a crowded gram
    found = written(_sorted_repeats(keyed, chosen.filter(F.col("n") <= CROWD), window))
    if not grams.filter(F.col("n") > CROWD).isEmpty():
        found = found.unionByName(written(_counted_repeats(written(_pieces(keyed, chosen.filter(F.col("n") > CROWD), window)), window)))
    return found


def _listed(chosen: DataFrame, shape: Column) -> DataFrame:
    listed = chosen.groupBy(F.col("doc_id").alias("doc_key"), "text_hash").agg(F.collect_set(shape).alias("runs"))
    return written(listed.withColumns({"node": F.monotonically_increasing_id(), "count_of_spans": F.size("runs")}))


def _pieces(keyed: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """Runs of crowded grams in pieces. A piece has the window starts from first to last; `common` is a hash of the
    bytes that its windows share, `left` and `right` are its bytes before and after those, `skipped` is how many bytes
    to the right the first window reaches."""
    width = window - GRAM + 1
    count = min(PARTS, width)
    bounds = [width * k // count for k in range(count + 1)]  # places of the gram in the window

    def cut(batches):
        from bisect import bisect_right
        from hashlib import blake2b

        import pandas as pd

        names = ["doc_key", "text_hash", "part", "common", "left", "right", "skipped", "first", "last"]
        for batch in batches:
            found = []
            for doc, key, runs, text in zip(batch["doc_key"], batch["text_hash"], batch["runs"], batch["text"], strict=True):
                whole = text.encode()
                doc = None if pd.isna(doc) else int(doc)
                for r in runs:
                    place = r["place"]
                    for k in range(bisect_right(bounds, place - r["last"]) - 1, bisect_right(bounds, place - r["first"])):
                        start, end = place - bounds[k], place - bounds[k + 1] + 1 + window  # of the common bytes
                        a, b = max(r["first"], end - window), min(r["last"], start)
                        common = blake2b(whole[start:end], digest_size=16).digest()
                        found.append((doc, key, k, common, whole[a:start], whole[end : b + window], a + window - end, a, b))
                if len(found) > 50_000:
                    yield framed(found, names, pd)
                    found = []
            if found:
                yield framed(found, names, pd)

    def framed(found, names, pd):
        return pd.DataFrame(found, columns=names).astype({"doc_key": "Int64"})

    listed = _listed(chosen, F.struct("place", "first", "last"))
    texts = _with(keyed, listed, kept="node").select(F.col("_doc").alias("doc_key"), F.col("_hash").alias("text_hash"), "runs", F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(cut, "doc_key long, text_hash long, part int, common binary, left binary, right binary, skipped int, first long, last long")


def _counted_repeats(pieces: DataFrame, window: int) -> DataFrame:
    """`_repeats` of `_pieces`. Equal pieces are counted in each task before the shuffle. What occurs twice is repeated as a
    whole; of pieces that occur once and share their common bytes with others, windows are counted."""
    group, piece = ["part", "common"], ["part", "common", "skipped", "left", "right"]
    own = [F.min(c).alias(c) for c in ("doc_key", "text_hash", "first", "last")]  # of the one row if there is one
    kinds = written(pieces.groupBy(*piece).agg(F.count(F.lit(1)).alias("n"), *own))
    place = ["doc_key", "text_hash", "first", "last"]
    alike = _but(pieces.select(*place), kinds.filter("n = 1").select(*place)).withColumnRenamed("first", "start")
    groups = written(kinds.groupBy(*group).agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").drop("kinds"))
    step, size = F.col("step"), F.octet_length("left")
    single = kinds.join(_sent(groups), group).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - F.col("first"))))
    reach = (F.col("skipped") + step).cast("int")
    around = F.concat(F.substring("left", (step + 1).cast("int"), size), F.substring("right", F.lit(1), reach))
    single = single.select("doc_key", "text_hash", "n", (F.col("first") + step).alias("start"), *group, reach.alias("reach"), around.alias("around"))
    same = [*group, "reach", "around"]
    place = ["doc_key", "text_hash", "start"]
    windows = single.groupBy(*same).agg(F.sum("n").alias("times"), *[F.min(c).alias(c) for c in place])
    one = _but(single.filter("n = 1").select(*place), windows.filter("times = 1").select(*place)).withColumn("last", F.col("start"))
    return alike.unionByName(one).withColumn("end", F.col("last") + window).drop("last")


def _but(rows: DataFrame, alone: DataFrame) -> DataFrame:
    """``rows`` but for those that are in ``alone``, each once. What occurs once has its place in the row that counts it, so
    all other places are of something that occurs again; no row is joined by what it has in common with many."""
    both = rows.withColumn("alone", F.lit(0)).unionByName(alone.withColumn("alone", F.lit(1)))
    return both.groupBy(*rows.columns).agg(F.max("alone").alias("alone")).filter("alone = 0").drop("alone")


def _sent(rows: DataFrame) -> DataFrame:
    """The smaller side of a join: sent to all tasks if it is small, else shuffled so that Spark can split a crowded key."""
    return F.broadcast(rows) if rows.count() <= SENT else rows.hint("merge")


def _sorted_repeats(keyed: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """`_repeats` of runs whose grams are not crowded, by sorting their bytes in buckets."""
    listed = _listed(chosen, F.struct("gram", "first", "last"))
    total = listed.agg(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + window))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))

    def cut(batches):
        import pandas as pd

        for batch in batches:
            found, size = [], 0
            for node, runs, text in zip(batch["node"], batch["runs"], batch["text"], strict=True):
                whole = text.encode()
                for r in runs:
                    found.append((r["gram"], node, r["first"], whole[r["first"] : r["last"] + window]))
                    size += len(found[-1][-1])
                if size > 1 << 22:
                    yield pd.DataFrame(found, columns=["gram", "node", "first", "data"])
                    found, size = [], 0
            if found:
                yield pd.DataFrame(found, columns=["gram", "node", "first", "data"])

    texts = _with(keyed, listed, kept="node").select("node", "runs", F.col("text").cast("string").alias("text"))
    pieces = texts.mapInPandas(cut, "gram long, node long, first long, data binary")
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))

    def bucket(frame):
        import numpy as np
        import pandas as pd

        different = {d: i for i, d in enumerate(dict.fromkeys(frame["data"]))}
        which = frame["data"].map(different).to_numpy()
        spans = repeated_in(list(different), np.bincount(which) > 1, window)
        node, first = frame["node"].to_numpy(), frame["first"].to_numpy()
        out = [(node[k], first[k] + a, first[k] + b) for k in range(len(frame)) for a, b in spans[which[k]]]
        return pd.DataFrame(out, columns=["node", "start", "end"], dtype=np.int64)

    found = dealt.groupBy("bucket").applyInPandas(bucket, "node long, start long, end long")
    return found.join(listed.select("node", "doc_key", "text_hash"), "node").drop("node")


def _merged(found: DataFrame) -> DataFrame:
    """doc_key, text_hash and the maximal spans of each text with repeats. Stretches are sorted and joined as rows, which
    spill; only maximal spans are listed."""
    text = W.partitionBy("doc_key", "text_hash")
    by_start = text.orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    rows = found.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("nth", F.sum("new").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    spans = rows.groupBy("doc_key", "text_hash", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    listed = F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")
    return written(spans.groupBy("doc_key", "text_hash").agg(listed, F.count(F.lit(1)).alias("count_of_spans")))


def repeated_passages(found: DataFrame, words: int, word: str) -> DataFrame:
    """`repeated_spans` cut down to what passages of ``words`` words cover that occur more than once, whole rows kept.

    A span may join several repeated stretches, none of which need hold so many words. So the passages of ``words``
    consecutive words inside a span are counted, told by 128 bits of SHA-256 of their bytes. ``word``: a pattern.
    Those that occur once are few or in few texts; they are listed by text, and every other one is repeated.
    """
    text = F.col("row.text").cast("string")
    keyed = found.withColumns({"_doc": F.col("row.doc_id").cast("long"), "_hash": F.xxhash64(text)})
    some = keyed.filter(F.size("spans") > 0).select(F.col("_doc").alias("doc_key"), F.col("_hash").alias("text_hash"), text.alias("text"), "spans")

    def passages(batches):
        import pyarrow as pa

        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["passage", "doc_key", "text_hash", "start"])

        worker_memory("passages", dict)
        for batch in batches:
            rows = []
            for doc, key, text, spans in zip(batch["doc_key"].to_pylist(), batch["text_hash"].to_pylist(), batch["text"], batch["spans"].to_pylist(), strict=True):
                rows += [(digest, doc, key, a) for a, _, digest in passages_in(text.as_py().encode(), spans, words, word)]
                if len(rows) > 50_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    counted = some.mapInArrow(passages, "passage binary, doc_key long, text_hash long, start int").groupBy("passage").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_key").alias("doc_key"), F.min("text_hash").alias("text_hash"), F.min("start").alias("start")
    )
    singles = counted.filter("n = 1").groupBy("doc_key", "text_hash").agg(F.sort_array(F.collect_list("start")).alias("singles"), F.count(F.lit(1)).alias("count_of_spans"))

    @F.pandas_udf(SPANS)
    def covered(texts, spans, singles):
        import pandas as pd

        out = []
        for text, own, once in zip(texts, spans, singles, strict=True):
            once = set() if once is None else set(once)
            own = [{"start": int(s["start"]), "end": int(s["end"])} for s in own]
            parts: list[dict] = []
            for a, b, _ in passages_in((text or "").encode(), own, words, word) if len(own) else ():
                if a in once:
                    continue
                if parts and a <= parts[-1]["end"]:
                    parts[-1]["end"] = max(b, parts[-1]["end"])
                else:
                    parts.append({"start": a, "end": b})
            out.append(parts)
        return pd.Series(out)

    covered = covered.asNondeterministic()  # else every use of its result would run it once more
    with_some = _with(keyed.filter(F.size("spans") > 0), written(singles))
    cut = with_some.select("row", covered(F.col("row.text").cast("string"), "spans", "singles").alias("spans"))
    return cut.unionByName(found.filter(F.size("spans") == 0).select("row", "spans"))


def passages_in(data: bytes, spans: list[dict], words: int, word: str):
    """First byte, byte after the last, and digest of every run of ``words`` whole words inside a span."""
    from hashlib import sha256

    import regex

    pattern = regex.compile(word)
    for span in spans:
        a, b = span["start"], span["end"]
        if b - a < 2 * words - 1:
            continue
        while a < b and data[a] & 0xC0 == 0x80:  # a character that the border cuts is no word
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        part = data[a:b].decode()
        found = [m.span() for m in pattern.finditer(part)]
        if part.isascii():
            places = [(a + x, a + y) for x, y in found]
        else:
            sizes, at, places = [0], 0, []
            for c in part:
                at += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
                sizes.append(at)
            places = [(a + sizes[x], a + sizes[y]) for x, y in found]
        # A word that goes on beyond the span is not whole; the pattern sees one word across the border.
        if places and places[0][0] == a and a and _goes_on(data, a, pattern):
            places = places[1:]
        if places and places[-1][1] == b and b < len(data) and _goes_on(data, b, pattern):
            places = places[:-1]
        for i in range(len(places) - words + 1):
            first, last = places[i][0], places[i + words - 1][1]
            yield first, last, sha256(data[first:last]).digest()[:16]


def _goes_on(data: bytes, at: int, pattern) -> bool:
    """Whether one word stands on both sides of a border between characters."""
    low = at - 1
    while data[low] & 0xC0 == 0x80:
        low -= 1
    high = at + 1
    while high < len(data) and data[high] & 0xC0 == 0x80:
        high += 1
    return pattern.fullmatch(data[low:high].decode()) is not None


def repeated_in(pieces: list[bytes], twice, window: int) -> list[list[tuple[int, int]]]:
    """For each piece, the ranges covered by windows that occur elsewhere in the pieces, or by all of its
    windows if it is there ``twice``."""
    import numpy as np

    text = np.frombuffer(b"\0".join(pieces) + b"\0" * 8, np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = text[:-8].astype(np.int64) + 2
    symbols[begins[1:] - 1] = 1  # ends a piece
    valid = np.zeros(len(symbols), bool)
    for a, n in zip(begins, sizes, strict=True):
        valid[a : a + n - window + 1] = True
    order = suffix_array(symbols, 258, window)
    order = order[valid[order]]
    a, b, words = order[:-1], order[1:], np.ndarray((len(text) - 7,), np.uint64, text, 0, (1,))
    for at in [*range(0, window - 8, 8), window - 8]:
        same = words[a + at] == words[b + at]
        a, b = a[same], b[same]
    hit = np.zeros(len(symbols), bool)
    hit[a] = hit[b] = True
    out = []
    for k, (start, n) in enumerate(zip(begins, sizes, strict=True)):
        if twice[k]:
            out.append([(0, int(n))])
            continue
        at = np.flatnonzero(hit[start : start + n])
        split = np.flatnonzero(np.diff(at) > window)
        out.append([(int(at[i]), int(at[j]) + window) for i, j in zip(np.r_[0, split + 1], np.r_[split, len(at) - 1], strict=True)] if len(at) else [])
    return out


def suffix_array(s, symbols: int, window: int, span: int = 1):
    """Starts of the suffixes of ``s`` in order, by a difference cover modulo 3.

    ``s``: integers from 1 to ``symbols`` - 1. ``span``: characters of the text that a symbol stands for;
    suffixes that agree over a window may come in any order.
    """
    import numpy as np

    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    t = np.concatenate([s, np.zeros(4, np.int64)])
    sampled = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])  # a triple of zeros ends the first half
    name, many = names(names(t[sampled] * symbols + t[sampled + 1])[0] * symbols + t[sampled + 2])
    if many < len(sampled) and 3 * span < window:
        inner = suffix_array(name + 1, many + 1, window, 3 * span)
        name = np.empty(len(sampled), np.int64)
        name[inner] = np.arange(len(sampled))
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = name + 1
    rank[n:] = 0
    order = sampled[np.argsort(name, kind="stable")]
    order = order[order < n]
    rest = np.arange(0, n, 3)
    scale = len(sampled) + 2
    rest = rest[np.argsort(t[rest] * scale + rank[rest + 1], kind="stable")]
    one, two = order[order % 3 == 1], order[order % 3 == 2]
    before = np.searchsorted(np.sort(t[one] * scale + rank[one + 1]), t[rest] * scale + rank[rest + 1])
    pair, _ = names(np.concatenate([t[two], t[rest]]) * symbols + np.concatenate([t[two + 1], t[rest + 1]]))
    before += np.searchsorted(np.sort(pair[: len(two)] * scale + rank[two + 2]), pair[len(two) :] * scale + rank[rest + 2])
    before = np.maximum.accumulate(before)  # suffixes that agree over a window have no fixed order
    out = np.full(n, -1, np.int64)
    out[before + np.arange(len(rest))] = rest
    out[out < 0] = order
    return out


def names(keys):
    """Each key's number in ascending order, from 0, and how many there are."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[False, ordered[1:] != ordered[:-1]] if len(keys) else np.zeros(0, bool)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum()) + 1
