"""Near-duplicate documents by MinHash bands, odd sketches and full-set confirmation.

1. One pass gives every document its set of distinct five-word shingles (64-bit hashes), the set's size
   and digest, MinHash samples, band keys, and the odd sketch: each sample flips one bit of a bitmap, so the
   XOR of two bitmaps counts the samples in which two sets differ, precisely where they are similar.
2. Documents with equal sets are one class from here on.
3. Classes that share a band key are candidates. First every class is paired with one leader of its
   bucket (twice, with two leaders), confirmed, and joined to components: groups of any size need as many pairs
   as they have members. Only buckets that still hold several components compare their members, in blocks, by the
   sketches; so no candidate is left out, and none is listed that a sketch excludes.
4. A candidate whose sizes and sketches allow the similarity is confirmed on the full sets.

With 36 bands of 4 rows a pair at 0.75 shares no band with a probability of 1e-6; the sketch bound lies
five standard deviations out. Leaders' sets are sent once per 256 partners, so a hot group is many tasks.

Cases: a text with fewer than five words has one shingle, the whole sequence; a null text, or one without
words, has none and is linked with nothing; repeated rows are documents of one class; a null doc_id is
linked like others and its component has the least doc_id that is not null; an empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import free_names, worker_memory, written

WORDS = 5
BANDS, ROWS = 36, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
LANES = SKETCH_BITS // 64
PARITY_BITS = 4096
CHUNK = 256
BLOCK = 2048
SENT = 1_000_000  # rows of ids (about 30 MB) that a broadcast may have
FEATURES = "doc_id long, text_hash long, n long, digest binary, bands array<bigint>, sketch array<bigint>"


def shared_shingler() -> Shingler:
    """One `Shingler` for all tasks that a Python worker runs one after another."""
    return worker_memory("shingles", Shingler)


class Shingler:
    """Sorted distinct shingle hashes of texts. Word hashes are remembered up to a bound."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None):
        import numpy as np
        import xxhash

        words = (text or "").encode().lower().split()  # bytes: A-Z and blanks of ASCII only
        if not words:
            return np.empty(0, np.uint64)
        if len(self.words) > 200_000:
            self.words = {}
        for w in set(words).difference(self.words):
            self.words[w] = xxhash.xxh3_64_intdigest(w)
        at = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        width = min(WORDS, len(at))
        n = len(at) - width + 1
        out = np.full(n, width, np.uint64)
        for i in range(width):
            out = mixed(out + at[i : i + n])
        return np.unique(out)


def mixed(x):
    """A one-to-one mixing of 64-bit integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def samples(shingles):
    """MinHash samples of a non-empty set."""
    import numpy as np

    draw = np.random.default_rng(7)
    odd = (draw.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    turn = draw.integers(0, 2**32, SAMPLES, dtype=np.uint32)[:, None]
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        hashed = (x[None, at : at + 2048] ^ turn) * odd
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        np.minimum(least, hashed.min(axis=1), out=least)
    return least


def parity(shingles: bytes) -> bytes:
    """The odd sketch of a whole set: bits that differ between two of them are differing members at least."""
    import numpy as np

    at = (np.frombuffer(shingles, np.uint64) & np.uint64(PARITY_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITY_BITS) & 1).astype(np.uint8)).tobytes()


def features(docs: DataFrame) -> DataFrame:
    """Set size, digest, band keys and odd sketch of every document."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        shingler = shared_shingler()
        place = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
        band = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, digests, bands, sketches = [], [], [], []
                for text in part.column("text").to_pylist():
                    own = shingler(text)
                    n.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    if not len(own):
                        bands.append(None)
                        sketches.append(None)
                        continue
                    drawn = samples(own).astype(np.uint64)
                    keys = band.copy()
                    for row in drawn.reshape(BANDS, ROWS).T:
                        keys = mixed(keys + row)
                    bands.append(keys.view(np.int64))
                    flips = np.bincount((mixed(place + drawn) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
                    sketches.append(np.packbits(flips.astype(np.uint8)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                    [x.split()[0] for x in FEATURES.split(", ")],
                )

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return written(rows.mapInArrow(run, FEATURES).withColumn("row", F.monotonically_increasing_id()))


def sketch_limit(percent: int) -> int:
    """Bits that the XOR of two sketches has at most, five deviations out, if the similarity is reached."""
    t = percent / 100
    flips = 2 * (SAMPLES * (1 - t) + 5 * (SAMPLES * t * (1 - t)) ** 0.5)
    bits = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips)
    return int(bits + 3 * bits**0.5) + 1


def _possible(percent: int, left: str, right: str) -> Column:
    """Whether sizes and sketches of two classes allow the similarity."""
    a, b = (F.col(f"{x}.n") for x in (left, right))
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{left}.sketch")[i].bitwiseXOR(F.col(f"{right}.sketch")[i])) for i in range(LANES)])
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (bits <= sketch_limit(percent))


def near_documents(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    placed = _grouped(docs, percent)
    least = placed.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "group")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """row, doc_id, text_hash, n and group (a row number that near-duplicates share) of every row."""
    found = features(docs)
    classes = written(found.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node")))
    nodes = written(found.join(classes.select(F.col("node").alias("row")), "row").withColumnRenamed("row", "node"))
    labels = _labels(docs, nodes, percent)
    placed = found.select("row", "doc_id", "text_hash", "n", "digest").join(classes, "digest", "left").join(labels, "node", "left")
    return written(placed.select("row", "doc_id", "text_hash", "n", F.coalesce("label", "node", "row").alias("group")))


def survivors(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each group, with all columns of ``docs``: the one with the least doc_id (nulls last)."""
    placed = _grouped(docs, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_hash")).alias("first")
    chosen = placed.groupBy("group").agg(first).select("first.doc_id", "first.text_hash")
    same = placed.groupBy("doc_id", "text_hash").agg((F.count(F.lit(1)) > 1).alias("again"))
    d, t, more = free_names(docs, "kept_doc", "kept_text", "again")
    of = F.col("chosen.doc_id").eqNullSafe(F.col("same.doc_id")) & (F.col("chosen.text_hash") == F.col("same.text_hash"))
    keys = chosen.alias("chosen").join(same.alias("same"), of).select(F.col("same.doc_id").alias(d), F.col("same.text_hash").alias(t), F.col("again").alias(more))
    keys = written(keys.distinct())
    if keys.count() <= SENT:
        keys = F.broadcast(keys)  # its size is checked; beyond it the join shuffles
    left = docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t)))
    again = left.filter(F.col(more)).dropDuplicates([d, t])  # rows that repeat doc_id and text
    return left.filter(~F.col(more)).unionByName(again).select(*docs.columns)


def _labels(docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """node and label of every class that is linked to another."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first"), F.max("node").alias("last")).filter("members > 1")
    members = written(keys.join(crowded, "key"))
    short = nodes.select("node", "n", "sketch")
    sets = _sets(docs, nodes, members.select("node").distinct())

    def stars(rows: DataFrame, leader: str) -> DataFrame:
        return rows.filter(F.col("node") != F.col(leader)).select(F.col(leader).alias("a"), F.col("node").alias("b")).distinct()

    links = _confirmed(stars(members, "first"), short, sets, percent)
    labels = _named(links)
    open_members = _open(members.filter("members > 2"), labels)
    links = links.union(_confirmed(stars(open_members, "last"), short, sets, percent))
    labels = _named(links)
    open_members = _open(open_members.drop("label"), labels)
    links = links.union(_confirmed(_by_sketch(open_members, short, sets, percent), short, sets, percent))
    return _named(links)


def _named(links: DataFrame) -> DataFrame:
    return written(components(links).select(F.col("id").alias("node"), F.col("component").alias("label")))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with labels, of the buckets that hold several components."""
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    return written(named.join(several, "key", "left_semi"))


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, sorted shingle hashes and their parity bitmap of the classes wanted, made again from the text of their first document."""
    wanted = written(nodes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("_doc"), "digest"))
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)  # its size is checked; beyond it the join shuffles
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string"))
    chosen = texts.join(wanted, F.col("_id").eqNullSafe(F.col("_doc"))).select("node", "digest", "text")

    def run(batches):
        import pyarrow as pa
        import xxhash

        shingler = shared_shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [shingler(t).tobytes() for t in part.column("text").to_pylist()]
                same = [xxhash.xxh3_128_digest(x) == d for x, d in zip(own, part.column("digest").to_pylist(), strict=True)]
                out = pa.RecordBatch.from_arrays([part.column("node"), pa.array(own, pa.binary()), pa.array(map(parity, own), pa.binary())], ["node", "shingles", "parity"])
                yield out.filter(pa.array(same))

    # rows that repeat a doc_id and its text would come twice
    return written(chosen.mapInArrow(run, "node long, shingles binary, parity binary"))


def _confirmed(pairs: DataFrame, short: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = short.select(F.col("node").alias("a"), F.struct("n", "sketch").alias("left"))
    right = short.select(F.col("node").alias("b"), F.struct("n", "sketch").alias("right"))
    likely = written(pairs.join(left, "a").join(right, "b").filter(_possible(percent, "left", "right")).select("a", "b"))
    chunks = likely.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = written(likely.join(chunks, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks"))).drop("chunks"))
    partners = dealt.join(sets, F.col("b") == sets["node"]).select("a", "chunk", "b", "shingles")
    bases = dealt.select("a", "chunk").distinct().join(sets, F.col("a") == sets["node"]).select("a", "chunk", F.col("a").alias("b"), "shingles")

    def confirm(key, frame):
        import numpy as np
        import pandas as pd

        own = {b: np.frombuffer(x, np.uint64) for b, x in zip(frame["b"], frame["shingles"], strict=True)}
        base = own.pop(key[0])
        good = []
        for b, other in own.items():
            few, many = sorted((base, other), key=len)
            at = np.searchsorted(many, few)
            common = int((many[np.minimum(at, len(many) - 1)] == few).sum())
            if 100 * common >= percent * (len(few) + len(many) - common):
                good.append(b)
        return pd.DataFrame({"a": key[0], "b": np.array(good, np.int64)})

    return written(partners.union(bases).groupBy("a", "chunk").applyInPandas(confirm, "a long, b long"))


def _by_sketch(members: DataFrame, short: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in one bucket that sizes and sketches allow, compared in blocks.

    Here the odd sketches of the whole sets decide after those of the samples: they never exclude a pair that
    reaches the similarity, and seldom leave one that is far below it.
    """
    blocks = members.withColumn("blocks", F.ceil(F.col("members") / BLOCK)).join(short, "node").join(sets.select("node", "parity"), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = blocks.withColumn("mine", mine).withColumn("other", other).withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    limit = sketch_limit(percent)

    def compare(key, frame):
        import numpy as np
        import pandas as pd

        node, label, n, mine = (frame[c].to_numpy() for c in ("node", "label", "n", "mine"))
        sketch = np.array(frame["sketch"].tolist(), np.int64).reshape(len(frame), -1).view(np.uint64)
        whole = np.frombuffer(b"".join(frame["parity"]), np.uint64).reshape(len(frame), -1)
        left, right = np.flatnonzero(mine == key[1]), np.flatnonzero(mine == key[2])
        out = []
        for at in range(0, len(left), 128):
            some = left[at : at + 128]
            fits = label[some][:, None] < label[right]
            if key[1] != key[2]:
                fits |= label[some][:, None] > label[right]
            sizes = n[some][:, None], n[right]
            fits &= np.minimum(*sizes) * 100 >= np.maximum(*sizes) * percent
            i, j = np.nonzero(fits)
            for k in range(0, len(i), 1 << 14):
                a, b = some[i[k : k + (1 << 14)]], right[j[k : k + (1 << 14)]]
                near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= limit
                a, b = a[near], b[near]
                differ = np.bitwise_count(whole[a] ^ whole[b]).sum(axis=1).astype(np.int64)  # of n + m - 2 common members
                near = differ * (100 + percent) <= (n[a] + n[b]) * (100 - percent)
                out.append(pd.DataFrame({"a": np.minimum(node[a], node[b])[near], "b": np.maximum(node[a], node[b])[near]}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})

    return cells.select("key", "low", "high", "mine", "node", "label", "n", "sketch", "parity").groupBy("key", "low", "high").applyInPandas(compare, "a long, b long").distinct()
