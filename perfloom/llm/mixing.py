"""Mix sources to target weights: exact block quotas dealt to output shards by a splitting tree.

1. Every source gets a target by weight; targets above `REPEATS` times the source's size are cut there and
   the excess is dealt again by weight among the others.
2. The documents of a source are put into a random order that the seed fixes. The order is cut into
   buckets of the hash, so the running word counts come from bucket totals and bucket-local windows, and a source with
   any share of the rows is spread over many tasks. A source is passed as often as its target holds its
   size; the last pass ends at the document border nearest to the target.
3. Each source's passes are cut into blocks of about `BLOCK_WORDS` words; the numbers of blocks are
   its quota. A binary tree over the output shards splits the vector of quotas: what goes to the left half
   is one draw of the multivariate hypergeometric distribution, so every shard gets a random mixture and
   the quotas stay exact. A leaf replays its own path from the root with generators seeded by
   the nodes, so no level is a job of its own and a lost task gives the same result again.
4. A shard draws its blocks as a range of each source's block order and shuffles their documents by hash.

The tree reads one row per source (in one packed row), never documents.

Planning and dealing see narrow rows only (no texts); `mix` joins the texts once.

Cases: a null text has size 0; a null source is a source of its own, the last; documents of size 0 are
taken with the pass they lie in; repeated rows are documents of their own; an empty table gives no rows.
`mix` keeps extra columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import free_names, written

REPEATS = 3
WEIGHTS = (1, 2, 3)
BUCKETS = 1024
BLOCK_WORDS = 1 << 14
SHARD_BLOCKS = 256
ONE_WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
PLAN = ("row", "doc_id", "key", "size", "source_size", "target", "before", "shuffle", "times")


def word_count(text: Column) -> Column:
    """Words of a text: runs of characters other than blanks. Each word with its blanks becomes one letter."""
    letters = F.length(F.regexp_replace(text, ONE_WORD, "x"))
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), letters).otherwise(0).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes``: key, source, source_size. Adds weight and target; one row per source throughout.

    Only sums come to the driver in each round, and a round caps at least one more source.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))  # one row per source
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    rows = written(sizes.withColumn("weight", weight.cast("double")))
    cap = F.col("source_size") * float(REPEATS)
    level, capped = 0.0, -1
    while True:
        above = cap < F.col("weight") * level
        total, held, open_weight, n = rows.agg(
            F.sum("source_size"), F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count(F.when(above, 1))
        ).first()
        if n == capped or not open_weight:
            break
        level, capped = (total - held) / open_weight, n
    return rows.withColumn("target", F.least(cap, F.col("weight") * level))


def narrow(rows: DataFrame, seed: int) -> DataFrame:
    """What planning needs of ``rows`` (doc_id, text, source and a unique `row`)."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    key = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))  # never null, so joins stay plain
    shuffle = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text)
    own = rows.select("row", F.col("doc_id").cast("long"), source.alias("source"), key.alias("key"), word_count(text).alias("size"), shuffle.alias("shuffle"))
    return own.withColumn("bucket", F.pmod(F.shiftright("shuffle", 40), F.lit(BUCKETS)))


def plan(own: DataFrame) -> DataFrame:
    """`narrow` rows with source_size, target, the words before each in its source's order, and how
    often it is taken."""
    totals = written(own.groupBy("key", "source", "bucket").agg(F.sum("size").alias("words")))
    goals = targets(totals.groupBy("key", "source").agg(F.sum("words").alias("source_size"))).drop("source", "weight")
    earlier = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # BUCKETS rows at most
    offsets = totals.select("key", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = W.partitionBy("key", "bucket").orderBy("shuffle", "row").rowsBetween(W.unboundedPreceding, -1)
    local = own.drop("source").withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = local.join(written(offsets.join(goals, "key")), ["key", "bucket"]).withColumn("before", F.col("base") + F.col("local"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1)
    rest = F.col("target") - passes * F.col("source_size")
    again = (F.col("before") + F.col("size") / 2 <= rest) & (passes < REPEATS) & (F.col("source_size") > 0)  # ends at the nearest border
    return placed.withColumn("times", (passes + F.when(again, 1).otherwise(0)).cast("int")).select(*PLAN)


def draws(planned: DataFrame, seed: int = 0) -> DataFrame:
    """One row per taken document and pass: row, key, pass, block, shard and the place in the shard."""
    taken = planned.filter("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    blocks = F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(1))
    inside = F.least(F.floor(F.col("before") / BLOCK_WORDS), blocks - 1)
    taken = taken.withColumn("block", (F.col("pass") * blocks + inside).cast("long"))
    quotas = taken.groupBy("key").agg((F.max("block") + 1).alias("quota"))
    dealt = written(split(quotas, seed))
    return taken.join(dealt, ["key", "block"]).withColumn("place", F.xxhash64(F.lit(seed), "shard", "shuffle", "pass")).select("row", "key", "pass", "block", "shard", "place")


def split(quotas: DataFrame, seed: int) -> DataFrame:
    """key, block and the shard that draws it. ``quotas``: key and number of blocks, one row per source."""
    packed = quotas.agg(F.sort_array(F.collect_list(F.struct("key", "quota"))).alias("packed"), F.sum("quota").alias("total"))
    shards = F.greatest(F.ceil(F.col("total") / SHARD_BLOCKS), F.lit(1)).cast("int")
    leaves = packed.filter("total > 0").select(shards.alias("shards"), "packed", F.explode(F.sequence(F.lit(0), shards - 1)).alias("leaf"))

    def leaf_blocks(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                keys = [x["key"] for x in row.packed]
                whole = np.array([x["quota"] for x in row.packed], dtype=np.int64)
                first, n = leaf_range(whole, int(row.leaf), int(row.shards), seed)
                for key, all_blocks, start, count in zip(keys, whole, first, n, strict=True):
                    if count:
                        drawn = permuted(np.arange(start, start + count), int(all_blocks))
                        yield pd.DataFrame({"key": key, "block": drawn, "shard": int(row.leaf)})

    return leaves.repartition("leaf").mapInPandas(leaf_blocks, "key string, block long, shard long")


def leaf_range(quotas, leaf: int, shards: int, seed: int):
    """First place and number of blocks of each source that shard ``leaf`` draws."""
    import numpy as np

    total = int(quotas.sum())
    low, high = 0, shards
    first, own = np.zeros_like(quotas), quotas.copy()
    while high - low > 1:
        middle = (low + high) // 2
        goes_left = total * middle // shards - total * low // shards
        generator = np.random.default_rng([seed & 0xFFFFFFFF, low, high])
        left = generator.multivariate_hypergeometric(own, goes_left, method="marginals")
        if leaf < middle:
            own, high = left, middle
        else:
            first, own, low = first + left, own - left, middle
    return first, own


def permuted(places, n: int):
    """The blocks at these places of a source's block order: steps of a number coprime to ``n``."""
    from math import gcd

    step = max(1, round(n * 0.6180339887))
    while gcd(step, n) != 1:
        step += 1
    return places * step % n


def mix(docs: DataFrame, seed: int = 0, shard: str = "_shard", place: str = "_place") -> DataFrame:
    """The mixed documents, shard by shard in shuffled order: ``docs``' columns, ``shard`` and ``place``.

    The last two must not be names of ``docs`` (`storage.free_names` finds such).
    """
    (row,) = free_names(docs, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))  # written so that the numbers stay the same
    planned = written(plan(written(narrow(rows.select("doc_id", "source", "text", F.col(row).alias("row")), seed))))
    drawn = draws(planned, seed).select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("place").alias(place))
    mixed = rows.join(drawn, row)
    return mixed.repartition(shard).sortWithinPartitions(shard, place, row).drop(row)
