"""Exact top-k search by distributed histogram selection.

All scores of a query set against all rows are computed in blocks: block pairs (queries x candidates) are
rows of one table, joined on both block numbers, so every task holds two blocks at a time. A round
computes the scores of each pair and counts them, per query, in the bins of that query's current range. A pair
reports only the bins from its own k-th best score upwards, since the global k-th cannot lie below. The summed
histograms tell the bin that holds the k-th score; it is the next range, until a bin is one integer
wide. Then the scores above the k-th value are kept, with as many of its ties, smallest ids first, as
any pair could contribute, and the ranks are given. Work grows with queries x rows, traffic with
the number of blocks.

Components are floor(64 x) as integers. Products are exact: in doubles while all sums stay below 2^53, else in
integers of any size (scores beyond a long saturate).

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a
null id; vectors of different lengths have no common score and never meet; an empty vector scores 0;
repeated ids are rows of their own, and a query's own id is never its candidate; fewer than k candidates are all
returned; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import parallelism, written

SCALE = 64
BINS = 256
QUERY_BLOCK = 1024
ROW_BLOCK = 8192
BLOCK = "size int, qb long, cb long, ids binary, data binary"


def usable(vector: Column) -> Column:
    """Neither null nor holding null, NaN or infinite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _blocks(rows: DataFrame, own: str, other: str, n_own: int, n_other: int) -> DataFrame:
    """Vectors packed by block, each block once for every block of the other side."""

    def packed(key, frame):
        import numpy as np
        import pandas as pd

        data = np.floor(SCALE * np.array(frame["vector"].tolist(), dtype=np.float64).reshape(len(frame), -1))
        return pd.DataFrame({"size": [key[0]], "block": [key[1]], "ids": [frame["id"].to_numpy(np.int64).tobytes()], "data": [data.tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.hash("vector")), F.lit(n_own)))
    blocks = dealt.groupBy("size", "block").applyInPandas(packed, "size int, block long, ids binary, data binary")
    return blocks.select("size", F.col("block").alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))).alias(other), "ids", "data")


def scores_of(left, right, width: int):
    """Integer inner products as int64."""
    import numpy as np

    a, b = np.frombuffer(left).reshape(-1, width), np.frombuffer(right).reshape(-1, width)
    most = max(1, width) * np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0)
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], dtype=object).reshape(b.shape).T
    limits = np.iinfo(np.int64)
    return np.clip(whole, limits.min, limits.max).astype(np.int64)


def _each_pair(pairs: DataFrame, schema: str, work: Callable) -> DataFrame:
    """``work(query places, query ids, candidate ids, scores, mask of the query's own id, state)`` for every block pair."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                q, c = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
                scores = scores_of(row["q_data"], row["c_data"], row["size"])
                state = np.frombuffer(row["state"], np.int64).reshape(len(q), -1) if row.get("state") else None
                yield from work(row, q, c, scores, state)

    return pairs.mapInArrow(run, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of each query's k best other rows; ties to smaller ids."""
    rows = vectors.filter(usable(F.col(vector_column).cast("array<double>")) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")
    )
    rows = rows.withColumn("size", F.size("vector"))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    q_blocks, c_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n // ROW_BLOCK), min(parallelism(vectors), n // 512))
    queries = _blocks(rows.filter("is_query"), "qb", "cb", q_blocks, c_blocks)
    others = _blocks(rows, "cb", "qb", c_blocks, q_blocks)
    pairs = written(
        queries.withColumnsRenamed({"ids": "q_ids", "data": "q_data"}).join(others.withColumnsRenamed({"ids": "c_ids", "data": "c_data"}), ["size", "qb", "cb"])
        .repartition(c_blocks * q_blocks, "qb", "cb")
    )
    ranges = _initial_ranges(pairs, k)
    while not ranges.filter("width > 0").isEmpty():
        ranges = _refined(pairs, ranges, k)
    return _selected(pairs, ranges, k)



def _initial_ranges(pairs: DataFrame, k: int) -> DataFrame:
    """Each query's range of scores by bounds of the blocks: one round over the data, without products.

    A range is [low, low + span) in bins of `width`; `wanted`: the how-manyth score from the top of the range
    is sought. A width of 0: `low` is the k-th score.
    """

    def bounds(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                a, b = (np.frombuffer(x).reshape(-1, row.size_of) for x in (row.q_data, row.c_data))
                reach = np.ceil(np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1).max(initial=0.0))) + 1
                reach = np.minimum(reach, 2.0**62).astype(np.int64)
                yield pd.DataFrame({"size": row.size_of, "qb": row.qb, "place": np.arange(len(a)), "reach": reach})

    found = pairs.select(F.col("size").alias("size_of"), "qb", "q_data", "c_data").mapInPandas(bounds, "size int, qb long, place int, reach long")
    ranges = found.groupBy("size", "qb", "place").agg(F.max("reach").alias("reach"))
    width = F.greatest(F.ceil((F.col("reach") * 2.0 + 1) / BINS), F.lit(1)).cast("long")
    return written(ranges.select("size", "qb", "place", (-F.col("reach")).alias("low"), width.alias("width"), (width * BINS).alias("span"), F.lit(k).cast("long").alias("wanted")))


def _with_state(pairs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each block pair with the packed ranges of its queries, 24 bytes per query."""

    def packed(key, frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("place")
        return pd.DataFrame({"size": [key[0]], "qb": [key[1]], "state": [frame[["low", "width", "span"]].to_numpy(np.int64).tobytes()]})

    state = ranges.groupBy("size", "qb").applyInPandas(packed, "size int, qb long, state binary")
    return pairs.join(written(state), ["size", "qb"])


def _refined(pairs: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
    def counts(row, q, c, scores, state):
        import numpy as np
        import pyarrow as pa

        low, width, span = state[:, :1], state[:, 1:2], state[:, 2:]
        bins = (scores - low) // np.maximum(width, 1)
        np.clip(bins, -1, BINS, out=bins)
        bins[scores - low >= span] = BINS  # above the range: counted in an earlier round
        bins[(width == 0)[:, 0]] = -1
        bins[q[:, None] == c] = -1
        if bins.shape[1] > k:
            kth = np.partition(bins, bins.shape[1] - k, axis=1)[:, bins.shape[1] - k]  # below its own k-th no pair can decide
        else:
            kth = np.zeros(len(q), np.int64)
        at, _ = np.nonzero(keep := (bins >= np.maximum(kth, 0)[:, None]) & (bins < BINS))
        code, n = np.unique(at.astype(np.int64) * BINS + bins[keep], return_counts=True)
        yield pa.RecordBatch.from_pydict({"size": pa.array([row["size"]] * len(n), pa.int32()), "qb": pa.array([row["qb"]] * len(n), pa.int64()), "place": pa.array(code // BINS, pa.int32()), "bin": pa.array(code % BINS, pa.int64()), "n": pa.array(n, pa.int64())})

    open_ranges = _with_state(pairs, ranges)
    found = _each_pair(open_ranges, "size int, qb long, place int, bin long, n long", counts)
    summed = found.groupBy("size", "qb", "place", "bin").agg(F.sum("n").alias("n"))
    down = W.partitionBy("size", "qb", "place").orderBy(F.desc("bin"))  # BINS rows at most
    cut = summed.withColumn("above", F.coalesce(F.sum("n").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    located = ranges.join(cut, ["size", "qb", "place"], "left")
    inside = (F.col("above") < F.col("wanted")) & (F.col("wanted") <= F.col("above") + F.col("n"))
    chosen = located.groupBy("size", "qb", "place", "low", "width", "wanted").agg(F.max(F.when(inside, F.struct("bin", "above"))).alias("hit"))
    found = F.col("hit").isNotNull()
    step = F.greatest(F.ceil(F.col("width") / BINS), F.lit(1)).cast("long")
    low = F.when(F.col("width") == 0, F.col("low")).when(found, F.col("low") + F.col("hit.bin") * F.col("width")).otherwise(F.lit(-(2**63)))
    more = found & (F.col("width") > 1)  # not found: fewer than k candidates
    return written(
        chosen.select(
            "size", "qb", "place", low.cast("long").alias("low"), F.when(more, step).otherwise(0).cast("long").alias("width"),
            F.col("width").alias("span"), F.when(more, F.col("wanted") - F.col("hit.above")).otherwise(0).cast("long").alias("wanted"),
        )
    )


def _selected(pairs: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
    def best(row, q, c, scores, state):
        import numpy as np
        import pyarrow as pa

        kth, own = state[:, :1], q[:, None] == c
        above = (scores > kth) & ~own
        ties = (scores == kth) & ~own
        order = np.argsort(c, kind="stable")
        ranked = ties[:, order]
        ranked &= np.cumsum(ranked, axis=1) <= k  # smallest ids of a value first; more cannot be needed
        ties[:, order] = ranked
        at, where = np.nonzero(above | ties)
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(q[at], pa.int64()), "query": pa.array(row["qb"] << 32 | at, pa.int64()), "size": pa.array([row["size"]] * len(at), pa.int32()), "id": pa.array(c[where], pa.int64()), "score": pa.array(scores[at, where], pa.int64())})

    found = _each_pair(_with_state(pairs, ranges), "query_id long, query long, size int, id long, score long", best)
    order = W.partitionBy("size", "query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
