"""Ranked lexical search by hybrid evaluation: term at a time over short lists, document at a time over long ones.

1. Query terms of a block of items (at most about `ITEM_BYTES` of text; more items make more blocks, one pass each)
   go to all tasks. One pass over the texts counts every document's terms and writes blocks of `BLOCK` documents,
   each with its postings of the query terms. Postings of other terms can add nothing to a score.
2. The blocks give the number of documents, of terms and of documents per query term.
3. A task reads blocks and keeps the `k` best documents of each item. In a block, lists of few documents are
   summed term at a time into accumulators. These are one more list, with its largest sum as bound, beside the
   long lists. Lists are ordered by bound; those whose bounds together stay below the k-th best score so far
   cannot bring a document in alone, so only documents of the other lists are visited, and these are looked up
   in the remaining lists while their bound still reaches that score. A block whose bounds stay below it is skipped.
4. Each task sends `k` documents per item; the best of them are the result.

Scores are 64-bit integers, see `search`. Skipping needs a bound strictly below the k-th best score, so ties are kept.

Cases: null and empty texts have no terms and are in no result, nor counted among the documents; items without
terms, or whose terms occur in no document, have no rows; rows that repeat a doc_id are documents of their own, a null
doc_id comes after others of its score; rows that repeat an item_id are items of their own; empty tables give no rows;
texts above `SLICE` bytes are counted in slices that end between terms. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written

BLOCK = 2048
BLOCK_BYTES = 32 << 20
SLICE = 1 << 20
ITEM_BYTES = 4 << 20
SHORT = 64  # a list of at most one in so many documents of a block is short
#: Bytes outside terms; letters A-Z become a-z, bytes of characters beyond ASCII belong to terms.
SPLIT = bytes(b if b > 127 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
INDEX = "n_docs long, n_terms long, doc_ids binary, no_id binary, lengths binary, terms array<int>, sizes array<int>, places binary, counts binary"


def term_lists(text: str | None):
    """A text's terms in order, in lists of at most about `SLICE` bytes of text."""
    data = (text or "").encode().translate(SPLIT)
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            end = data.rfind(b" ", at, end) + 1 or (data.find(b" ", end) + 1 or len(data))
        yield data[at:end].split()
        at = end


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item.

    ``docs``: doc_id, text. ``items``: item_id, text. With N documents that have terms, L terms in all, df documents
    with a term, tf of its occurrences among a document's n: the score sums
    floor(1000 ln((2N + 2) / (2df + 1))) * (10^9 tf div (1000 tf + 8m)), m = 25 + 75nN div L, over an item's terms.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    found = [_searched(docs, items.filter(part == b).collect(), k, b) for b in range(blocks)]  # one block at a time
    found = [f for f in found if f is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _searched(docs: DataFrame, items: list, k: int, block: int) -> DataFrame | None:
    vocabulary: dict[bytes, int] = {}
    queries = []
    for item in items:
        wanted = Counter(t for terms in term_lists(item["text"]) for t in terms)
        if wanted:
            queries.append((item["item_id"], [(vocabulary.setdefault(t, len(vocabulary)), n) for t, n in wanted.items()]))
    if not queries:
        return None
    index = written(docs.mapInArrow(_indexer(vocabulary), INDEX))
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return None
    lists = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("l")).groupBy("l.terms").agg(F.sum("l.sizes").alias("df"))
    weights = [0] * len(vocabulary)
    for term, df in lists.collect():  # a row per query term of the block at most
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    best = index.mapInArrow(_scorer(queries, weights, n_docs, n_terms, k), "item int, item_id long, doc_id long, score long")
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


class Known(dict):
    """Numbers of the query terms; -1 for any other term."""

    def __missing__(self, term: bytes) -> int:
        return -1


def _indexer(vocabulary: dict[bytes, int]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        number = Known(vocabulary).__getitem__
        ids, lengths, docs, terms, size = [], [], [], [], 0

        def block():
            known, lacks = np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids])
            n = np.array(lengths, np.int64)
            at = np.concatenate([np.repeat(np.array(docs, np.int64), [len(t) for t in terms]), np.zeros(0, np.int64)])
            key, counts = np.unique(np.concatenate([*terms, np.zeros(0, np.int64)]) * len(ids) + at, return_counts=True)
            term, sizes = np.unique(key // len(ids), return_counts=True)
            row = {
                "n_docs": int((n > 0).sum()), "n_terms": int(n.sum()), "doc_ids": known.tobytes(), "no_id": lacks.tobytes(), "lengths": n.tobytes(),
                "terms": term.astype(np.int32), "sizes": sizes.astype(np.int32), "places": (key % len(ids)).astype(np.int32).tobytes(), "counts": counts.astype(np.int32).tobytes(),
            }
            columns = [pa.array([row[f.name]], f.type) for f in shape]
            return pa.RecordBatch.from_arrays(columns, schema=shape)

        integers = pa.list_(pa.int32())
        shape = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary(), "array<int>": integers}[c.split()[1]]) for c in INDEX.split(", ")])
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text, n = text.as_py(), 0
                for part in term_lists(text):
                    n += len(part)
                    found = np.fromiter(map(number, part), np.int64, len(part))
                    found = found[found >= 0]
                    docs.append(len(ids))
                    terms.append(found)
                    size += found.nbytes
                ids.append(doc)
                lengths.append(n)
                if len(ids) >= BLOCK or size >= BLOCK_BYTES:
                    yield block()
                    ids, lengths, docs, terms, size = [], [], [], [], 0
        if ids:
            yield block()

    return run


class Best:
    """The ``k`` best documents of an item so far; ``floor`` is the score that a further one must reach."""

    def __init__(self, k: int):
        import numpy as np

        self.k, self.floor = k, 1
        self.scores, self.ids, self.lacks = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores, ids, lacks) -> None:
        import numpy as np

        scores, ids, lacks = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.lacks, lacks)))
        order = np.lexsort((ids, lacks, -scores))[: self.k]
        self.scores, self.ids, self.lacks = scores[order], ids[order], lacks[order]
        if len(order) == self.k:
            self.floor = max(1, int(self.scores[-1]))


def _scorer(queries: list, weights: list[int], n_docs: int, n_terms: int, k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        best = [Best(k) for _ in queries]
        for batch in batches:
            for row in batch.to_pylist():
                ids, lacks = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["no_id"], bool)
                size = 25 + 75 * np.frombuffer(row["lengths"], np.int64) * n_docs // n_terms
                places, counts = np.frombuffer(row["places"], np.int32), np.frombuffer(row["counts"], np.int32).astype(np.int64)
                parts = 1_000_000_000 * counts // (1000 * counts + 8 * size[places])
                ends = np.cumsum(row["sizes"])
                postings = {t: (places[e - n : e], parts[e - n : e], int(parts[e - n : e].max())) for t, n, e in zip(row["terms"], row["sizes"], ends, strict=True) if weights[t]}
                for top, (_, wanted) in zip(best, queries, strict=True):
                    lists = [(*postings[t], n * weights[t]) for t, n in wanted if t in postings]
                    at, scores = visited(lists, len(ids), top.floor)
                    if len(at):
                        top.add(scores, ids[at], lacks[at])
        rows = [(q, queries[q][0], None if no else int(i), int(s)) for q, b in enumerate(best) for s, i, no in zip(b.scores, b.ids, b.lacks, strict=True)]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item", "item_id", "doc_id", "score"])

    return run


def visited(lists: list, n: int, floor: int):
    """Places and scores of all documents of a block of ``n`` whose score is ``floor`` or more.

    ``lists``: places in ascending order, parts of scores, the largest part, and a factor.
    """
    import numpy as np

    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if sum(most * factor for *_, most, factor in lists) < floor:
        return nothing
    short = [x for x in lists if len(x[0]) * SHORT <= n]
    ordered = [(most * factor, places, parts * factor) for places, parts, most, factor in lists if len(places) * SHORT > n]
    if short:
        places, slot = np.unique(np.concatenate([x[0] for x in short]), return_inverse=True)
        sums = np.zeros(len(places), np.int64)
        np.add.at(sums, slot, np.concatenate([parts * factor for _, parts, _, factor in short]))
        ordered.append((int(sums.max()), places, sums))
    ordered.sort(key=lambda x: x[0])
    below, first = [0], 0  # bounds of the first lists together; how many of them stay below the floor
    for bound, _, _ in ordered:
        below.append(below[-1] + bound)
    while first < len(ordered) and below[first + 1] < floor:
        first += 1
    total = np.zeros(n, np.int64)
    for _, places, parts in ordered[first:]:
        total[places] += parts
    at = np.flatnonzero(total)
    scores = total[at]
    for j in range(first - 1, -1, -1):
        reach = scores + below[j + 1] >= floor
        at, scores = at[reach], scores[reach]
        _, places, parts = ordered[j]
        slot = np.minimum(np.searchsorted(places, at), len(places) - 1)
        scores = scores + np.where(places[slot] == at, parts[slot], 0)
    reach = scores >= floor
    return at[reach], scores[reach]
