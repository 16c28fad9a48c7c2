"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

1. Vectors are made unit vectors once, packed as bytes. Vectors with equal components are one class with a count of its
   rows; classes are what the forest holds.
2. Every tree splits its node at the median of the node's projections on the one of `TRIES` random directions that has
   the fewest vectors near the median. Vectors within a margin of the split go to both sides. The margin is a share of
   the spread that linked vectors' projections can have, so a linked pair is rarely torn apart, and rarely in all
   trees; it is narrowed where more than a share of the node would spill, a share that shrinks with the depth, so that a
   tree holds at most about e (2.7) places a vector however deep it grows.
3. Splits come from a sample of at most about `SAMPLE` vectors per node; all vectors are routed. A
   node that is still too large is sampled and split again in the next round, whatever the table's size, and only its
   vectors are routed again. A node that no direction can split (too many of its vectors lie within the margin of
   each) is a group of near copies; it stays whole, since its links have to be counted.
4. Vectors are compared within leaves. A large leaf is dealt into chunks, and each pair of chunks is a task of
   its own. A pair that shares several leaves is counted in the least of them only, so link
   counts need no list of pairs: a task returns one count and one spanning link per vector.
5. Spanning links are joined to components.

Cosines are products of vectors in single precision; a pair near the threshold is decided in doubles.
The work in a group of m different vectors that are all linked is m * m / 2 comparisons, as their counts need.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths never link; rows are the nodes, so repeated ids are rows of their own; a null id
stays null; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written
from .topk import usable

TREES = 6
TRIES = 8
LEAF = 2048
CHUNK = 2048
SAMPLE = 4096
DEPTH = 6
MARGIN = 0.5  # of the deviation that the projections of two vectors at the threshold have
SPILL, SHRINK = 0.2, 0.8  # share of a node that may go to both sides: at the root, and from level to level
FULL = 0.4  # a direction with more than this share of a node within the margin splits nothing
NEAR = 1e-5


def near_vectors(vectors: DataFrame, threshold: float = 0.9, trees: int = TREES, seed: int = 0) -> DataFrame:
    """id, vector's n_links, component_id and kept of every row (vec_id, embedding)."""
    vector = F.col("embedding").cast("array<double>")
    some = usable(vector) & F.exists(vector, lambda x: x != 0)
    given = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.when(some, vector).otherwise(F.array()).alias("vector"))
    rows = written(given.mapInArrow(packed, "row long, vec_id long, size int, unit binary, digest binary"))
    classes = written(rows.filter("size > 0").groupBy("digest").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies")))
    nodes = rows.join(classes.select(F.col("node").alias("row"), "copies"), "row").select("row", "size", "unit", "copies")
    nodes = written(nodes)
    leaves = grow(nodes, threshold, trees, seed)
    found = written(compared(nodes, leaves, threshold))
    counts = found.groupBy(F.col("row").alias("node")).agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("row").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"id": "node", "component": "label"})
    placed = rows.select("row", "vec_id", "digest").join(classes, "digest", "left").join(counts, "node", "left").join(groups, "node", "left")
    links = F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("n", F.lit(0))
    placed = written(placed.select("vec_id", links.alias("n_links"), F.coalesce("label", "node", "row").alias("label")))
    least = placed.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    return placed.join(least, "label").select("vec_id", "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"))


def packed(batches):
    """Vectors as bytes of unit vectors and a digest of their components; empty vectors as nulls."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = batch.column("vector")
        sizes = np.diff(lists.offsets.to_numpy())
        data = lists.flatten().to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
        ends = np.cumsum(sizes)
        starts, n = (ends - sizes)[sizes > 0], sizes[sizes > 0]
        raw = [data[a : a + k] for a, k in zip(starts, n, strict=True)]
        digests = iter([hashlib.blake2b(x, digest_size=16).digest() for x in raw])
        if len(n):
            data = data / np.repeat(np.maximum.reduceat(np.abs(data), starts), n)  # so that squares neither vanish nor overflow
            data /= np.repeat(np.sqrt(np.add.reduceat(data * data, starts)), n)
        found = iter([data[a : a + k].tobytes() for a, k in zip(starts, n, strict=True)])
        columns = [batch.column("row"), batch.column("vec_id"), pa.array(sizes, pa.int32())]
        columns += [pa.array([next(x) if k else None for k in sizes], pa.binary()) for x in (found, digests)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "size", "unit", "digest"])


def direction(seed: int, tree: int, node: int, draw: int, size: int):
    """A random unit vector of a node; every task makes the same one."""
    import numpy as np

    drawn = np.random.default_rng([seed, tree, node, draw]).standard_normal(size)
    return drawn / np.linalg.norm(drawn)


def margin_of(threshold: float, size: int) -> float:
    return MARGIN * (max(0.0, 2 - 2 * threshold) / size) ** 0.5


def spill_at(node: int) -> float:
    """The share of a node that may go to both sides."""
    return SPILL * SHRINK ** (node.bit_length() - 1)


def units(packs):
    import numpy as np

    return np.frombuffer(b"".join(packs)).reshape(len(packs), -1)


KEYS = ["tree", "size", "node"]


def grow(nodes: DataFrame, threshold: float, trees: int, seed: int) -> DataFrame:
    """row and leaf (tree, size of the vectors, node) of every vector in every tree; with spill, several leaves per tree."""
    start = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    places = nodes.select("row", start.alias("tree"), "size", F.lit(1).cast("long").alias("node"), F.lit(False).alias("whole"))
    leaves = None
    while True:
        sizes = places.groupBy(KEYS).agg(F.count(F.lit(1)).alias("n"), F.bool_or("whole").alias("whole"))
        large = written(sizes.filter((F.col("n") > LEAF) & ~F.col("whole")).drop("whole"))
        if large.isEmpty():
            return (leaves.unionByName(places) if leaves else places).drop("whole")
        final = places.join(large, KEYS, "left_anti")
        leaves = leaves.unionByName(final) if leaves else final
        splits = written(_splits(nodes, places, large, threshold, seed))
        routed = places.join(large.drop("n"), KEYS, "left_semi").join(nodes.select("row", "unit"), "row").join(splits, KEYS, "left")
        places = written(routed.mapInPandas(_router(seed), "row long, tree int, size int, node long, whole boolean"))


def _splits(nodes: DataFrame, places: DataFrame, large: DataFrame, threshold: float, seed: int) -> DataFrame:
    """The splits of the next levels below each large node, in the order of the nodes: place (NaN: no further
    split), half width of the spill, and which direction."""

    def fit(key, frame):
        import numpy as np
        import pandas as pd

        tree, size, node = (int(x) for x in key)
        depth = int(min(DEPTH, np.ceil(np.log2(frame["n"].iloc[0] / LEAF)), np.floor(np.log2(max(2, len(frame) / 32)))))
        data, margin = units(frame["unit"]), margin_of(threshold, size)
        cuts, widths, draws = (np.full(2**depth - 1, np.nan) for _ in range(3))
        parts = {0: np.arange(len(data))}
        for i in range(len(cuts)):
            if i not in parts or len(parts[i]) < 2:
                continue
            below, part = node_below(node, i), parts.pop(i)
            at = data[part] @ np.stack([direction(seed, tree, below, t, size) for t in range(TRIES)], axis=1)
            middle = np.median(at, axis=0)
            off = np.abs(at - middle)
            near = (off < margin).mean(axis=0)
            t = int(near.argmin())
            left = at[:, t] < middle[t]
            if near[t] <= FULL and left.any():
                cuts[i], draws[i] = middle[t], t
                widths[i] = min(margin, np.quantile(off[:, t], spill_at(below)))
                parts[2 * i + 1], parts[2 * i + 2] = part[left], part[~left]
        return pd.DataFrame({"tree": [tree], "size": [size], "node": [node], "cuts": [cuts.tolist()], "widths": [widths.tolist()], "draws": [draws.tolist()]})

    share = F.lit(float(SAMPLE)) / F.col("n")
    drawn = F.pmod(F.xxhash64(F.lit(seed), "row", "tree", "node"), F.lit(1 << 30)) < share * (1 << 30)
    sample = places.join(large, KEYS).filter(drawn).join(nodes.select("row", "unit"), "row")
    return sample.groupBy(KEYS).applyInPandas(fit, "tree int, size int, node long, cuts array<double>, widths array<double>, draws array<double>")


def node_below(node: int, i: int) -> int:
    """Number in the whole tree of the i-th node (breadth first) of the subtree at ``node``."""
    level = (i + 1).bit_length() - 1
    return (node << level) + (i + 1 - (1 << level))


def _router(seed: int):
    def route(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            unknown = batch["cuts"].isna()  # no vector of the node was drawn
            yield batch.loc[unknown, ["row", "tree", "size", "node"]].assign(whole=True)
            for (tree, size, node), part in batch[~unknown].groupby(KEYS):
                data, row = units(part["unit"]), part["row"].to_numpy()
                cuts, widths, draws = (np.array(part[c].iloc[0]) for c in ("cuts", "widths", "draws"))
                parts = {0: np.arange(len(data))}
                for i in range(2 * len(cuts) + 1):
                    at = parts.pop(i, None)
                    if at is None or not len(at):
                        continue
                    below = node_below(int(node), i)
                    if i < len(cuts) and not np.isnan(cuts[i]):
                        place = data[at] @ direction(seed, int(tree), below, int(draws[i]), int(size))
                        parts[2 * i + 1], parts[2 * i + 2] = at[place < cuts[i] + widths[i]], at[place >= cuts[i] - widths[i]]
                    else:
                        yield pd.DataFrame({"row": row[at], "tree": tree, "size": size, "node": below, "whole": i < len(cuts)})

    return route


def compared(nodes: DataFrame, leaves: DataFrame, threshold: float) -> DataFrame:
    """row, n (its links counted here) and root (least row of its links here) for each task's vectors with links."""
    code = F.shiftleft(F.col("tree").cast("long"), 56) + F.col("node")
    leaves = leaves.select("row", "size", code.alias("leaf"))
    sizes = leaves.groupBy("size", "leaf").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.lit(1)).cast("long").alias("chunks"))
    own = leaves.groupBy("row").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))  # a few per tree
    placed = leaves.join(written(sizes.filter("chunks > 2")), ["size", "leaf"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("row"), F.col("chunks"))
    cells = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    cells = cells.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).drop("other", "chunks")
    dealt = nodes.select("row", "unit", "copies").join(own, "row").join(cells, "row")

    def pairs_of(data, single, a, b, same):
        import numpy as np

        near = single[a] @ single[b].T
        if same:
            near[np.tril_indices(len(a))] = -2
        i, j = np.nonzero(near >= threshold - NEAR)
        doubt = near[i, j] < threshold + NEAR
        exact = np.einsum("ij,ij->i", data[a[i[doubt]]], data[b[j[doubt]]]) >= threshold
        good = np.ones(len(i), bool)
        good[doubt] = exact
        return a[i[good]], b[j[good]]

    def cell(key, frame):
        import numpy as np
        import pandas as pd

        leaf, low, high = key[1], key[2], key[3]
        data, row, mine, copies = units(frame["unit"]), *(frame[c].to_numpy() for c in ("row", "mine", "copies"))
        single = data.astype(np.float32)
        lists = padded(frame["leaves"])
        left, right = (np.flatnonzero(mine == low), np.flatnonzero(mine == high))
        count, root = np.zeros(len(row), np.int64), np.arange(len(row))
        links = []
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            i, j = pairs_of(data, single, some, left[at:] if low == high else right, low == high)
            links.append((i, j))
            first = ~shares_earlier(lists, i, j, leaf)
            np.add.at(count, i[first], copies[j[first]])
            np.add.at(count, j[first], copies[i[first]])
        order = np.argsort(row)  # roots are least rows
        rank = np.empty_like(order)
        rank[order] = np.arange(len(row))
        root, linked = rank.copy(), np.zeros(len(row), bool)
        for i, j in links:
            linked[i] = linked[j] = True
        changed = True
        while changed:
            before = root.copy()
            for i, j in links:
                np.minimum.at(root, i, root[j])
                np.minimum.at(root, j, root[i])
            root = np.minimum(root, root[order[root]])
            changed = bool((before != root).any())
        return pd.DataFrame({"row": row[linked], "n": count[linked], "root": row[order[root]][linked]})

    return dealt.groupBy("size", "leaf", "low", "high").applyInPandas(cell, "row long, n long, root long")


def padded(lists):
    import numpy as np

    out = np.full((len(lists), max(map(len, lists), default=0)), -1, np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def shares_earlier(lists, i, j, leaf: int):
    """Whether two vectors share a leaf with a smaller code than this one."""
    import numpy as np

    found = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        a, b = lists[i[at : at + (1 << 16)]], lists[j[at : at + (1 << 16)]]
        part = np.zeros(len(a), bool)
        for k in range(a.shape[1]):
            known = (a[:, k] >= 0) & (a[:, k] < leaf)
            if known.any():
                part |= known & (a[:, k : k + 1] == b).any(axis=1)
        found[at : at + (1 << 16)] = part
    return found
