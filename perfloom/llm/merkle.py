"""Merkle manifest of a table: hash trees per group and over the groups, with proofs by pointer jumping.

1. Rows become leaves. A range sort numbers the leaves of each group (`lang`) without a gap, so a group with a third of
   all rows is spread over many tasks.
2. Trees grow `LEVELS` levels at a time: runs of 2^`LEVELS` consecutive nodes meet, their subtrees are hashed, and the
   top of each goes into the next pass. Every node keeps its own step: the sibling's digest and side.
3. Pointer jumping: a node holds the segment of steps towards its ancestor one level up, then a self-join with that
   ancestor's segment gives the segment two levels up, then four, and so on, until the leaves reach the top. Only nodes
   whose level is a multiple of the distance are needed later, so a round is little more than a row per leaf. The
   ancestors' side is sent to all tasks where its bytes are few, which is where many leaves share an ancestor.
4. The tops of the groups are the leaves of one more tree, by the same steps; a proof is the leaf's segment
   and its group's.

A digest is the lower-case hex SHA-256 of its inputs' concatenation, digests as hex text. A node without
a neighbour is hashed alone. A step is one byte for the side (0: no sibling, 1: left, 2: right) and the sibling's 32 bytes.

Cases: null values have a mark of their own, so null and empty text differ; null groups form a group that comes first;
within a group null doc_ids come first, then ascending ids, rows with equal ids by leaf; rows that are alike in all
fields are leaves of their own; a table of one row has an empty proof, and its root is its leaf; an empty table gives no
rows; long texts are hashed whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.series import dense_index
from .storage import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 8
STEP = 33
SENT_BYTES = 32 << 20
NODE, CARRIED, TOP = 0, 1, 2
NODES = "part string, size long, level int, place long, kind int, step binary, digest string"


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: each field's length in bytes and value, or a mark for null."""
    shown = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in shown]), 256)


def joined_digest(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def manifest(rows: DataFrame, group: str = "lang", key: str = "doc_id", digest: str = "leaf", keep: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (``group``, ``key``, ``digest``) with subroot, root and proof: the steps from the leaf to the root.

    Columns of ``keep`` stay beside them.
    """
    part = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))  # orders like the group, null first
    leaves = rows.select(part.alias("part"), F.col(key).alias("id"), F.col(digest).alias("digest"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    # Alike rows are interchangeable; their number in the input keeps a range of them from falling into one task.
    leaves = written(dense_index(leaves.withColumn("again", F.monotonically_increasing_id()), ("part",), ("id", "digest", "again"), "place", "size"))
    shown = [F.col("id").alias(key), F.col("digest").alias(digest), *[F.col(f"kept_{c}").alias(c) for c in keep]]
    columns = [*shown, "subroot", "root", "proof"]
    empty = leaves.withColumns({"subroot": F.lit(""), "root": F.lit(""), "proof": F.lit(b"")}).select(*columns)
    if leaves.isEmpty():
        return empty
    segments, tops = proofs(leaves.select("part", "size", "place", "digest"))
    above = dense_index(tops.select(F.lit("").alias("part"), F.col("part").alias("of"), "digest"), ("part",), ("of",), "place", "size")
    above = written(above)
    upper, roots = proofs(above.select("part", "size", "place", "digest"))
    groups = above.join(upper.drop("part"), "place").select(F.col("of").alias("part"), F.col("digest").alias("subroot"), F.col("segment").alias("upper"))
    root = roots.first()["digest"]
    return (
        leaves.join(segments, ["part", "place"]).join(_side(written(groups), 256), "part")
        .withColumns({"root": F.lit(root), "proof": F.concat("segment", "upper")}).select(*columns)
    )


def proofs(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves``: part, size (leaves of the part), place (from 0), digest. The segment of each leaf to its part's top
    (part, place, segment), and the tops (part, digest)."""
    nodes, height = grown(leaves)
    tops = written(nodes.filter(F.col("kind") == TOP).select("part", "digest"))
    held = nodes.select("part", "level", "place", F.col("step").alias("segment"))
    distance = 1
    while distance < height:
        held = written(_jump(held, distance))
        distance *= 2
    return held.filter("level = 0").select("part", "place", "segment"), tops


def _jump(held: DataFrame, distance: int) -> DataFrame:
    """Segments over twice the distance, of the nodes that later rounds need."""
    from_, to = held.filter(F.col("level") % (2 * distance) == 0), held.filter(F.col("level") % (2 * distance) == distance)
    to = to.select("part", (F.col("level") - distance).alias("level"), F.col("place").alias("ancestor"), F.col("segment").alias("more"))
    from_ = from_.withColumn("ancestor", F.shiftright("place", distance) if distance < 63 else F.lit(0).cast("long"))
    both = from_.join(_side(to, distance * STEP), ["part", "level", "ancestor"], "left")
    return both.select("part", "level", "place", F.concat("segment", F.coalesce("more", F.lit(b""))).alias("segment"))


def _side(rows: DataFrame, bytes_each: int) -> DataFrame:
    """A side of a join, sent to all tasks if its bytes are few."""
    return F.broadcast(rows) if rows.count() * (bytes_each + 64) <= SENT_BYTES else rows.hint("merge")


def grown(leaves: DataFrame) -> tuple[DataFrame, int]:
    """All nodes of the parts' trees, and the height of the highest."""
    most = leaves.agg(F.max("size")).first()[0]
    height = (most - 1).bit_length()
    level = leaves.select("part", "size", "place", "digest")
    tables = []
    for base in range(0, height + 1, LEVELS):
        run = F.struct("place", "digest")
        runs = level.groupBy("part", F.shiftright("place", LEVELS).alias("run")).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(run)).alias("nodes"))
        runs = runs.select("part", "run", "size", F.col("nodes.digest").alias("digests"))
        tables.append(written(runs.mapInArrow(_subtrees(base), NODES)))
        level = tables[-1].filter(F.col("kind") == CARRIED).select("part", "size", "place", "digest")
    nodes = tables[0]
    for table in tables[1:]:
        nodes = nodes.unionByName(table)
    return nodes.filter(F.col("kind") != CARRIED), height


def _subtrees(base: int):
    """Nodes of `LEVELS` levels above each run of consecutive nodes of level ``base``."""

    def subtree(part, run, size, digests, add):
        place = run << LEVELS
        for level in range(base, base + LEVELS):
            if -(-size // (1 << level)) == 1:
                add((part, size, level, 0, TOP, b"", digests[0]))
                return
            for j in range(len(digests)):
                other = digests[j ^ 1] if j ^ 1 < len(digests) else None
                step = bytes(STEP) if other is None else (b"\1" if j & 1 else b"\2") + bytes.fromhex(other)
                add((part, size, level, place + j, NODE, step, None))
            digests = [joined_digest(*digests[j : j + 2]) for j in range(0, len(digests), 2)]
            place >>= 1
        add((part, size, base + LEVELS, place, CARRIED, None, digests[0]))

    def grow(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
        names = [c.split()[0] for c in NODES.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                subtree(r["part"], r["run"], r["size"], r["digests"], rows.append)
                if len(rows) > 50_000:
                    yield batch_of(rows)
                    rows.clear()
            if rows:
                yield batch_of(rows)

    return grow


def steps(proof: bytes) -> list[tuple[int, str]]:
    """Side and sibling of each step."""
    return [(proof[at], proof[at + 1 : at + STEP].hex()) for at in range(0, len(proof), STEP)]


def folded(leaf: str, proof: bytes) -> str:
    """The root that a leaf and its proof give."""
    for side, sibling in steps(proof):
        leaf = joined_digest(leaf) if side == 0 else joined_digest(sibling, leaf) if side == 1 else joined_digest(leaf, sibling)
    return leaf


def verified(rows: DataFrame, leaf: str) -> DataFrame:
    """``rows`` of `manifest` with proof_sha256 (digest of all siblings) and folded_root, the root that ``leaf`` and the proof give."""

    def fold(batches):
        import pyarrow as pa

        for batch in batches:
            found = list(zip(batch[leaf].to_pylist(), batch["proof"].to_pylist(), strict=True))
            siblings = [joined_digest(*(s for side, s in steps(p) if side)) for _, p in found]
            added = [pa.array(siblings, pa.string()), pa.array([folded(x, p) for x, p in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "proof_sha256", "folded_root"])

    shape = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(fold, f"{shape}, proof_sha256 string, folded_root string")
