"""Ordered-series primitives that stay parallel inside one long run.

A plain ``Window.partitionBy("run_id")`` puts a whole run into one task. Here a series gets a
dense index from a range sort (`dense_index`), and all later work is keyed by
``(run, chunk of the index)``: every group has at most ``CHUNK`` rows however long the run is.
What has to cross a chunk border is either a few copied border rows (`with_neighbours`) or one
row per chunk (`prefix_sums`, `merge_intervals`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.session import written

CHUNK = 1 << 16
SPAN_BIN = 64
CROWD_ROWS = 65536  # points of one time bin that one task joins
BIN_BITS = 10
CUTS = 4096
FEW = 1 << 17
MIN_NORMAL = 2.2250738585072014e-308
RUN = ("run_id",)


def dense_index(
    df: DataFrame,
    keys: Sequence[str] = RUN,
    order: Sequence[str] = ("rel_seconds", "row_ord"),
    name: str = "idx",
    size: str | None = None,
) -> DataFrame:
    """Add a 0-based position of each row among the rows of its key (and the key's row count).

    One range sort spreads the rows evenly whatever the key sizes are. The sorted rows are
    written out with their place, because range borders are sampled and may differ when a lost
    task is recomputed. The per-(key, partition) offsets are one row per key plus one per
    partition; as a written table they are broadcast only if their files are small enough.
    """
    placed = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = written(placed)
    part = F.shiftright(F.col("_at"), 33)
    pos = F.col("_at").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumns({"_part": part, "_pos": pos}).drop("_at")
    pieces = placed.groupBy(*keys, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    w = W.partitionBy(*keys)
    before = F.sum("_n").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    shift = pieces.select(
        *keys, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
        *([F.sum("_n").over(w).alias(size)] if size else []),
    )
    return (
        placed.join(written(shift), [*keys, "_part"])
        .withColumn(name, F.col("_pos") + F.col("_shift"))
        .drop("_part", "_pos", "_shift")
    )


def indexed(df: DataFrame, keys: Sequence[str] = RUN, columns: Sequence[str] | None = None, size: str | None = None) -> DataFrame:
    """``df`` with ``idx``; an index that is already there is kept, else only ``columns`` are sorted and written."""
    if "idx" in df.columns:
        return df
    own = df if columns is None else df.select(*dict.fromkeys([*keys, "rel_seconds", "row_ord", *columns]))
    return dense_index(own, keys, size=size)


def chunk_of(idx: Column | str) -> Column:
    c = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(c / CHUNK)


def with_neighbours(
    df: DataFrame,
    columns: dict,
    keys: Sequence[str] = RUN,
    back: int = 1,
    ahead: int = 0,
) -> DataFrame:
    """Window columns that look at most ``back`` / ``ahead`` rows away.

    ``columns`` maps a name to ``f(window)``. A row is copied into every chunk that has a row at
    most ``back`` after it or ``ahead`` before it, so each chunk is complete alone.
    """
    home = chunk_of("idx")
    first = F.greatest(chunk_of(F.col("idx") - ahead), F.lit(0))
    spread = df.withColumn("_chunk", F.explode(F.sequence(first, chunk_of(F.col("idx") + back))))
    w = W.partitionBy(*keys, "_chunk").orderBy("idx")
    out = spread.withColumns({n: f(w) for n, f in columns.items()})
    return out.filter(F.col("_chunk") == home).drop("_chunk")


def prefix_sums(df: DataFrame, columns: dict[str, Column], keys: Sequence[str] = RUN) -> DataFrame:
    """Running totals along ``idx``: local ones per chunk plus the total of the chunks before."""
    d = df.withColumns({"_chunk": chunk_of("idx"), **{f"_v_{n}": c for n, c in columns.items()}})
    totals = d.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in columns]
    )
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_chunk", *[F.sum(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in columns]
    )
    local = W.partitionBy(*keys, "_chunk").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    out = d.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(local) for n in columns})
    out = out.join(carry, [*keys, "_chunk"])
    zero = F.lit(0)
    return out.select(
        *df.columns,
        *[
            (F.coalesce(f"_l_{n}", zero) + F.coalesce(f"_c_{n}", zero)).alias(n)
            for n in columns
        ],
    )


# --- windows of a series -------------------------------------------------------------------


def merge_intervals(
    df: DataFrame, gap: Column | int, keys: Sequence[str] = RUN
) -> DataFrame:
    """Join disjoint ``[start_idx, end_idx]`` intervals whose distance is at most ``gap``.

    First inside each chunk; then only the first and last interval of every chunk can still
    grow, so the run-wide step sees two rows per chunk.
    """
    d = df.select(
        *keys, "start_idx", "end_idx",
        (F.lit(gap) if isinstance(gap, int) else gap).alias("_gap"),
        chunk_of("start_idx").alias("_chunk"),
    )
    group = [*keys, "_gap"]

    def joined(part: DataFrame, by: list[str]) -> DataFrame:
        w = W.partitionBy(*by).orderBy("start_idx")
        far = F.col("start_idx") - F.lag("end_idx").over(w) > F.col("_gap")
        part = part.withColumn("_new", F.when(F.coalesce(far, F.lit(True)), 1).otherwise(0))
        part = part.withColumn("_grp", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        return part.groupBy(*by, "_grp").agg(
            F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")
        )

    local = joined(d, [*group, "_chunk"])
    last = F.max("_grp").over(W.partitionBy(*group, "_chunk"))
    local = local.withColumn("_edge", (F.col("_grp") == 1) | (F.col("_grp") == last)).drop("_grp")
    cols = [*keys, "start_idx", "end_idx"]
    inner = local.filter(~F.col("_edge")).select(*cols)
    edges = joined(local.filter("_edge"), group).select(*cols)
    return inner.unionByName(edges)


def islands(df: DataFrame, flag: Column, keys: Sequence[str] = RUN, gap: Column | int = 1) -> DataFrame:
    """Maximal stretches of flagged rows (``gap`` > 1 also bridges short holes)."""
    points = df.filter(flag).withColumns({"start_idx": F.col("idx"), "end_idx": F.col("idx")})
    return merge_intervals(points, gap, keys)


def sustained_windows(
    df: DataFrame, col: Column | str, threshold: Column | float, min_samples: Column | int,
    keys: Sequence[str] = RUN,
) -> DataFrame:
    """Stretches of at least ``min_samples`` consecutive values >= ``threshold``; null breaks one."""
    value = F.col(col) if isinstance(col, str) else col
    found = islands(df, value >= threshold, keys)
    return found.filter(F.col("end_idx") - F.col("start_idx") + 1 >= min_samples)


def merge_windows(windows: DataFrame, gap: Column | int, keys: Sequence[str] = RUN) -> DataFrame:
    return merge_intervals(windows, gap, keys)


def rows_in_windows(
    rows: DataFrame, windows: DataFrame, keys: Sequence[str] = RUN
) -> DataFrame:
    """Pair every row with the windows whose index range holds it.

    Equality join on (key, 64-row bin) followed by the exact test: a bin has at most 64 rows.
    """
    binned = windows.withColumn(
        "_bin",
        F.explode(F.sequence(F.floor(F.col("start_idx") / SPAN_BIN), F.floor(F.col("end_idx") / SPAN_BIN))),
    )
    points = rows.withColumn("_bin", F.floor(F.col("idx") / SPAN_BIN))
    return (
        points.join(binned, [*keys, "_bin"])
        .filter(F.col("idx").between(F.col("start_idx"), F.col("end_idx")))
        .drop("_bin")
    )


def crowded_bins(times: DataFrame, at: str, bin_seconds: float, part_rows: int) -> DataFrame:
    """run_id, _bin and _salts of the time bins with more than ``part_rows`` rows, from a histogram of the times."""
    bins = times.filter(F.col(at).isNotNull()).select("run_id", F.floor(F.col(at) / F.lit(float(bin_seconds))).alias("_bin"))
    counts = bins.groupBy("run_id", "_bin").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > part_rows)
    return counts.select("run_id", "_bin", F.ceil(F.col("_n") / part_rows).cast("int").alias("_salts"))


def time_range_join(
    points: DataFrame,
    intervals: DataFrame,
    lo: str,
    hi: str,
    at: str = "rel_seconds",
    bin_seconds: float = 60.0,
    part_rows: int = CROWD_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Pair points with the intervals ``[lo, hi]`` of the same run that hold them.

    Intervals are cut into time bins; a point lies in one bin, so a pair appears once. A bin of more than
    ``part_rows`` points is spread over as many salts as its points need (the intervals, far fewer, are repeated).
    How many it has is told by a histogram of ``counted``, by default the points: any table of cheaper rows
    (run_id and ``at``) that has at least as many of them in each bin.
    """
    width = F.lit(float(bin_seconds))
    crowded = written(crowded_bins(points if counted is None else counted, at, bin_seconds, part_rows))
    place = ["run_id", "_bin"]
    salts = F.coalesce("_salts", F.lit(1))
    cut = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    cut = cut.join(crowded, place, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    spread = points.filter(F.col(at).isNotNull()).withColumn("_hash", F.xxhash64(*points.columns)).withColumn("_bin", F.floor(F.col(at) / width))
    spread = spread.join(crowded, place, "left").withColumn("_salt", F.pmod("_hash", salts).cast("int")).drop("_salts", "_hash")
    return spread.join(cut, [*place, "_salt"]).filter(F.col(at).between(F.col(lo), F.col(hi))).drop("_bin", "_salt")


# --- statistics ----------------------------------------------------------------------------


def value_bin(v: Column) -> Column:
    """A number that never falls when the value rises: the sign and the binary logarithm in steps of 2 ** -`BIN_BITS`.

    The logarithm never falls when its argument rises. It stands in the expression once, as Spark writes out what a
    column is made of wherever it is used, and a long expression is not compiled.
    """
    size = F.abs(v)
    steps = F.floor(F.log2(size) * (1 << BIN_BITS)) + (1100 << BIN_BITS)
    far = F.lit(1 << 40)
    code = F.when(size == float("inf"), far).when(size < MIN_NORMAL, F.lit(1)).otherwise(steps)
    return F.when(F.isnan(v), far + 1).when(v == 0, F.lit(0)).when(v > 0, code).otherwise(-code).cast("bigint")


def percentile_linear(df: DataFrame, col: str, p: float, keys: Sequence[str] = RUN, name: str = "p") -> DataFrame:
    """Exact percentile with linear interpolation at ``(n-1)*p``, one row per key.

    Values are counted in bins that depend on the value alone, so the counts are formed before the shuffle and no row
    is sent by its key. The counts tell which bins hold the two wanted ranks and how many values are below. While such a bin
    holds more than `FEW` unequal values, it is cut into `CUTS` equal parts between its least and largest value and
    counted again. What remains is ordered. Ranks always lie in the chosen bins, as all counts are exact.
    """
    d = df.select(*keys, F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull()).withColumn("_bin", value_bin(F.col("_v")))
    counts = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    bins = d.groupBy(*keys, "_bin").agg(*counts)
    all_of = W.partitionBy(*keys)
    n = F.sum("_c").over(all_of)
    place = (n - 1) * F.lit(p)
    bins = bins.withColumns({"_upto": F.sum("_c").over(all_of.orderBy("_bin")), "_k": place})
    low, high = F.floor(F.col("_k")), F.ceil(F.col("_k"))
    holds = (F.col("_upto") > low) & (F.col("_upto") - F.col("_c") <= high)
    chosen = written(bins.filter(holds).withColumn("_below", F.col("_upto") - F.col("_c")).drop("_upto"))
    in_range = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    while chosen.filter((F.col("_c") > FEW) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        marks = chosen.drop("_c")
        part = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CUTS)
        part = F.when(F.col("_lo") < F.col("_hi"), part).otherwise(0)
        found = d.join(marks, [*keys, "_bin"]).filter(in_range).groupBy(*keys, "_bin", "_k", "_below", part.alias("_part")).agg(*counts)
        upto = F.col("_below") + F.sum("_c").over(W.partitionBy(*keys, "_bin", "_below").orderBy("_part"))
        found = found.withColumn("_upto", upto).filter(holds)
        chosen = written(found.withColumn("_below", F.col("_upto") - F.col("_c")).drop("_upto", "_part"))
    near = d.join(chosen.drop("_c"), [*keys, "_bin"]).filter(in_range).groupBy(*keys, "_bin", "_k", "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = near.withColumn("_upto", F.col("_below") + F.sum("_c").over(W.partitionBy(*keys, "_bin", "_below").orderBy("_v")))
    picked = ranked.groupBy(*keys, "_k").agg(
        F.min(F.when(F.col("_upto") > low, F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > high, F.col("_v"))).alias("_b"),
    )
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_k") - low))
    return picked.select(*keys, value.alias(name))


def moving_average(df: DataFrame, col: str, window: int, keys: Sequence[str] = RUN, name: str = "smooth") -> DataFrame:
    """Trailing mean over up to ``window`` rows.

    The frame is summed for each row; for windows of many thousand rows `grouped_moving_averages` costs less.
    """
    back = max(window - 1, 0)
    return with_neighbours(
        df, {name: lambda w: F.avg(col).over(w.rowsBetween(-back, 0))}, keys, back=back
    )


def grouped_moving_averages(
    df: DataFrame, columns: Sequence[str], window_col: str, size_col: str, keys: Sequence[str] = RUN
) -> DataFrame:
    """Trailing means of several columns whose length differs per key: ``smooth_<c>``, the one of the row before
    (``prev_<c>``) and the last one of the series (``end_<c>``).

    A mean is the difference of two running totals. A row sends its totals to its own position and to the position one
    window later (where they are subtracted), with the usual copies for the next chunk, so one shuffle serves
    the differences and the look back of all columns. What a chunk needs of the chunks before, and of the end
    of the series, comes with one row per chunk.
    """
    d = df.withColumn("_chunk", chunk_of("idx"))
    tail = F.col("idx") >= F.col(size_col) - F.col(window_col)
    totals = d.groupBy(*keys, "_chunk").agg(
        *[F.sum(c).alias(f"_t_{c}") for c in columns], *[F.sum(F.when(tail, F.col(c))).alias(f"_e_{c}") for c in columns]
    )
    all_of = W.partitionBy(*keys)
    earlier = all_of.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_c_{c}") for c in columns],
        *[F.sum(f"_e_{c}").over(all_of).alias(f"_e_{c}") for c in columns],
    )
    local = W.partitionBy(*keys, "_chunk").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    rows = d.withColumns({f"_l_{c}": F.sum(c).over(local) for c in columns}).join(carry, [*keys, "_chunk"])
    rows = rows.withColumns({
        **{f"_sum_{c}": F.col(f"_l_{c}") + F.col(f"_c_{c}") for c in columns},
        **{f"end_{c}": F.col(f"_e_{c}") / F.least(F.col(size_col), F.col(window_col)) for c in columns},
    }).drop("_chunk", *[f"_{k}_{c}" for c in columns for k in "lce"])
    later = F.col("idx") + F.col(window_col)
    send = F.array(
        F.struct(F.col("idx").alias("_to"), F.lit(1).alias("_own")),
        F.when(later < F.col(size_col), F.struct(later.alias("_to"), F.lit(0).alias("_own"))),
    )
    sent = rows.withColumn("_s", F.explode(F.array_compact(send))).select("*", "_s._to", "_s._own").drop("_s")
    home = chunk_of("_to")
    next_too = F.when(F.col("_to") % CHUNK == CHUNK - 1, home + 1)
    sent = sent.withColumn("_chunk", F.explode(F.array_compact(F.array(home, next_too))))
    by = W.partitionBy(*keys, "_chunk")
    w = by.orderBy("_to", "_own")
    same = F.lag("_to").over(w) == F.col("_to")
    paired = sent.withColumns({f"_older_{c}": F.when(same, F.lag(f"_sum_{c}").over(w)).otherwise(F.lit(0)) for c in columns}).filter(F.col("_own") == 1)
    length = F.least(F.col("idx") + 1, F.col(window_col))
    smooth = paired.withColumns({f"smooth_{c}": (F.col(f"_sum_{c}") - F.col(f"_older_{c}")) / length for c in columns})
    smooth = smooth.withColumns({f"prev_{c}": F.lag(f"smooth_{c}").over(by.orderBy("_to")) for c in columns})
    return smooth.filter(F.col("_chunk") == home).drop("_to", "_own", "_chunk", *[f"_{k}_{c}" for c in columns for k in ("sum", "older")])


def r2(y: str, x: str) -> Column:
    """Coefficient of determination; 0 when x or y does not vary."""
    return F.when(F.var_pop(y) == 0, F.lit(0.0)).otherwise(
        F.greatest(F.coalesce(F.regr_r2(y, x), F.lit(0.0)), F.lit(0.0))
    )


def monotonic_ratio(df: DataFrame, col: str, keys: Sequence[str] = RUN, name: str = "monotonic_ratio") -> DataFrame:
    """Share of neighbouring pairs that do not fall; 0 for fewer than two rows."""
    d = with_neighbours(df, {"_prev": lambda w: F.lag(col).over(w)}, keys)
    rises = F.avg(F.when(F.col("idx") > 0, (F.col(col) >= F.col("_prev")).cast("double")))
    return d.groupBy(*keys).agg(F.coalesce(rises, F.lit(0.0)).alias(name))


def plateau_fraction(
    df: DataFrame, col: str, keys: Sequence[str] = RUN, tolerance: float = 0.02, name: str = "plateau_fraction"
) -> DataFrame:
    """Share of the series, from the end, that stays within ``tolerance`` of the last value.

    A row per chunk has its least and largest value; only rows of the last chunk that leaves the band are looked at again.
    """
    chunks = df.groupBy(*keys, chunk_of("idx").alias("_chunk")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(col).alias("_least"), F.max(col).alias("_most"), F.max_by(col, "idx").alias("_end")
    )
    chunks = written(chunks)
    ends = chunks.groupBy(*keys).agg(F.sum("_rows").alias("_n"), F.max_by("_end", "_chunk").alias("_last"))
    outside = lambda v: F.abs(v - F.col("_last")) > F.abs(F.col("_last")) * tolerance
    leaves = chunks.join(ends, [*keys]).withColumn("_out", outside(F.col("_least")) | outside(F.col("_most")))
    last = written(leaves.groupBy(*keys, "_n", "_last").agg(F.max(F.when(F.col("_out"), F.col("_chunk"))).alias("_chunk")))
    rows = df.select(*keys, "idx", F.col(col).alias("_v"), chunk_of("idx").alias("_chunk")).join(last.drop("_n"), [*keys, "_chunk"])
    out = rows.filter(outside(F.col("_v"))).groupBy(*keys).agg(F.max("idx").alias("_at"))
    share = (F.col("_n") - 1 - F.coalesce("_at", F.lit(-1))) / F.col("_n")
    usable = (F.col("_n") >= 2) & (F.col("_last") > 0)
    return last.join(out, [*keys], "left").select(*keys, F.when(usable, share).otherwise(0.0).alias(name))


def clip(col: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """Rank rows within ``by``; the group limit runs before the shuffle, so a hot group is cut early."""
    out = df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.filter(F.col(rank) <= k)
