"""Hand-worked vectors and properties of the series primitives, with tiny chunks."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perfloom.operators import series
from perfloom.operators.trends import grade_confidence


@pytest.fixture(autouse=True, params=[4, 1 << 16])
def chunk(request, monkeypatch):
    monkeypatch.setattr(series, "CHUNK", request.param)


def make(spark, values, run="r"):
    rows = [(run, i, float(i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id string, row_ord long, rel_seconds double, v double")


def spans(df):
    return sorted((r.start_idx, r.end_idx) for r in df.collect())


def brute_islands(values, thr, least):
    out, start = [], None
    for i, v in enumerate([*values, None]):
        if v is not None and v >= thr:
            start = i if start is None else start
        else:
            if start is not None and i - start >= least:
                out.append((start, i - 1))
            start = None
    return out


def brute_merge(windows, gap):
    out = []
    for s, e in windows:
        if out and s - out[-1][1] <= gap:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def test_sustained_and_merge(spark):
    d = series.dense_index(make(spark, [90, 90, 90, 10, 90, 90, 90]))
    found = series.sustained_windows(d, "v", 85, 3)
    assert spans(found) == [(0, 2), (4, 6)]
    assert spans(series.merge_windows(found, 3)) == [(0, 6)]
    d = series.dense_index(make(spark, [90, 90, 90, 10, 90, 90]))
    found = series.sustained_windows(d, "v", 85, 3)
    assert spans(series.merge_windows(found, 3)) == [(0, 2)]


def test_islands_across_chunks(spark):
    rng = random.Random(7)
    values = [None if rng.random() < 0.05 else rng.choice([10.0, 90.0, 90.0, 90.0]) for _ in range(120)]
    d = series.dense_index(make(spark, values).repartition(5))
    for least, gap in ((1, 1), (3, 3), (5, 6)):
        want = brute_islands(values, 85, least)
        found = series.sustained_windows(d, "v", 85, least)
        assert spans(found) == want
        merged = series.merge_windows(found, gap)
        assert spans(merged) == brute_merge(want, gap)
        assert spans(series.merge_windows(merged, gap)) == brute_merge(want, gap)


def test_index_with_one_large_and_many_small_runs(spark):
    rows = [("big", i, float(i % 50), 0.0) for i in range(300)] + [(f"r{i % 7}", i, float(i), 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "run_id string, row_ord long, rel_seconds double, v double").repartition(6)
    got = series.dense_index(df, size="n").collect()
    for run in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.run_id == run), key=lambda r: (r.rel_seconds, r.row_ord))
        assert [r.idx for r in mine] == list(range(len(mine)))
        assert {r.n for r in mine} == {len(mine)}


def test_prefix_and_averages(spark):
    rng = random.Random(3)
    values = [float(rng.randrange(100)) for _ in range(41)]
    d = series.dense_index(make(spark, values)).withColumns({"w": F.lit(7).cast("bigint"), "n": F.lit(41).cast("bigint")})
    d = d.withColumn("v", F.col("v").cast("bigint"))
    got = {r.idx: r.s for r in series.prefix_sums(d, {"s": F.col("v")}).collect()}
    assert [got[i] for i in range(41)] == [sum(values[: i + 1]) for i in range(41)]
    want = [sum(values[max(0, i - 6): i + 1]) / min(i + 1, 7) for i in range(41)]
    d = d.withColumn("u", F.col("v") * 3 + 1)
    got = {r.idx: r for r in series.grouped_moving_averages(d, ["v", "u"], "w", "n").collect()}
    assert [got[i].smooth_v for i in range(41)] == pytest.approx(want)
    assert [got[i].smooth_u for i in range(41)] == pytest.approx([3 * x + 1 for x in want])
    assert got[0].prev_v is None and {r.end_v for r in got.values()} == {got[40].smooth_v}
    assert [got[i].prev_v for i in range(1, 41)] == pytest.approx(want[:-1])
    assert len(got) == 41
    if series.CHUNK > 4:
        got = {r.idx: r.smooth for r in series.moving_average(d, "v", 7).collect()}
        assert [got[i] for i in range(41)] == pytest.approx(want)


def test_moving_average_vector(spark):
    d = series.dense_index(make(spark, [1, 2, 3, 4]))
    got = [r.smooth for r in series.moving_average(d, "v", 2).orderBy("idx").collect()]
    assert got == [1, 1.5, 2.5, 3.5]


def test_monotonic_and_plateau(spark):
    one = lambda df: df.collect()[0][1]
    d = series.dense_index(make(spark, [1, 2, 2, 1]))
    assert one(series.monotonic_ratio(d, "v")) == pytest.approx(2 / 3)
    d = series.dense_index(make(spark, [1, 2, 3, 100, 100, 101]))
    assert one(series.plateau_fraction(d, "v")) == 0.5
    d = series.dense_index(make(spark, [5, 3, 0]))
    assert one(series.plateau_fraction(d, "v")) == 0


def test_percentile(spark):
    assert series.percentile_linear(make(spark, [1, 2, 4, 10]), "v", 0.95).collect()[0].p == pytest.approx(9.1)
    rng = random.Random(1)
    values = [float(rng.randrange(500)) for _ in range(4000)]
    want = sorted(values)
    df = make(spark, values).repartition(4)
    for p in (0.0, 0.5, 0.95, 1.0):
        k = (len(want) - 1) * p
        lo = int(k)
        hi = min(lo + 1, len(want) - 1)
        expected = want[lo] + (want[hi] - want[lo]) * (k - lo)
        assert series.percentile_linear(df, "v", p).collect()[0].p == pytest.approx(expected)


def test_slope_and_fit(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    r = df.agg(F.regr_slope("y", "x").alias("s"), series.r2("y", "x").alias("r")).collect()[0]
    assert (r.s, r.r) == (0, 0)
    df = spark.createDataFrame([(1.0, 5.0), (1.0, 6.0)], "x double, y double")
    assert df.agg(F.regr_slope("y", "x")).collect()[0][0] is None


@pytest.mark.parametrize("r2,mono,plateau,ratio,growth,want", [
    (0.35, 0.9, 0.1, 12, 0.6, "likely"),
    (0.2, 0.9, 0.1, 12, 0.6, "suspicious"),
    (0.9, 0.58, 0.1, 12, 0.6, "suspicious"),
    (0.9, 0.9, 0.1, 12, 0.6, "strong evidence"),
    (0.9, 0.9, 0.1, 12, 0.3, "likely"),
    (0.9, 0.9, 0.1, 2, 0.9, "suspicious"),
    (0.9, 0.54, 0.1, 12, 0.6, None),
    (0.9, 0.9, 0.35, 12, 0.6, None),
    (0.14, 0.9, 0.1, 12, 0.6, None),
    (0.9, 0.9, 0.1, 0.9, 0.6, None),
])
def test_grade(spark, r2, mono, plateau, ratio, growth, want):
    df = spark.createDataFrame([(r2, mono, plateau)], "r2 double, mono double, plateau double")
    got = df.select(grade_confidence(F.lit(float(ratio)), F.lit(1.0), F.lit(float(growth))).alias("g")).collect()[0].g
    assert got == want


def test_time_range_join_spreads_and_keeps_pairs(spark):
    rng = random.Random(5)
    points = [("r", i, rng.uniform(0, 500)) for i in range(200)]
    intervals = [("r", k, k * 37.0, k * 37.0 + rng.uniform(0, 130)) for k in range(12)]
    p = spark.createDataFrame(points, "run_id string, pid long, rel_seconds double")
    i = spark.createDataFrame(intervals, "run_id string, k long, lo double, hi double")
    got = sorted((r.pid, r.k) for r in series.time_range_join(p, i, "lo", "hi").collect())
    assert got == sorted((a[1], b[1]) for a in points for b in intervals if b[2] <= a[2] <= b[3])


def test_moving_average_longer_than_a_chunk(spark):
    n, window = 50, 11  # three chunks of four back
    rows = spark.range(n).selectExpr("'r' run_id", "id idx", "cast(id * 7919 % 1000 as double) v")
    w = W.partitionBy("run_id").orderBy("idx").rowsBetween(1 - window, 0)
    got = series.moving_average(rows, "v", window).withColumn("plain", F.avg("v").over(w))
    assert got.agg(F.count("idx"), F.count_if(F.expr("abs(smooth - plain) > 1e-6"))).first() == (n, 0)


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_percentile_by_refined_counts(spark, monkeypatch, p):
    """Bins that hold many unequal values are cut until few are left; ties, signs and tiny values included."""
    monkeypatch.setattr(series, "FEW", 3)
    monkeypatch.setattr(series, "CUTS", 4)
    draw = np.random.default_rng(1)
    groups = {
        "close": 100 + draw.random(500) * 1e-9, "ties": draw.integers(0, 3, 400).astype(float), "signs": draw.standard_normal(300) * 1e6,
        "tiny": draw.random(50) * 1e-310, "one": np.array([7.5]), "wide": np.concatenate([10.0 ** draw.integers(-300, 300, 200), -(2.0 ** np.arange(40))]),
        "zeros": np.array([0.0, -0.0, 0.0, 5.0]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("close", None)]
    table = spark.createDataFrame(rows, "run_id string, v double").repartition(7)
    got = {r.run_id: r.p for r in series.percentile_linear(table, "v", p).collect()}
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.percentile(vs, p * 100), rel=1e-12), g


def test_value_bins_never_fall(spark):
    draw = np.random.default_rng(2)
    values = sorted({*(draw.standard_normal(3000) * 10.0 ** draw.integers(-320, 300, 3000)).tolist(), *(2.0 ** np.arange(-1074, 1024)).tolist(),
                     *np.nextafter(2.0 ** np.arange(-1000, 1000), 0).tolist(), 0.0, -1.0, float("inf"), -float("inf")}) + [float("nan")]
    table = spark.createDataFrame(list(enumerate(map(float, values))), "i int, v double")
    bins = [r.b for r in table.select("i", series.value_bin(F.col("v")).alias("b")).orderBy("i").collect()]
    assert all(a <= b for a, b in zip(bins, bins[1:])) and len(set(bins)) > 2000


def test_value_bin_writes_its_column_few_times(spark):
    """A view's column is written out wherever it is used; what is written out too often is not compiled."""
    table = spark.range(10).selectExpr("case when id % 3 = 0 then null else id / 7 end as v")
    plan = table.select(series.value_bin(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN ((id") <= 8


def test_percentile_sends_no_row_by_its_key(spark):
    """Without broadcasts, rows are exchanged by bin or value; only bins and marks meet by key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = spark.range(100_000).select(F.lit("r").alias("run_id"), (F.col("id") % 977).cast("double").alias("v"))
        df = series.percentile_linear(table, "v", 0.5)
        assert df.collect()[0].p == 486.0
        text = df._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in text.splitlines() if "SortMergeJoin" in line]
        assert joins and all("_bin" in line for line in joins)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plateau_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(series, "CHUNK", 8)
    draw = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(30):
        v = np.concatenate([draw.random(draw.integers(0, 40)) * 50 + 1, 100 + draw.random(draw.integers(1, 40))])
        rows += [(f"r{k}", i, float(x)) for i, x in enumerate(v)]
        out = np.flatnonzero(np.abs(v - v[-1]) > abs(v[-1]) * 0.02)
        want[f"r{k}"] = (len(v) - 1 - (out[-1] if len(out) else -1)) / len(v) if len(v) >= 2 else 0.0
    got = {r.run_id: r.plateau_fraction for r in series.plateau_fraction(spark.createDataFrame(rows, "run_id string, idx long, v double"), "v").collect()}
    assert got == pytest.approx(want)
