"""Interval joins with crowded bins, and comparisons of requested pairs of runs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from perfloom.operators import compare
from perfloom.operators.series import crowded_bins, time_range_join


def _tables(spark):
    draw = random.Random(5)
    points = [("a", k, draw.uniform(120, 180)) for k in range(600)] + [("a", 1000 + k, draw.uniform(0, 900)) for k in range(60)]
    points += [("b", k, float(60 * k)) for k in range(10)] + [("a", 5000, 130.0)] * 20 + [("a", 6000, None), ("b", 6001, -0.5)]
    spans = [("a", 0, 0.0, 130.0), ("a", 1, 125.5, 400.0), ("b", 2, 60.0, 60.0), ("b", 3, -1.0, 0.0), ("c", 4, 0.0, 900.0)]
    return points, spans, spark.createDataFrame(points, "run_id string, k int, rel_seconds double"), spark.createDataFrame(spans, "run_id string, w int, lo double, hi double")


def test_time_range_join_spreads_crowded_bins(spark):
    points, spans, left, right = _tables(spark)
    want = sorted((r, k, w) for r, k, t in points for q, w, lo, hi in spans if r == q and t is not None and lo <= t <= hi)
    for part in (7, 100, 65536):
        found = time_range_join(left, right, "lo", "hi", part_rows=part).select("run_id", "k", "w")
        assert sorted(map(tuple, found.collect())) == want
    wide = left.unionByName(left)  # a histogram of more rows than the points have
    assert time_range_join(left, right, "lo", "hi", part_rows=50, counted=wide).count() == len(want)
    assert time_range_join(left.limit(0), right, "lo", "hi").count() == 0


def test_salts_follow_the_rows_of_a_bin(spark):
    points, _, left, _ = _tables(spark)
    n = sum(r == "a" and t is not None and 120 <= t < 180 for r, _, t in points)
    assert [tuple(r) for r in crowded_bins(left, "rel_seconds", 60.0, 100).collect()] == [("a", 2, -(-n // 100))]
    assert crowded_bins(left, "rel_seconds", 60.0, 65536).count() == 0


def test_requested_pairs(spark):
    rows = [(f"r{i}", f"h{i % 2}", 10.0 * i, None if i == 4 else 50.0, float(i), 1.0, 20.0, 0, i) for i in range(7)]
    matrix = spark.createDataFrame(rows, "run_id string, hostname string, overall double, cpu_avg double, mem_avg double, disk_avg double, latency_p95_ms double, anomalies int, slowdowns int")
    every = {tuple(r) for r in compare.pairwise_observations(matrix).collect()}
    pairs = compare.successive_runs(matrix, "hostname", "run_id", back=2)
    asked = {tuple(r) for r in pairs.collect()}
    assert asked == {(f"r{i - 2 * k}", f"r{i}") for i in range(7) for k in (1, 2) if i >= 2 * k}
    extra = pairs.union(pairs).union(spark.createDataFrame([("r0", "none"), (None, "r1")], "run_a string, run_b string"))
    found = [tuple(r) for r in compare.pairwise_observations(matrix, pairs=extra).collect()]
    assert len(found) == len(set(found)) and set(found) == {o for o in every if o[:2] in asked}
    back = compare.pairwise_observations(matrix, pairs=pairs.select(F.col("run_b").alias("run_a"), F.col("run_a").alias("run_b")))
    assert {(b, a, m, y, x, -d) for a, b, m, x, y, d in back.collect()} == set(found)
