"""Physical plans: no cross products, no run-wide sort in one task, only the needed columns read."""

import re

import pytest

from perfloom.operators import derive, scores, series
from perfloom.plans.catalog import QUERIES, Inputs

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["slowdown_latency_hits", "connections_by_pid", "rank_offenders", "top_apps_stack", "merge_windows", "candidate_processes"])
def test_no_cross_product(spark, name):
    text = plan(QUERIES[name].run(spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Exchange SinglePartition" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["rank_offenders"].run(spark, FOLDER))


def test_scan_reads_only_needed_columns(spark):
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["established_connections"].run(spark, FOLDER)))
    names = {c.split(":")[0] for c in read.group(1).split(",")}
    assert names == {"o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"}


def test_windows_are_keyed_by_chunk(spark):
    i = Inputs(spark, FOLDER)
    found = series.sustained_windows(i.indexed_system, "cpu_total_pct", 20.0, 5)
    sized = [w for w in re.findall(r"Window \[.*?\](?=, \[)", plan(found)) if "lag(" in w]
    assert sized and any("_chunk" in w for w in sized)


def test_snapshot_rows_are_sent_once(spark, tmp_path):
    day = lambda n: f"timestamp'1995-01-01' + make_interval(0, 0, 0, {n})"
    rows = [(1, 5, 0), (1, 5, 0), (1, 5, 70), (2, 5, 35), (None, 6, 0), (3, None, 40), (1, 7, 35), (5, 7, 65)]
    each = [f"select cast({o} as bigint) l_orderkey, cast({s} as bigint) l_suppkey, {day(d)} l_shipdate" for o, s, d in (("null" if o is None else o, "null" if s is None else s, d) for o, s, d in rows)]
    spark.sql(" union all ".join(each)).write.parquet(str(tmp_path / "lineitem.parquet"))
    i = Inputs(spark, str(tmp_path))
    assert sorted(map(str, i.dealt("v_snap", "run_id", "pid").collect())) == sorted(map(str, i.snap.collect()))
    assert sorted(map(str, i.events_diff.collect())) == sorted(map(str, derive.process_snapshot_diff(i.snap).collect()))
    final = plan(i.events_diff).split("== Initial Plan")[0]  # it was run above
    assert len(re.findall("Exchange hashpartitioning", final)) == 1


def test_latency_percentile_at_hand_is_not_computed_again(spark, monkeypatch):
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    latency = spark.createDataFrame([("a", float(v), 0.0) for v in range(21)] + [("b", None, 50.0)], "run_id string, avg_ms double, loss_pct double")
    p95 = series.percentile_linear(latency, "avg_ms", 0.95, name="p95_ms")
    want = {r.run_id: r.network for r in scores.network_score(runs, latency).collect()}
    monkeypatch.setattr(scores, "percentile_linear", None)
    assert {r.run_id: r.network for r in scores.network_score(runs, latency, p95).collect()} == want
    assert want["a"] is not None and want["b"] == 50.0 and want["c"] == 70.0
