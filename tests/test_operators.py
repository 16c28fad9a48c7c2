"""Hand-worked vectors of operators and their limits on both sides."""

import pytest
from pyspark.sql import functions as F

from perfloom import RunThresholds, Thresholds
from perfloom.functions import coerce, naming
from perfloom.operators import anomalies as an
from perfloom.operators import apps, charts, compare, derive, events, offenders, scores, trends
from perfloom.operators import slowdowns as sl


def system(spark, cpu=None, mem=None, swap=None, disk=None, run="r", cores=None):
    n = max(len(x) for x in (cpu, mem, swap, disk, cores) if x is not None)
    col = lambda x: [None] * n if x is None else [None if v is None else float(v) for v in x]
    rows = [
        (run, i, float(i), c, m, s, d, (cores[i] if cores else ""))
        for i, (c, m, s, d) in enumerate(zip(col(cpu), col(mem), col(swap), col(disk)))
    ]
    return spark.createDataFrame(
        rows, "run_id string, row_ord long, rel_seconds double, cpu_total_pct double, mem_percent double, "
        "swap_percent double, disk_active_pct_est double, cpu_per_core_pct string")


def test_cpu_window_spans_the_gap(spark):
    r = an.cpu_sustained_high(system(spark, [90] * 10 + [10] + [90] * 10)).collect()
    assert len(r) == 1 and r[0].samples == 21 and r[0].peak_pct == 90
    assert r[0].avg_pct == pytest.approx(1810 / 21)
    assert r[0].kind == "cpu_sustained_high" and all(x in r[0].description for x in ("CPU", "85%", "21", "90.0%"))


@pytest.mark.parametrize("peak,severity", [(93.0, "high"), (92.9, "medium")])
def test_memory_severity(spark, peak, severity):
    assert [r.severity for r in an.memory_pressure(system(spark, mem=[peak] * 10)).collect()] == [severity]


@pytest.mark.parametrize("peak,severity", [(95.0, "medium"), (95.1, "high")])
def test_disk_severity(spark, peak, severity):
    assert [r.severity for r in an.disk_active_high(system(spark, disk=[peak] * 8)).collect()] == [severity]


@pytest.mark.parametrize("peak,want", [(20.0, []), (20.1, ["low"]), (40.0, ["low"]), (40.1, ["medium"])])
def test_swap(spark, peak, want):
    assert [r.severity for r in an.swap_usage(system(spark, swap=[1, peak])).collect()] == want


def test_single_core(spark):
    pinned = an.cpu_single_core_saturation(system(spark, cores=["99;10;20"] * 10 + ["99"] * 2)).collect()
    assert [(r.core, r.samples, r.other_cores_avg_pct) for r in pinned] == [(0, 12, 15.0)]
    assert an.cpu_single_core_saturation(system(spark, cores=["99;80;20"] * 10)).collect() == []


def test_slowdown_merges_before_length(spark):
    w = sl.slowdown_windows(system(spark, cpu=[90, 1, 1, 1, 1, 90])).collect()
    assert [(r.start_idx, r.end_idx, r.samples, r.n_cpu) for r in w] == [(0, 5, 6, 2)]


def latency(spark, rows):
    return spark.createDataFrame(rows, "run_id string, rel_seconds double, avg_ms double")


def test_slowdown_confidence_and_network_tag(spark):
    s = system(spark, cpu=[90] * 20)
    w = sl.slowdown_windows(s)
    none = sl.slowdown_confidence(w, sl.slowdown_latency_hits(w, latency(spark, [("r", 5.0, 100.0)]))).collect()[0]
    assert (none.confidence, none.reason_tags, none.latency_hits) == ("likely", ["cpu"], 0)
    hit = sl.slowdown_confidence(w, sl.slowdown_latency_hits(w, latency(spark, [("r", 29.0, 250.0)] * 2))).collect()[0]
    assert (hit.confidence, hit.reason_tags, hit.latency_hits) == ("strong evidence", ["cpu", "network"], 2)
    assert "250" in hit.description and "250" not in none.description


def test_per_run_limits(spark):
    s = system(spark, [70] * 10, run="a").union(system(spark, [70] * 10, run="b"))
    runs = spark.createDataFrame([("a", 60.0), ("b", None)], "run_id string, th_cpu_sustained_pct double")
    found = an.cpu_sustained_high(s, RunThresholds(runs)).collect()
    assert [r.run_id for r in found] == ["a"]


def test_fleet_equals_single_runs_and_input_order(spark):
    import random
    rng = random.Random(2)
    parts = [system(spark, [rng.choice([90, 90, 90, 5]) for _ in range(150)], run=r) for r in "abc"]
    th = Thresholds(cpu_sustained_seconds=3)
    key = lambda df: sorted((r.run_id, r.start_idx, r.end_idx, r.peak_pct) for r in df.collect())
    single = sorted(sum((key(an.cpu_sustained_high(p, th)) for p in parts), []))
    fleet = parts[0].union(parts[1]).union(parts[2])
    assert key(an.cpu_sustained_high(fleet.repartition(7).orderBy(F.rand(1)), th)) == single
    assert single


def test_coercion(spark):
    df = spark.createDataFrame([("12.9",), ("-1.7",), ("",), (None,), ("x",)], "v string")
    got = df.select(coerce.to_int("v").alias("i"), coerce.to_int("v", -1).alias("j"), coerce.to_float("v").alias("f")).collect()
    assert [r.i for r in got] == [12, -1, 0, 0, 0]
    assert [r.j for r in got] == [12, -1, -1, -1, -1]
    assert [r.f for r in got] == [12.9, -1.7, None, None, None]
    df = spark.createDataFrame([("12.0;x;3",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(coerce.parse_semicolon_list("v")).collect()] == [[12.0, 0.0, 3.0], [], []]


def test_names(spark):
    df = spark.createDataFrame([("FOO-bar.exe",), (" Chrome.EXE ",), ("",), ("x2go.exe",)], "n string")
    got = [r[0] for r in df.select(naming.display_name(naming.app_key("n"))).collect()]
    assert got == ["Foo-Bar", "Google Chrome", "?", "X2Go"]
    df = spark.createDataFrame([("10.0.0.1:443",), ("[fe80::1]:443",), ("::1:443",), ("",), ("host",), ("[x",)], "a string")
    assert [r[0] for r in df.select(naming.strip_port("a")).collect()] == ["10.0.0.1", "fe80::1", "::1", "", "host", "[x"]


def test_app_ticks_sum_concurrent(spark):
    rows = [("r", 1, 0.0, 1, "a.exe", 30.0), ("r", 2, 0.0, 2, "A.exe ", 40.0)]
    p = spark.createDataFrame(rows, "run_id string, row_ord long, rel_seconds double, pid long, name string, cpu_pct double")
    for c in ("rss_bytes", "num_handles", "num_threads", "io_read_bps", "io_write_bps", "is_target"):
        p = p.withColumn(c, F.lit(0))
    r = apps.app_aggregates(p).collect()
    assert [(x.app_key, x.cpu_pct_max, x.pid_count, x.pids) for x in r] == [("a.exe", 70.0, 2, [1, 2])]


def test_probe_summary(spark):
    df = spark.createDataFrame([([10, 14, 12], 4), ([], 4)], "raw_times_ms array<int>, count int")
    a, b = derive.latency_probe_summary(df).collect()
    assert (a.avg_ms, a.min_ms, a.max_ms, a.jitter_ms, a.loss_pct) == (12, 10, 14, 3.0, 25.0)
    assert (b.avg_ms, b.jitter_ms, b.loss_pct) == (None, None, 100)


def test_service_changes_both_fire(spark):
    df = spark.createDataFrame([("r", 0, "svc", "Stopped", None), ("r", 1, "svc", "Running", 7)],
                               "run_id string, snapshot_ord long, name string, status string, pid long")
    assert sorted(r.event for r in derive.service_snapshot_diff(df).collect()) == ["service_pid_change", "service_status_change"]


def test_gpu_rollup(spark):
    inst = "pid_{}_luid_0x0_0xA_phys_0_eng_3_engtype_{}"
    rows = [("r", 0, inst.format(1, "3D"), 0.0), ("r", 0, inst.format(2, "3D"), 0.0),
            ("r", 0, inst.format(1, "Copy"), 40.0), ("r", 0, inst.format(2, "Copy"), 130.0), ("r", 0, "other", 5.0)]
    got = {(r.engine_type, r.luid): r.utilization_pct for r in derive.gpu_engine_rollup(
        spark.createDataFrame(rows, "run_id string, snapshot long, instance string, value double")).collect()}
    assert got == {("Copy", "0x0_0xA"): 100.0, ("?", "?"): 5.0}


def test_disk_io(spark):
    rows = [("r", 1, "FileIo", 5, 100, "b.exe"), ("r", 0, "DiskRead", 5, 10, "a.exe"), ("r", 2, "Other", 5, 10, "c"), ("r", 3, "FileIo", 6, 9, "d")]
    df = spark.createDataFrame(rows, "run_id string, row_ord long, event_name string, pid long, bytes long, image string")
    got = derive.disk_io_by_process(df).collect()
    assert [(r.pid, r.name, r.read_bytes, r.write_bytes) for r in got] == [(5, "a.exe", 10, 0)]
    t = derive.disk_io_totals(df).collect()[0]
    assert (t.events_total, t.events_attributed, t.read_bytes) == (4, 3, 10)


def test_event_log_times(spark):
    runs = spark.createDataFrame([("r", 1000.0, 2000.0)], "run_id string, start_wall double, end_wall double")
    rows = [("r", 0, "1970-01-01T00:16:50.340Z", 2), ("r", 1, "garbage", 3), ("r", 2, "1970-01-01T00:16:50+00:00", 4), ("r", 3, "1970-01-01T02:00:00Z", 1)]
    df = spark.createDataFrame(rows, "run_id string, row_ord long, time string, level_code int")
    got = {r.row_ord: r.rel_seconds for r in derive.normalize_event_log(df, runs).collect()}
    assert got == {0: 10.3, 1: None}


def test_vpn(spark):
    df = spark.createDataFrame([("r", "WireGuard Tunnel"), ("r", "WireGuard Tunnel"), ("r", "Ethernet"), ("r", "TAP-Windows")], "run_id string, name string")
    assert sorted(r.adapter for r in derive.vpn_suspect_adapters(df).collect()) == ["TAP-Windows", "WireGuard Tunnel"]


def test_event_padding(spark):
    ev = spark.createDataFrame([("r", i, x, 2, "disk") for i, x in enumerate([0.0, 23.0, 23.1, None])],
                               "run_id string, row_ord long, rel_seconds double, level_code int, provider string")
    w = spark.createDataFrame([("r", 5.0, 8.0, ["cpu"])], "run_id string, start_rel double, end_rel double, reason_tags array<string>")
    got = {r.row_ord: r.n_correlated for r in events.correlate_events(ev, w).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0}


def test_bottleneck_classes(spark):
    rows = [("r", d, p, i + 1) for i, (d, p) in enumerate(zip(scores.DIMENSIONS, [15.0, 12.0, 0.0, 0.0, 0.0, 0.0]))]
    r = scores.classify_bottleneck(spark.createDataFrame(rows, "run_id string, dim string, points double, ord int")).collect()[0]
    assert (r.primary, r.secondary) == (None, ["memory"])


def test_bottleneck_points_ignore_swap(spark):
    s = system(spark, [1.0])
    empty_an = spark.createDataFrame([], "run_id string, kind string, severity string, description string")
    slow = spark.createDataFrame([("r", ["cpu", "swap"])], "run_id string, reason_tags array<string>")
    off = spark.createDataFrame([("r", "cpu", 3, "MsMpEng.exe"), ("r", "cpu", 4, "mssense.exe")], "run_id string, axis string, rank int, name string")
    got = {r.dim: r.points for r in scores.bottleneck_scores(s, empty_an, latency(spark, []), slow, off).collect()}
    assert got == {"cpu": 5, "memory": 0, "disk": 0, "network": 0, "security": 10, "background_noise": 0}


def test_scores_bounds(spark):
    runs = spark.createDataFrame([("r", "support"), ("empty", "workload")], "run_id string, mode string")
    s = system(spark, [50] * 5, [50] * 5)
    empty = spark.createDataFrame([], "run_id string, severity string, samples long")
    got = {r.run_id: r.stability for r in scores.stability_score(runs, s, empty).collect()}
    assert got == {"r": 100.0, "empty": 50.0}
    got = {r.run_id: r.workload for r in scores.workload_score(runs, s, empty).collect()}
    assert got == {"r": 50.0, "empty": 50.0}


def test_recommendation_rules(spark):
    b = spark.createDataFrame([("r", "cpu"), ("q", None)], "run_id string, primary string")
    off = spark.createDataFrame([("r", 1, 16.0)], "run_id string, rank int, cpu_pct_avg double")
    leaks = spark.createDataFrame([("r", "memory_leak_candidate", "likely", "a.exe"), ("r", "thread_leak_candidate", "suspicious", "b")],
                                  "run_id string, kind string, confidence string, process_name string")
    churn = spark.createDataFrame([("r", 201), ("q", 200)], "run_id string, total_process_starts long")
    av = spark.createDataFrame([("r", "X"), ("r", "Y"), ("q", "X")], "run_id string, product string")
    got = sorted((r.run_id, r.rule) for r in scores.recommendations(b, off, off, leaks, churn, av).collect())
    assert got == [("r", x) for x in ("background_cpu", "churn", "leak_memory", "primary_cpu", "security_cpu", "several_antivirus")]


def test_pairs(spark):
    cols = "run_id string, overall double, cpu_avg double, mem_avg double, disk_avg double, latency_p95_ms double, anomalies long, slowdowns long"
    rows = [(f"r{i:02d}", 50.0, c, 1.0, 1.0, None, 0, 0) for i, c in enumerate([10.0, 7.0, 7.1])]
    got = sorted((r.run_a, r.run_b, r.metric, r.delta) for r in compare.pairwise_observations(spark.createDataFrame(rows, cols)).collect())
    assert got == [("r00", "r01", "cpu_avg", 3.0)]
    rows = [(f"r{i:02d}", 50.0, 10.0 * i, 1.0, 1.0, None, 0, 0) for i in range(30)]
    got = compare.pairwise_observations(spark.createDataFrame(rows, cols), blocks=4)
    assert got.count() == got.select("run_a", "run_b").distinct().count() == 30 * 29 // 2


def test_problems(spark):
    runs = spark.createDataFrame([("1",), ("2",), ("3",)], "run_id string")
    a = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "run_id string, kind string")
    s = spark.createDataFrame([], "run_id string, reason_tags array<string>")
    got = [(r.scope, r.run_id, r.problem) for r in compare.common_and_unique_problems(runs, a, s).collect()]
    assert got == [("unique", "1", "b")]


def test_downsample(spark):
    s = system(spark, [1, 5, 2, 9, 3])
    got = charts.downsample_max(s, "rel_seconds", ["cpu_total_pct"], 2).orderBy("bucket").collect()
    assert [(r.rel_seconds, r.cpu_total_pct) for r in got] == [(0.0, 5.0), (2.0, 9.0)]


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_process_rows_are_aggregated_without_sorting_them(spark):
    rows = [("r", 1, 10, 1, "", 2.0, 5, 7, None), ("r", 1, 9, 2, "b", 3.0, 9, 0, 4), ("r", 1, 8, 3, "a", None, None, 3, 6), ("r", 2, None, 1, None, 1.0, 1, 0, 0), ("r", 2, 4, 5, "", 1.0, 1, 0, 0)]
    table = spark.createDataFrame(rows, "run_id string, pid long, ppid long, row_ord long, name string, cpu_pct double, rss_bytes long, num_handles long, num_threads long")
    table = table.selectExpr("*", "cast(row_ord as double) rel_seconds", "cpu_pct * 2 io_read_bps", "cpu_pct io_write_bps", "pid - 1 is_target", "cpu_pct cpu_time_user")
    df = offenders.per_pid_aggregates(table)
    got = {r.pid: r for r in df.collect()}
    one = got[1]
    assert (one.name, one.ppid, one.samples, one.cpu_pct_sum, one.rss_bytes_max) == ("a", 10, 3, 5.0, 9)
    assert (one.num_handles_max, one.num_handles_min, one.num_threads_max, one.num_threads_min) == (7, 3, 6, 4)
    assert (one.first_seen, one.last_seen, one.is_target, one.cpu_time_user_last, one.io_read_bps_max) == (1.0, 3.0, False, 0.0, 6.0)
    two = got[2]
    assert (two.name, two.ppid, two.num_handles_max, two.is_target, two.samples) == ("?", None, 0, True, 2)
    steps = [line for line in executed(df).splitlines() if "Aggregate(key" in line]
    assert "partial" in steps[-1] and "HashAggregate" in steps[-1]  # the step that sees the process rows


def test_trend_points_are_aggregated_without_their_names(spark):
    table = spark.range(60).selectExpr("'r' run_id", "id % 2 pid", "id row_ord", "cast(id as double) rel_seconds", "concat('n', cast(id as string)) name", "id * 10 rss_bytes", "id num_handles", "id num_threads")
    df = trends.trend_stats(table)
    assert {(r.pid, r.metric): r.process_name for r in df.collect()} == {(p, m): f"n{58 + p}" for p in (0, 1) for m in trends.METRICS}
    assert "SortAggregate" not in executed(df)
