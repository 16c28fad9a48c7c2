"""Run folders in, findings out; live operators against their batch results."""

import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from perfloom import RunThresholds
from perfloom.operators import apps, compare, derive
from perfloom.plans import folders
from perfloom.plans.analysis import Analysis
from perfloom.plans.views import Views
from perfloom.schemas import FILES, TIMELINES
from perfloom.sources import run_folders as rf
from perfloom.sources import writers
from perfloom.streaming import live

SMALL = "/root/testdata/sf0.001"


def write_csv(folder, kind, rows):
    with open(folder / FILES[kind], "w", newline="") as f:
        w = csv.DictWriter(f, list(TIMELINES[kind]))
        w.writeheader()
        w.writerows(rows)


def make_run(root: Path, name: str, cpu: list[float], thresholds: dict, latency_ms: float, mode="workload"):
    folder = root / name
    folder.mkdir()
    manifest = {"run_id": f"id-{name}", "hostname": "h", "mode": mode, "tags": ["x", "y"], "duration_actual_seconds": 80.5,
                "thresholds": thresholds, "target": {"name": None, "pid": None, "path": None}, "phase3": {"gpu": False}}
    (folder / "manifest.json").write_text(json.dumps(manifest))
    write_csv(folder, "system", [
        {"timestamp": 1e9 + i, "rel_seconds": i, "cpu_total_pct": c, "cpu_per_core_pct": f"{c};1" if i else "",
         "mem_percent": "" if i == 3 else 40, "swap_percent": "garbage", "mem_total_bytes": "12.9"} for i, c in enumerate(cpu)])
    write_csv(folder, "process", [
        {"timestamp": 1e9 + i, "rel_seconds": i, "pid": pid, "name": n, "cpu_pct": pid, "rss_bytes": 1e8 * pid + i * 1e6 * pid,
         "num_handles": 10, "num_threads": 3, "io_read_bps": 1, "io_write_bps": 2, "ppid": 1, "is_target": 0}
        for i in range(len(cpu)) for pid, n in ((1, "a.exe"), (7, "MsMpEng.exe"))])
    write_csv(folder, "latency", [{"rel_seconds": i * 15, "target": "8.8.8.8", "count": 2, "avg_ms": latency_ms, "max_ms": latency_ms,
                                   "loss_pct": 0, "raw_times_ms": "1;2"} for i in range(4)])
    return folder


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    a = make_run(root, "a", [90] * 40 + [10] * 40, {"cpu_sustained_pct": 85.0, "unknown_key": 1}, 20.0)
    make_run(root, "b", [70] * 70 + [10] * 10, {"cpu_sustained_pct": 60.0}, 600.0)
    write_csv(a, "network", [{"rel_seconds": 1, "adapter": "e", "is_up": 1, "connections_established": ""}])
    write_csv(a, "connections", [{"rel_seconds": 30, "pid": 7, "name": "a.exe", "raddr": "1.2.3.4:5", "status": "LISTEN", "type": "tcp"}])
    (a / "process_events.json").write_text(json.dumps([{"event": "process_started", "pid": 5, "name": "x.exe", "rel_seconds": 3.0}] * 3))
    (a / "service_events.json").write_text(json.dumps([{"event": "service_added", "name": "s"}]))
    (a / "event_log.json").write_text(json.dumps({"count": 2, "start_wall": 1e9, "end_wall": 2e9, "events": [
        {"provider": "disk", "level_code": 2, "rel_seconds": 5.0}, {"provider": "zzz", "level_code": None, "rel_seconds": None}]}))
    (a / "process_start_snapshot.json").write_text(json.dumps([{"pid": 1, "name": "x"}]))
    (a / "static_snapshot.json").write_text(json.dumps({
        "security": {"antivirus_products": [{"displayName": "A"}, {"displayName": "B"}]},
        "network": {"adapters_psutil": [{"name": "eth"}], "adapters_wmi": [{"Name": "WireGuard"}]}}))
    loose = root / "no-manifest"
    loose.mkdir()
    write_csv(loose, "system", [{"rel_seconds": 1, "cpu_total_pct": 5}])
    return str(root)


def test_readers(spark, root):
    runs = rf.discover_runs(spark, root, 2)
    assert {r.run_id: r.th_cpu_sustained_pct for r in runs.collect()} == {"id-a": 85.0, "id-b": 60.0}
    assert "th_unknown_key" not in runs.columns
    with pytest.raises(ValueError):
        rf.discover_runs(spark, root, 3)
    s = rf.read_system(spark, root)
    rows = s.filter("run_id = 'id-a'").orderBy("row_ord").collect()
    assert [r.rel_seconds for r in rows] == list(range(80))
    assert (rows[0].cpu_per_core_pct, rows[1].cpu_per_core_pct) == ([], [90.0, 1.0])
    assert (rows[3].mem_percent, rows[0].swap_percent, rows[0].mem_total_bytes, rows[0].swap_total_bytes) == (None, None, 12, 0)
    assert {r.run_id for r in s.select("run_id").distinct().collect()} == {"id-a", "id-b"}
    assert [r.connections_established for r in rf.read_network(spark, root).collect()] == [-1]
    assert [r.raw_times_ms for r in rf.read_latency(spark, root).take(1)] == [[1, 2]]
    assert rf.read_gpu_engine(spark, root).count() == rf.read_gpu_process(spark, root).count() == rf.read_gpu_adapter(spark, root).count() == 0
    assert rf.read_connections(spark, root).collect()[0].pid == 7
    assert rf.read_process_events(spark, root).count() == 3
    assert rf.read_service_events(spark, root).collect()[0].event == "service_added"
    assert [(r.row_ord, r.provider) for r in rf.read_event_log(spark, root).orderBy("row_ord").collect()] == [(0, "disk"), (1, "zzz")]
    assert [(r.snapshot_ord, r.pid) for r in rf.read_process_snapshots(spark, root).collect()] == [(0, 1)]
    assert rf.read_service_snapshots(spark, root).count() == 0
    antivirus, adapters = rf.read_inventory(spark, root)
    assert sorted(r["product"] for r in antivirus.collect()) == ["A", "B"]
    assert [r.adapter for r in derive.vpn_suspect_adapters(adapters).collect()] == ["WireGuard"]


def test_end_to_end(spark, root, tmp_path):
    tables = rf.read_all(spark, root)
    a = Analysis(tables, RunThresholds(tables["runs"]))
    kinds = sorted((r.run_id, r.kind) for r in a.kept("anomalies").collect())
    assert kinds == [("id-a", "cpu_sustained_high"), ("id-b", "cpu_sustained_high"), ("id-b", "network_latency_spike")]
    s = {r.run_id: r for r in a.kept("scores").collect()}
    assert s["id-a"].workload == 50.0 and s["id-b"].workload == 12.5 and s["id-a"].confidence == "medium"
    assert all(0 <= v <= 100 for r in s.values() for v in (r.overall, r.stability, r.network, r.hygiene))
    summary = {r.run_id: r for r in a.run_summary.collect()}
    assert summary["id-a"].primary == "cpu" and summary["id-a"].verdict and summary["id-a"].overall == s["id-a"].overall
    writers.write_findings({k: v for k, v in a.findings().items() if k in ("anomalies", "slowdowns", "leaks", "events", "summary")},
                           a.kept("scores"), str(tmp_path / "out"))
    assert spark.read.json(f"{tmp_path}/out/findings/slowdowns").count() == 2
    assert spark.read.json(f"{tmp_path}/out/findings/events").filter("n_correlated > 0").count() == 1
    assert spark.read.json(f"{tmp_path}/out/scores").count() == 2
    m = a.kept("matrix")
    writers.write_comparison(m, a.rankings, compare.pairwise_observations(m), a.problems, compare.comparison_winners(a.rankings), str(tmp_path / "cmp"))
    assert spark.read.option("header", True).csv(f"{tmp_path}/cmp/matrix").columns == compare.MATRIX_COLUMNS
    assert spark.read.json(f"{tmp_path}/cmp/winners").collect()[0].lowest_latency_p95 == "id-a"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_tables_round_trip(spark, root, tmp_path, fmt):
    s = rf.read_system(spark, root).withColumn("not_a_field", F.lit(1))
    writers.write_tables({"system": s}, str(tmp_path), fmt)
    back = spark.read.option("header", True).format(fmt).load(f"{tmp_path}/system")
    assert "not_a_field" not in back.columns and back.count() == s.count()
    if fmt == "csv":
        back = rf.coerce_timeline(back, "system")
    pick = lambda df: sorted((r.run_id, r.rel_seconds, r.cpu_total_pct, tuple(r.cpu_per_core_pct)) for r in df.collect())
    assert pick(back) == pick(s)


def in_files(spark, df, order, path, parts=3):
    """``df`` as ``parts`` parquet files whose modification order is the order of ``order``."""
    import time
    rows = df.toPandas().sort_values(order)
    ticks = rows[order[0]].drop_duplicates()
    for i in range(parts):
        mine = set(ticks.iloc[len(ticks) * i // parts: len(ticks) * (i + 1) // parts])
        spark.createDataFrame(rows[rows[order[0]].isin(mine)], df.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(got, want):
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    return rows(got) == rows(want)


@pytest.mark.parametrize("case", ["system", "adapter", "process", "snapshot", "service"])
def test_stream_equals_batch(spark, tmp_path, case):
    v = Views(spark, SMALL)
    view, order, batch, stream = {
        "system": (v.tot, ["mono"], derive.system_rates, live.stream_system_rates),
        "adapter": (v.nic, ["mono"], derive.adapter_rates, live.stream_adapter_rates),
        "process": (v.ctr, ["mono"], derive.process_io_rates, live.stream_process_io_rates),
        "snapshot": (v.snap, ["snapshot_ord"], derive.process_snapshot_diff, live.stream_snapshot_diff),
        "service": (v.svc, ["snapshot_ord"], derive.service_snapshot_diff, lambda *a: live.stream_snapshot_diff(*a, services=True)),
    }[case]
    rows = in_files(spark, view, order, f"{tmp_path}/in")
    stream(rows, f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out/batch=*")
    assert same(got, batch(view))


def test_stream_timelines(spark, root, tmp_path):
    rows = live.stream_timelines(spark, root, "process", 1)
    live.append_timelines(rows, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = rf.read_process(spark, root)
    assert got.groupBy("pid").agg(F.sum("rss_bytes")).orderBy("pid").collect() == want.groupBy("pid").agg(F.sum("rss_bytes")).orderBy("pid").collect()


def test_stream_app_ticks(spark, root, tmp_path):
    p = live.stream_timelines(spark, root, "process")
    q = live.stream_app_ticks(p).writeStream.format("memory").queryName("ticks").outputMode("complete").trigger(availableNow=True)
    q.option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination(60)
    want = apps.app_ticks(rf.read_process(spark, root)).select("app_key", "rel_seconds", "cpu_pct", "rss_bytes")
    got = spark.table("ticks").select("app_key", (F.col("second") - 1e9).alias("rel_seconds"), "cpu_pct", "rss_bytes")
    assert same(got, want)


def test_stream_candidates(spark, root, tmp_path):
    p = live.stream_timelines(spark, root, "process")
    live.stream_candidates(p, f"{tmp_path}/out", f"{tmp_path}/c", 1).awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out/batch=*")
    assert got.select("refresh").distinct().count() == 8
    assert {(r.run_id, r.pid) for r in got.filter("refresh = 10").collect()} == {("a", 7), ("b", 7)}


def in_order(spark, batches, schema, path):
    """A stream whose micro-batches are ``batches``."""
    import time
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_snapshot_split_over_batches(spark, tmp_path):
    schema = "run_id string, snapshot_ord long, pid long, name string"
    snap = lambda run, at, pids: [(run, at, p, f"n{p}") for p in pids]
    batches = [
        snap("a", 1, [1, 2, 3]) + snap("b", 1, [1]), snap("a", 2, [1]), snap("a", 2, [2, 4]), snap("a", 3, [1]) + snap("b", 2, [1, 9]),
        snap("a", 2, [5]) + snap("a", 3, [2, 4]), snap("a", 4, [1]), snap("a", 5, [1]), snap("a", 1, [77]) + snap("a", 6, [1]),
    ]
    rows = in_order(spark, batches, schema, f"{tmp_path}/in")
    live.stream_snapshot_diff(rows, f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination(120)
    whole = spark.createDataFrame([r for b in batches for r in b if r[2] != 77], schema)
    assert same(spark.read.parquet(f"{tmp_path}/out/batch=*"), derive.process_snapshot_diff(whole))
    final = spark.read.parquet(f"{tmp_path}/out/batch=[0-9]*")
    assert same(final, derive.process_snapshot_diff(whole).filter("run_id = 'a' and snapshot_ord < 5"))
    assert [r.pid for r in spark.read.parquet(*[f"{tmp_path}/out/_late/{i}" for i in range(len(batches))]).collect()] == [77]


def test_stream_rates_with_a_late_row(spark, tmp_path):
    schema = "run_id string, mono double, row_ord long, pid long, read_bytes long, write_bytes long"
    row = lambda at, pid=1: ("a", float(at), at, pid, at * at * 100, at * 50)
    batches = [[row(1), row(2), row(1, 2)], [row(4), row(5)], [row(3), row(6), row(6, 2)], [row(30)]]
    rows = in_order(spark, batches, schema, f"{tmp_path}/in")
    live.stream_process_io_rates(rows, f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination(120)
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    assert same(spark.read.parquet(f"{tmp_path}/out/batch=*"), derive.process_io_rates(whole))


def test_stream_candidates_of_a_split_window(spark, tmp_path):
    schema = "run_id string, rel_seconds double, pid long, name string, is_target boolean, cpu_pct double, rss_bytes long, num_handles long, io_read_bps double, io_write_bps double"
    row = lambda at, pid, x: ("a", float(at), pid, "p", False, float(x), x, x, float(x), float(x))
    batches = [[row(1, 1, 5), row(12, 2, 5)], [row(11, 3, 9), row(15, 4, 99)], [row(11, 5, 10)], [row(25, 6, 1)], [row(36, 7, 1)], [row(49, 8, 1)]]
    rows = in_order(spark, batches, schema, f"{tmp_path}/in")
    live.stream_candidates(rows, f"{tmp_path}/out", f"{tmp_path}/ckpt", 1).awaitTermination(120)
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    assert same(spark.read.parquet(f"{tmp_path}/out/batch=*"), live.refresh_candidates(whole, 1))


def goes_on(spark, start, path, want, tmp_path):
    """A query without an end gives ``want``, its last rows too, as ``batch=<id>``."""
    import time
    q = start(f"{tmp_path}/state", path, f"{tmp_path}/ckpt")
    try:
        for _ in range(90):
            time.sleep(1)
            assert q.exception() is None
            if any(Path(path).glob("batch=[0-9]*/*.parquet")) and same(spark.read.parquet(f"{path}/batch=[0-9]*"), want):
                return
        raise AssertionError([want.count(), spark.read.parquet(f"{path}/batch=[0-9]*").count()])
    finally:
        q.stop()


def test_an_ended_run_is_released_by_a_timer(spark, tmp_path):
    schema = "run_id string, mono double, row_ord long, pid long, read_bytes long, write_bytes long"
    row = lambda run, at, pid=1: (run, float(at), at, pid, 2**60 + at * at * 1000, at * 50)
    batches = [[row("a", 1), row("a", 2), row("b", 1)], [row("a", 4), row("b", 3)], [row("a", 5), row("a", 5, 2)]]
    rows = in_order(spark, batches, schema, f"{tmp_path}/in")
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    goes_on(spark, lambda *a: live.stream_process_io_rates(rows, *a, once=False, idle=2), f"{tmp_path}/out", derive.process_io_rates(whole), tmp_path)


def test_the_last_snapshot_of_an_ended_run_appears(spark, tmp_path):
    schema = "run_id string, snapshot_ord long, pid long, name string"
    snap = lambda run, at, pids: [(run, at, p, f"n{p}") for p in pids]
    batches = [snap("a", 1, [1, 2, 3]) + snap("b", 1, [1]), snap("a", 2, [1]), snap("a", 2, [2, 4]) + snap("b", 2, [7])]
    rows = in_order(spark, batches, schema, f"{tmp_path}/in")
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    goes_on(spark, lambda *a: live.stream_snapshot_diff(rows, *a, once=False, idle=2), f"{tmp_path}/out", derive.process_snapshot_diff(whole), tmp_path)


def test_the_last_window_of_an_ended_run_appears(spark, tmp_path):
    schema = "run_id string, rel_seconds double, pid long, name string, is_target boolean, cpu_pct double, rss_bytes long, num_handles long, io_read_bps double, io_write_bps double"
    row = lambda at, pid, x: ("a", float(at), pid, "p", False, float(x), x, x, float(x), float(x))
    batches = [[row(1, 1, 5), row(12, 2, 5)], [row(11, 3, 9), row(15, 4, 99)], [row(11, 5, 10)]]
    rows = in_order(spark, batches, schema, f"{tmp_path}/in")
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    start = lambda state, path, checkpoint: live.stream_candidates(rows, path, checkpoint, 1, once=False, idle=2)
    goes_on(spark, start, f"{tmp_path}/out", live.refresh_candidates(whole, 1), tmp_path)


def test_snapshot_diffs_count_repeated_rows_once(spark):
    rows = [("a", 1, 5, "x"), ("a", 1, 5, "x"), ("a", 3, 6, "y"), ("a", 3, 6, "y"), ("a", 9, 5, "x"), ("a", 9, None, "z"), ("b", 4, 1, "w")]
    got = derive.process_snapshot_diff(spark.createDataFrame(rows, "run_id string, snapshot_ord long, pid long, name string"))
    assert sorted(tuple(r) for r in got.filter("pid is not null").collect()) == [
        ("a", 3, "process_ended", 5, "x"), ("a", 3, "process_started", 6, "y"), ("a", 9, "process_ended", 6, "y"), ("a", 9, "process_started", 5, "x")]
    services = [("a", 1, "s", "run", 5), ("a", 2, "s", "stop", 0), ("a", 3, "s", "run", 6), ("a", 3, "", "run", 1), ("a", 4, "t", "run", 2), ("a", 4, "t", "run", 2), ("a", 5, "s", "run", 6)]
    got = derive.service_snapshot_diff(spark.createDataFrame(services, "run_id string, snapshot_ord long, name string, status string, pid long"))
    assert sorted((r.snapshot_ord, r.event, r.name, r.from_pid, r.to_pid) for r in got.collect()) == sorted([
        (2, "service_status_change", "s", None, None), (3, "service_status_change", "s", None, None), (3, "service_pid_change", "s", 0, 6),
        (4, "service_added", "t", None, None), (4, "service_removed", "s", None, None), (5, "service_removed", "t", None, None), (5, "service_added", "s", None, None)])


def test_snapshots_are_made_once_for_both_ends(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("r", k, k * 10 + n, f"p{n}") for k in range(4) for n in range(5)], "run_id string, snapshot_ord long, pid long, name string")
    files = folders.snapshots(rows.mapInArrow(counted, rows.schema), "process").collect()
    assert {f.file for f in files} == {"process_start_000000_snapshot.json", "process_end_000000_snapshot.json"}
    assert sorted(x["pid"] for f in files for x in json.loads(f.text)) == sorted(k * 10 + n for k in range(4) for n in range(5))
    assert seen.value == 20


def test_the_folder_of_a_document_needs_no_pattern(spark, tmp_path):
    make_run(tmp_path, "run one", [1.0], {}, 1.0)
    (tmp_path / "run one" / "process_start_000000_snapshot.json").write_text('[{"pid": 1, "name": "a"}, {"pid": 2, "name": "b"}]')
    df = rf.read_process_snapshots(spark, str(tmp_path))
    assert {(r.run_id, r.pid, r.snapshot_ord) for r in df.collect()} == {(rf.read_runs(spark, str(tmp_path)).first().run_id, p, 0) for p in (1, 2)}
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
