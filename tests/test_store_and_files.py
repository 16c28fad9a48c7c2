"""The timeline data source, run folder writers and the store of runs."""

import json

import pytest
from pyspark.sql import functions as F

from perfloom.sources import folder_files, run_folders, store, writers


def folder(root, run, **files):
    (root / run).mkdir(parents=True)
    (root / run / "manifest.json").write_text(json.dumps({"run_id": run}))
    for name, text in files.items():
        (root / run / f"{name}.csv").write_bytes(text)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_lines_keep_their_order_in_any_blocks(spark, tmp_path, block):
    head = b"rel_seconds,target,extra\n"
    first = head + b"".join(b"%d,t%d,x\n" % (i, i) for i in range(40))
    second = b'rel_seconds,target\r\n40,"a,b"\r\n\r\n41,\r\n42\r\n43,"",9\r\n44,\xc3\xa9'
    folder(tmp_path, "a", timeline_latency_000001=first, timeline_latency_000002=second, timeline_latency_x=head + b"99,no,x\n")
    folder(tmp_path, "b", timeline_latency=b"rel_seconds,target\n", timeline_system=b"rel_seconds\n1\n")
    (tmp_path / "loose").mkdir()
    (tmp_path / "loose" / "timeline_latency.csv").write_bytes(first)
    raw = folder_files.registered(spark).read.format("run_timeline").option("table", "latency").option("block", block).load(str(tmp_path))
    rows = raw.orderBy("row_ord").collect()
    assert {r.run_folder for r in rows} == {"a"} and [r.rel_seconds for r in rows] == [str(i) for i in range(45)]
    assert len({r.row_ord for r in rows}) == 45 and rows[0].row_ord == len(head) and rows[-1].row_ord == len(first) + second.rindex(b"44,")
    assert [r.target for r in rows[39:]] == ["t39", "a,b", None, None, "", "é"] and rows[0].hostname_resolved is None
    assert raw.filter("run_folder = 'none'").count() == 0


def test_written_folders_read_back(spark, tmp_path):
    rows = [("a", i, float(i % 7), f'x,"{i}"' if i % 2 else None) for i in range(50)] + [("b", 0, None, "")]
    table = spark.createDataFrame(rows, "run_id string, row_ord long, rel_seconds double, name string").withColumn("pid", F.col("row_ord"))
    manifest = table.select("run_id").distinct().select(F.col("run_id").alias("run_folder"), F.lit("manifest.json").alias("file"), F.to_json(F.struct("run_id")).alias("text"))
    events = table.select("run_id", "row_ord", F.lit("process_started").alias("event"), "pid")
    writers.write_run_folders([manifest, writers.timeline_files(table, "process", 8), writers.array_files(events, "process_events", "row_ord", 6)], str(tmp_path))
    assert len(list((tmp_path / "a").glob("timeline_processes_*.csv"))) == 7 and not list(tmp_path.glob(".writing*"))
    back = run_folders.read_process(spark, str(tmp_path)).orderBy("run_id", "row_ord").collect()
    want = sorted(rows, key=lambda r: (r[0], r[2] is not None, r[2] or 0, r[1]))
    assert [(r.run_id, r.pid, r.rel_seconds, r.name) for r in back] == want
    assert run_folders.read_process_events(spark, str(tmp_path)).agg(F.count(F.lit(1)), F.sum("pid")).first()[:] == (51, sum(range(50)))


def test_a_run_that_is_written_again_replaces_its_rows_alone(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "run_id string, row_ord long, v double"
    rows = lambda run, n, v: [(run, i, float(v)) for i in range(n)]
    put = lambda found, **more: store.put(spark.createDataFrame(found, schema), path, ("row_ord",), **more)
    held = lambda: {(r.run_id, r.v): r["count"] for r in store.get(spark, path, schema).groupBy("run_id", "v").count().collect()}
    assert held() == {}
    put(rows("a", 5, 1) + rows("b", 3, 1) + rows("c", 2, 1))
    put(rows("b", 4, 2) + rows("d", 1, 2))
    assert held() == {("a", 1): 5, ("b", 2): 4, ("c", 1): 2, ("d", 2): 1}
    put([], runs=spark.createDataFrame([("a",)], "run_id string"))
    assert held() == {("b", 2): 4, ("c", 1): 2, ("d", 2): 1}
    version, entries = store.manifest(spark, path)
    assert version == 3 and entries.agg(F.sum("row_count")).first()[0] == 7
    assert len(list((tmp_path / "s" / "data").iterdir())) == 3  # no folder per run
