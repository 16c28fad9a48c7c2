"""Queries whose results SQL can express, against that SQL on the smallest tables, and on odd rows."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check_oracles import compare, duck

from perfloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_topk", "op5_warc", "op6_chat_format"])
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER).toPandas(), duck(FOLDER).execute(SQL[name]).df()) is None


def test_odd_conversations_equal_sql(spark, tmp_path):
    said = ["</s>[INST] ok [/INST]", "a\\<|end|>\\", "<<|", None, "é\u0001<|turn|>", "", "<<SYS>> x <</SYS>> <start_of_turn>", "😀<s>"]
    rows = [(i % 4 or None, i // 3, ["user", "assistant", None, "system"][i % 4], t) for i, t in enumerate(said * 5)] + [(9, None, "assistant", "x" * 200_000)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duck(tmp_path / "none")
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare(QUERIES["op6_chat_format"](spark, str(tmp_path)).toPandas(), con.execute(SQL["op6_chat_format"]).df()) is None


def test_odd_pages_equal_sql(spark, tmp_path):
    page = "<p>" + "é" * 120
    rows = [(3, "u", page), (1, None, page), (2, "u", page + " "), (4, "u", None), (5, "u", "é"), (6, "u", "é"), (None, "u", page), (1, "u", page), (7, "u", "x" * 300_000), (8, "u", "x" * 300_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duck(tmp_path / "none")
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert compare(QUERIES["op5_warc"](spark, str(tmp_path)).toPandas(), con.execute(SQL["op5_warc"]).df()) is None
