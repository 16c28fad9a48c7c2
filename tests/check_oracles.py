"""Run registered queries in Spark and DuckDB and compare: python tests/check_oracles.py [folder] [name ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
import pandas as pd


def duck(folder: str):
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith(("string", "str")):
            df[c] = df[c].map(lambda v: "<null>" if v is None or v is pd.NA or v != v else str(v))
        else:
            df[c] = df[c].astype("float64") + 0.0
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = tidy(got), tidy(want)
    for c in a.columns:
        x, y = a[c], b[c]
        if str(x.dtype) != str(y.dtype):
            return f"{c}: dtype {got[c].dtype} vs {want[c].dtype}"
        bad = ~((x == y) | (x.isna() & y.isna()))
        if bad.any():
            k = bad.idxmax()
            return f"{c}: {bad.sum()} differ, e.g.\n{a.loc[k].to_dict()}\n{b.loc[k].to_dict()}"
    return None


def main() -> int:
    from conftest import make_session

    from perfloom.plans.catalog import QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, failed = make_session(), duck(folder), []
    for name in names:
        q = QUERIES[name]
        t = time.time()
        try:
            got = q.run(spark, folder).toPandas()
            spent = time.time() - t
            problem = None if q.sql is None else compare(got, con.execute(q.oracle()).df())
            rows = len(got)
        except Exception as e:
            problem, rows, spent = f"{type(e).__name__}: {str(e)[:600]}", -1, time.time() - t
            if "-v" in names:
                traceback.print_exc()
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={rows} {spent:.1f}s" + (f"\n    {problem}" if problem else ""), flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
