"""Runs queries and their SQL side by side: python tests/compare.py [-d folder] NAME..."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con.execute(sql).df()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "∅" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else f"{v}")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark_df, folder: str, sql: str) -> tuple[bool, str]:
    a, b = canonical(spark_df.toPandas()), canonical(duck(folder, sql))
    if list(a.columns) != list(b.columns) or len(a) != len(b):
        return False, f"{list(a.columns)} {len(a)} against {list(b.columns)} {len(b)}"
    if a.equals(b):
        return True, f"{len(a)} rows"
    d = (a != b).any(axis=1)
    return False, f"{d.sum()} of {len(a)} rows differ\n{a[d].head(3)}\n{b[d].head(3)}"


if __name__ == "__main__":
    import __spark_entry__ as e

    from cinegrid.session import local_session

    args = sys.argv[1:]
    folder = args[1] if args[:1] == ["-d"] else "/root/testdata/sf0.01"
    names = args[2:] if args[:1] == ["-d"] else args
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    for name in names or e.queries():
        t = time.time()
        try:
            df = e.queries()[name](spark, folder)
            ok = same(df, folder, e.oracle_sql()[name]) if name in e.oracle_sql() else ("rows", f"{df.count()} rows")
        except Exception as x:  # shown, and the next one runs
            ok = (False, f"{type(x).__name__} {str(x)[:500]}")
        print(f"{name}: {ok[0]} {ok[1]} {time.time() - t:.1f} s", flush=True)
