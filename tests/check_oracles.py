"""Runs registered queries next to their check SQL in DuckDB: python tests/check_oracles.py [sf_dir] [name parts...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as spark_entry  # noqa: E402
from tidemark.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else
                          repr(float(v)) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def run_sql(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return pd.DataFrame(cur.fetchall(), columns=[c[0] for c in cur.description], dtype=object)


def run_query(spark, sf_dir: str, name: str) -> pd.DataFrame:
    df = spark_entry.queries()[name](spark, sf_dir)
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = canonical(got), canonical(want)
    same = (a == b) | (a.isna() & b.isna())
    if same.all().all():
        return ""
    bad = ~same.all(axis=1)
    cols = [c for c in a.columns if not same[c].all()]
    keys = [c for c in a.columns if c not in cols][:4]
    i = bad[bad].index[:4]
    return f"{int(bad.sum())} of {len(a)} rows differ in {cols}\n{a.loc[i, keys + cols]}\n{b.loc[i, keys + cols]}"


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    oracles, bad, rows_only = spark_entry.oracle_sql(), 0, 0
    for name in spark_entry.queries():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        t = time.time()
        try:
            got = run_query(spark, sf, name)
            took = time.time() - t
            if name not in oracles:
                rows_only += 1
                print(f"rows  {name:34s} {took:6.2f}s {len(got)} rows", flush=True)
                continue
            t = time.time()
            msg = compare(got, run_sql(sf, oracles[name]))
            sql_took = time.time() - t
        except Exception as e:  # noqa: BLE001
            msg, took, sql_took, got = f"{type(e).__name__}: {str(e)[:1500]}", time.time() - t, 0, []
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '}  {name:34s} {took:6.2f}s sql {sql_took:5.2f}s {len(got)} rows {msg}", flush=True)
    print(f"{bad} failed, {rows_only} without SQL")


if __name__ == "__main__":
    main()
