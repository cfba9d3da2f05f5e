"""Compares a query with its DuckDB SQL on one data folder."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{at}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else repr(round(float(v), 9)) if isinstance(v, float) else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def check(spark, name: str, query, sql: str, sf_dir: str) -> int:
    got = canonical(query(spark, sf_dir).toPandas())
    want = canonical(duck(sf_dir).execute(sql).df())
    assert list(got.columns) == list(want.columns), (name, list(got.columns), list(want.columns))
    assert len(got) == len(want), (name, len(got), len(want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, obj=name)
    return len(got)
