"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import decimal
import os

import duckdb
import pandas as pd


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}")
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.sql(sql).df()
