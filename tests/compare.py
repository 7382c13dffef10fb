"""Run a query and its SQL on the same tables and compare them row for row."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], Counter]:
    rel = con.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    return names, Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())


def differences(df, con, sql: str) -> str | None:
    names, got = rows_of_spark(df)
    wanted_names, wanted = rows_of_sql(con, sql)
    if names != wanted_names:
        return f"columns {names} instead of {wanted_names}"
    if got != wanted:
        extra, missing = got - wanted, wanted - got
        return (f"{got.total()} rows instead of {wanted.total()}; "
                f"extra {list(extra)[:3]}; missing {list(missing)[:3]}")
    return None
