"""Runs a registered query and its SQL on the same tables and compares them row by row."""

import os

import duckdb
import pandas as pd


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, bool) or str(type(v).__name__) == "bool":
            return str(bool(v))
        if isinstance(v, str):
            return v
        return f"{float(v) + 0.0:.9g}"

    columns = sorted(df.columns)
    return sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False, name=None))


def same(spark, query, sql: str, sf_dir: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), views(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert [x for x, y in zip(a, b) if x != y][:3] == [y for x, y in zip(a, b) if x != y][:3]
