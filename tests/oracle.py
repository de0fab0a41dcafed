"""Compare a Spark result with DuckDB's on the same tables: names, row count, and values in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v: object) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v + 0.0:.6f}"
    if isinstance(v, list):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(names: list[str], data: list) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted("|".join(plain(r[i]) for i in order) for r in data)


def check(spark, con: duckdb.DuckDBPyConnection, query, sql: str, sf_dir: str) -> None:
    got = query(spark, sf_dir)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(list(want.columns), want.fetchall())
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)
