"""Runs a query and its SQL on the same tables and compares rows, regardless of order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        at = Path(sf_dir, f"{t}.parquet")
        if at.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}{'/*.parquet' if at.is_dir() else ''}')")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return ("f", repr(0.0 if v == 0 else v))
    if isinstance(v, decimal.Decimal):
        return ("d", str(v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return ("t", v.isoformat())
    if isinstance(v, dict):
        return tuple((k, _value(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    return (type(v).__name__, v)


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    names = sorted(df.columns)
    got = [tuple(_value(r[c]) for c in names) for r in (x.asDict(True) for x in df.collect())]
    result = con.sql(sql)
    if sorted(result.columns) != names:
        return f"columns {names} against {sorted(result.columns)}"
    at = [result.columns.index(c) for c in names]
    want = [tuple(_value(r[i]) for i in at) for r in result.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    key = repr
    got, want = sorted(got, key=key), sorted(want, key=key)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, as {names}: {bad[0][0]} against {bad[0][1]}" if bad else ""
