"""Comparing a query's rows with those that its DuckDB SQL gives over the same Parquet tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with every table under ``sf_dir`` as a view."""
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        inner = path if os.path.isfile(path) else f"{path}/*.parquet"
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{inner}')")
    return connection


def plain(value):
    """A value as both engines write it: numbers to nine significant places, lists as tuples."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return number if not math.isfinite(number) else float(f"{number:.9g}")
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows(columns: list[str], found) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(row[i]) for i in order) for row in found)


def difference(frame, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs between the rows of ``frame`` and of ``sql``; empty if nothing does."""
    answer = connection.execute(sql)
    names = [c[0] for c in answer.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    ours, theirs = rows(frame.columns, frame.collect()), rows(names, answer.fetchall())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:2]}; only theirs {list((theirs - ours).items())[:2]}"
