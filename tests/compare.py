"""Runs a query and its SQL equivalent side by side and compares the rows as bags."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from checks.registry import TABLES


def oracle(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, decimal.Decimal)):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.10g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canonical(x) for x in v) + "]"
    return str(v)


def bag(columns: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def spark_bag(df):
    return bag(df.columns, [tuple(r) for r in df.collect()])


def duck_bag(con, sql: str):
    cursor = con.execute(sql)
    return bag([d[0] for d in cursor.description], cursor.fetchall())


def difference(a, b) -> str | None:
    """None when equal, otherwise what differs."""
    if a[0] != b[0]:
        return f"columns {a[0]} != {b[0]}"
    if a[1] == b[1]:
        return None
    left, right = set(a[1]), set(b[1])
    return f"{len(a[1])} vs {len(b[1])} rows; only left {sorted(left - right)[:3]}; only right {sorted(right - left)[:3]}"
