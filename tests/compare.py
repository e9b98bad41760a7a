"""Compare queries with their SQL in DuckDB, as multisets of normalised rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
from collections import Counter

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(p)[: -len(".parquet")]
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{src}'")
    return c


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of_spark(df) -> tuple[list[str], Counter]:
    cols = sorted(df.columns)
    return cols, Counter(tuple(_norm(v) for v in r) for r in df.select(*cols).collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in cur.fetchall())


def differences(df, con, sql: str) -> str | None:
    """None if both agree, else a short account."""
    a_cols, a = rows_of_spark(df)
    b_cols, b = rows_of_sql(con, sql)
    if a_cols != b_cols:
        return f"columns {a_cols} and {b_cols}"
    if a == b:
        return None
    return f"rows {sum(a.values())} and {sum(b.values())}; only here {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
