"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return float(v) if isinstance(v, decimal.Decimal) else v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)) if x is None else "", str(x)) for x in r))


def differences(df, con, sql: str) -> str:
    """Empty if equal."""
    rel = con.sql(sql)
    columns, kinds = list(rel.columns), [str(t) for t in rel.types]
    want, got = normal(columns, rel.fetchall()), normal(df.columns, [tuple(r) for r in df.collect()])
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if bad := [(c, k) for c, k in zip(columns, kinds) if k.startswith(("HUGEINT", "DECIMAL"))]:
        return f"types {bad}"
    mine = dict(df.dtypes)
    names = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
    if bad := [(c, k, mine[c]) for c, k in zip(columns, kinds) if names.get(k) not in (mine[c], None)]:
        return f"types {bad}"
    if want != got:
        return f"{len(got)} and {len(want)} rows: " + "; ".join(f"{a} / {b}" for a, b in zip(got, want) if a != b)[:400]
    return ""
