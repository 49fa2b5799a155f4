"""Holds a query's rows against DuckDB's for its oracle SQL."""

import decimal
import math

import duckdb

from lodestone.plans.dialect import TABLES


def plain(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    return v


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def same(df, relation):
    """None, or what differs."""
    cols = sorted(df.columns)
    if cols != sorted(relation.columns):
        return f"columns {cols} and {sorted(relation.columns)}"
    at = [relation.columns.index(x) for x in cols]
    key = lambda r: tuple(repr(x) for x in r)
    a = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{x}`" for x in cols]).collect()), key=key)
    b = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=key)
    a = [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in a]
    b = [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in b]
    if a == b:
        return None
    return f"{len(a)} and {len(b)} rows; " + str(next(((x, y) for x, y in zip(a, b) if x != y), ""))[:300]
