"""Compares queries with their SQL on the test tables, value by value."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb


def connection(d: str):
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{d}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, run, sql, d):
    df = run(spark, d)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = normal(df.columns, [tuple(r) for r in df.collect()]), normal(names, cur.fetchall())
    if a == b:
        return ""
    return f"{len(a)} and {len(b)} rows; {[x for x in a if x not in set(b)][:2]} and {[x for x in b if x not in set(a)][:2]}"
