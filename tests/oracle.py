"""Compare a query with its SQL on DuckDB: rows as multisets, columns by name."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def compare(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty when equal, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns: {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in result.fetchall())
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    if want == got:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only here: {list((got - want).items())[:2]}; only in SQL: {list((want - got).items())[:2]}"[:1500]
