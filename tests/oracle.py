"""Run a registered query and its SQL twin on the same tables and compare the rows."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, Decimal):
        return "decimal"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    got_cols = spark_df.columns
    got = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    order = sorted(got_cols)
    gi, wi = [got_cols.index(c) for c in order], [want_cols.index(c) for c in order]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for pos, name in enumerate(order):
        gk = {kind(r[gi[pos]]) for r in got if r[gi[pos]] is not None}
        wk = {kind(r[wi[pos]]) for r in want if r[wi[pos]] is not None}
        if gk != wk:
            return f"type of {name}: {gk} vs {wk}"
    g = sorted((tuple(plain(r[i]) for i in gi) for r in got), key=_key)
    w = sorted((tuple(plain(r[i]) for i in wi) for r in want), key=_key)
    for x, y in zip(g, w):
        for name, u, v in zip(order, x, y):
            if u != v and not (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 1e-9 * max(1, abs(v))):
                return f"{name}: {u!r} vs {v!r} in {x} / {y}"
    return None if got else "EMPTY"
