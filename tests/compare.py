"""Run a query and its SQL over the same files and compare rows and column types."""

import math
from pathlib import Path

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "timestamp": "TIMESTAMP", "tinyint": "TINYINT"}


def normal(v, digits=9):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.{digits}g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def connect(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def differences(df, sql, con):
    """Empty if both give the same rows; else what differs."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} / {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    odd = [(c, t, kinds[c]) for c, t in df.dtypes if t in TYPES and TYPES[t] != kinds[c]]
    if odd:
        return f"types {odd}"
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    a = sorted((tuple(normal(r[c]) for c in names) for r in df.collect()), key=key)
    b = sorted((tuple(normal(x) for x in r) for r in rel.select(*(duckdb.ColumnExpression(c) for c in names)).fetchall()), key=key)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {names} {bad[:3]}" if bad else ""
