"""Runs registered queries against their DuckDB SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "date": "DATE",
}


def compare(df, con, sql: str) -> str:
    """Empty text if equal, else what differs."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} != {sorted(rel.columns)}"
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema:
        have = f.dataType.simpleString()
        want = _TYPES.get(have)
        if want and types[f.name] != want and not (want == "TIMESTAMP" and types[f.name].startswith("TIMESTAMP")):
            return f"type of {f.name}: {have} != {types[f.name]}"
    left = sorted((tuple(_norm(r[n]) for n in names) for r in df.collect()), key=repr)
    at = [rel.columns.index(n) for n in names]
    right = sorted((tuple(_norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if left == right:
        return "" if left else "both sides empty"
    here, there = set(left), set(right)
    extra = [r for r in left if r not in there][:2]
    missing = [r for r in right if r not in here][:2]
    return f"{len(left)} rows != {len(right)} rows; spark only {extra}; duckdb only {missing}"
