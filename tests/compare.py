"""Runs a query and its SQL twin side by side and compares rows, schema and values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

KINDS = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT",
    "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def database(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{path}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def difference(df, con, sql: str) -> str | None:
    """None if equal, else a short description of the first difference."""
    names = sorted(df.columns)
    result = con.execute(sql)
    sql_names = [d[0] for d in result.description]
    rows = result.fetchall()
    if sorted(sql_names) != names:
        return f"columns {names} != {sorted(sql_names)}"
    kinds = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    at = [sql_names.index(n) for n in names]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=_key)
    got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=_key)
    if len(want) != len(got):
        return f"rows: spark {len(got)}, sql {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, columns {names}, first: spark {bad[0][0]} sql {bad[0][1]}"
    return None
