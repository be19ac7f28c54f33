"""Side-by-side comparison of a registered query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=repr)


_SQL_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP",
}


def _types(df, result):
    """Columns whose types differ."""
    got = {name: _SQL_TYPES.get(kind, kind) for name, kind in df.dtypes}
    want = {c[0]: str(c[1]) for c in result.description}
    return {n: (got[n], want[n]) for n in got if got[n] != want[n] and got[n] in _SQL_TYPES.values()}


def compare(df, con, sql) -> str | None:
    """None when names and all values agree exactly, else what differs."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    differing = _types(df, result)
    if differing:
        return f"types {differing}"
    want = _sorted(result.fetchall(), names)
    got = _sorted([tuple(r) for r in df.collect()], df.columns)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"spark {a!r}\n  sql {b!r}"[:1500]
    return None
