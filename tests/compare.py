"""Row-exact comparison of a Spark result with the result of its SQL twin."""

from __future__ import annotations

import glob
import math
import os

import duckdb

_FAMILY = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "INTEGER": "int", "BIGINT": "int",
           "HUGEINT": "huge", "double": "double", "DOUBLE": "double", "float": "float", "FLOAT": "float",
           "string": "str", "VARCHAR": "str", "timestamp_ntz": "ts", "TIMESTAMP": "ts", "boolean": "bool",
           "BOOLEAN": "bool", "date": "date", "DATE": "date"}


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    got_types = dict(df.dtypes)
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    types = [f"{c}: {got_types[c]} vs {want_types[c]}" for c in names
             if _FAMILY.get(got_types[c], got_types[c]) != _FAMILY.get(want_types[c], want_types[c])
             and not got_types[c].startswith("array") and not got_types[c].startswith("struct")]
    if types:
        return "types " + "; ".join(types)
    cols = sorted(names)
    pos = [names.index(c) for c in cols]
    a = sorted(tuple(_cell(r[c]) for c in cols) for r in got)
    b = sorted(tuple(_cell(r[i]) for i in pos) for r in want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; first {[x for x in a if x not in set(b)][:1]} {[x for x in b if x not in set(a)][:1]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        x, y = (only_a or [()])[0], (only_b or [()])[0]
        diff = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q][:6]
        return f"{len(only_a)} of {len(a)} rows differ, first: {diff}"
    if not a:
        return "both empty"
    return None
