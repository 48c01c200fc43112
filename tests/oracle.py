"""Side-by-side comparison of a query with its SQL oracle."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


KINDS = {"int32": "INTEGER", "int64": "BIGINT", "float64": "DOUBLE", "bool": "BOOLEAN"}
SPARK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR",
         "date": "DATE", "timestamp": "TIMESTAMP"}


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(cell(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(df, con, sql: str, limit: int = 3) -> list[str]:
    names = df.columns
    types = {f.name: SPARK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want_names, want_types = list(rel.columns), dict(zip(rel.columns, map(str, rel.types)))
    want = rel.fetchall()
    out = []
    if sorted(names) != sorted(want_names):
        return [f"columns {sorted(names)} != {sorted(want_names)}"]
    bad = {n: (types[n], want_types[n]) for n in names if types[n] != want_types[n]}
    if bad:
        out.append(f"types {bad}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    a, b = rows(names, got), rows(want_names, want)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        out.append(f"{len(diff)} rows differ ({sorted(names)})")
        out += [f"   got {x}\n  want {y}" for x, y in diff[:limit]]
    if not a:
        out.append("no rows")
    return out
