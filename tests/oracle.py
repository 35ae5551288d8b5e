"""Runs a query's SQL on DuckDB over the same tables and compares rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float("%.9g" % v) if v else 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def difference(df, relation) -> str:
    """What differs between a Spark result and a DuckDB relation; empty if nothing."""
    columns = sorted(df.columns)
    if sorted(relation.columns) != columns:
        return f"columns {columns} and {sorted(relation.columns)}"
    at = [relation.columns.index(c) for c in columns]
    a = Counter(repr(tuple(norm(v) for v in r)) for r in df.select(*columns).collect())
    b = Counter(repr(tuple(norm(r[i]) for i in at)) for r in relation.fetchall())
    return "" if a == b else f"only in Spark {list((a - b).items())[:2]}, only in SQL {list((b - a).items())[:2]}"
