"""Runs a registered query and its SQL on the same tables and compares rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    return _rows(columns, cursor.fetchall())


def difference(left, right) -> str:
    """Empty when equal; otherwise what differs, with an example."""
    (lc, lr), (rc, rr) = left, right
    if lc != rc:
        return f"columns {lc} != {rc}"
    if len(lr) != len(rr):
        return f"{len(lr)} rows != {len(rr)} rows: {lr[:2]} {rr[:2]}"
    for a, b in zip(lr, rr):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{lc}: {a} != {b}"
    return ""
