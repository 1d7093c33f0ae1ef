"""Named queries, each next to the SQL that should give the same rows.

``edge`` lists the output columns once for both sides: a bare name is taken
as it is, ``d:`` marks a date (ISO text), ``i:`` a whole number and ``r:`` a
real number rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.plans.sql import BASE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Means of values with few decimals often end exactly on a half of the last
# kept place, where the order of a sum decides.  Adding slightly more than a
# half sends all of those up.
SCALE = 1000000.0
HALF = 0.501


def _parts(edge: str) -> list[tuple[str, str]]:
    out = []
    for item in edge.split("|") if "|" in edge else edge.split():
        item = item.strip()
        kind, name = (item[0], item[2:]) if item[1:2] == ":" else ("", item)
        out.append((kind, name))
    return out


def _spark_column(kind: str, name: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "d":
        c = F.date_format(c, "yyyy-MM-dd")
    elif kind == "i":
        c = c.cast("long")
    elif kind == "r":
        c = F.floor(c.cast("double") * SCALE + HALF) / SCALE
    return c.alias(name)


def _sql_column(kind: str, name: str) -> str:
    c = f'"{name}"'
    if kind == "d":
        c = f"strftime({c}, '%Y-%m-%d')"
    elif kind == "i":
        c = f"CAST({c} AS BIGINT)"
    elif kind == "r":
        c = f"floor(CAST({c} AS DOUBLE) * {SCALE} + {HALF}) / {SCALE}"
    return f'{c} AS "{name}"'


def query(name: str, edge: str | None = None, sql: str | None = None, ctes: str = "", base: bool = True):
    """Register a query; ``sql`` is its select, ``ctes`` what goes before it."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df if edge is None else df.select(*[_spark_column(k, n) for k, n in _parts(edge)])

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            columns = ", ".join(_sql_column(k, n) for k, n in _parts(edge))
            before = [p for p in ((BASE if base else ""), ctes.strip().rstrip(","), f"result AS ({sql})") if p]
            ORACLES[name] = "WITH RECURSIVE " + ",\n".join(before) + f"\nSELECT {columns} FROM result"
        return fn
    return register
