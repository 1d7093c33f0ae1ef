"""Filters, column shaping and cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions import calendar as cal


def with_parsed_french_months(df: DataFrame, column: str = "PERIODE") -> DataFrame:
    return df.withColumn(column, cal.or_fail(cal.parse_french_month(column), column, "month"))


def sort_by_french_month(df: DataFrame, column: str = "PERIODE") -> DataFrame:
    """Order by the month a French text names; no helper column is left."""
    return df.orderBy(cal.parse_french_month(column).asc_nulls_last())


def keep_months(
    df: DataFrame,
    time: str,
    since: Column | None = None,
    until: Column | None = None,
    before: Column | None = None,
) -> DataFrame:
    """``since <= t``, ``t <= until`` and ``t < before``, whichever are given."""
    if since is not None:
        df = df.filter(F.col(time) >= since)
    if until is not None:
        df = df.filter(F.col(time) <= until)
    if before is not None:
        df = df.filter(F.col(time) < before)
    return df


def keep_keys(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.filter(F.col(column).isin(*values))


def insert_before(df: DataFrame, new: list[str], anchor: str) -> DataFrame:
    """Move ``new`` columns in front of ``anchor``."""
    rest = [c for c in df.columns if c not in new]
    at = rest.index(anchor)
    return df.select(*[F.col(f"`{c}`") for c in rest[:at] + list(new) + rest[at:]])


def align_columns(df: DataFrame, columns: list[str], absent=0) -> DataFrame:
    """Exactly ``columns``: absent ones filled with a constant, others dropped."""
    have = set(df.columns)
    return df.select(*[
        F.col(f"`{c}`") if c in have else F.lit(absent).alias(c) for c in columns
    ])


def with_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(labels))


def override_values(base: DataFrame, overrides: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Values of ``overrides`` win where they are not null."""
    renamed = overrides.select(*on, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(renamed, on, "left")
    return joined.withColumns({
        c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns
    }).drop(*[f"_new_{c}" for c in columns])


def drop_repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicates(keys)


def profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per column: type, rows, non-null rows; distinct values of keys.

    A single aggregate over the table; its one row is turned into long form.
    """
    counts = [F.count(F.lit(1)).alias("_rows")]
    counts += [F.count(F.col(f"`{c}`")).alias(f"_n_{i}") for i, c in enumerate(df.columns)]
    counts += [F.countDistinct(F.col(f"`{k}`")).alias(f"_d_{i}") for i, k in enumerate(keys)]
    where = {k: i for i, k in enumerate(keys)}
    entries = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(dtype).alias("column_type"),
            F.col("_rows").alias("row_count"),
            F.col(f"_n_{i}").alias("non_null"),
            (F.col(f"_d_{where[name]}") if name in where else F.lit(None).cast("long")).alias("distinct_keys"),
        )
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    return df.agg(*counts).select(F.inline(F.array(*entries)))


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)
