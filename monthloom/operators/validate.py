"""Checks that name what is wrong.

Checks over data return a DataFrame of problems; ``require_none`` turns a
non-empty one into an error that shows the first few and the total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions import calendar as cal
from monthloom.spec import PanelSpec

SHOWN = 20


class InvalidInput(ValueError):
    """Raised when an input breaks a stated requirement."""


def require_columns(df: DataFrame, columns, what: str = "table") -> None:
    """Schema check only; starts no job."""
    have = set(df.columns)
    missing = [c for c in columns if c not in have]
    if missing:
        raise InvalidInput(f"{what}: missing columns: {', '.join(missing)}")


def require_none(problems: DataFrame, message: str) -> None:
    """Raise if ``problems`` has rows; the error shows the first few and the total."""
    kept = problems.persist()
    try:
        shown = kept.limit(SHOWN).collect()
        if not shown:
            return
        total = kept.count() if len(shown) == SHOWN else len(shown)
    finally:
        kept.unpersist()
    sample = "; ".join(", ".join(f"{k}={v}" for k, v in row.asDict().items()) for row in shown)
    raise InvalidInput(f"{message} ({total} rows): {sample}")


def duplicate_months(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def missing_months(required: DataFrame, weather: DataFrame, keys: list[str]) -> DataFrame:
    """Required (series, month) pairs that the weather does not cover."""
    return required.select(*keys).distinct().join(weather.select(*keys), keys, "left_anti")


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count of each column in one aggregate, in long form, non-zero only."""
    counts = df.agg(*[
        F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"_n_{i}") for i, c in enumerate(columns)
    ])
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_n_{i}").alias("missing"))
        for i, c in enumerate(columns)
    ])
    return counts.select(F.inline(entries)).filter(F.col("missing") > 0)


def require_values(df: DataFrame, columns: list[str]) -> None:
    require_none(missing_values(df, columns), "missing feature values")


def check_requests(requests: DataFrame, history: DataFrame, spec: PanelSpec, least: int = 12) -> DataFrame:
    """Problem of each forecast request ``(series, start, stop)``; null when fine.

    History is reduced to one row per series and start before it meets the
    requests, so its size does not matter to the join.
    """
    starts = requests.select(*spec.series, "start").distinct()
    known = history.groupBy(*spec.series).agg(
        F.array_sort(F.collect_list(F.col(spec.time))).alias("_months")
    )
    counted = starts.join(known, list(spec.series), "left").select(
        *spec.series,
        "start",
        F.col("_months").isNotNull().alias("_known"),
        F.when(
            F.col("_months").isNotNull(),
            F.size(F.filter("_months", lambda m: m < F.col("start"))),
        ).otherwise(0).alias("history_rows"),
    )
    problem = (
        F.when(~F.col("_known"), F.lit("unknown series"))
        .when(F.col("start") > F.col("stop"), F.lit("start is after stop"))
        .when(F.col("history_rows") == 0, F.lit("no history before start"))
        .when(
            F.col("history_rows") < least,
            F.concat(
                F.lit(f"at least {least} months of history are required, found "),
                F.col("history_rows").cast("string"),
            ),
        )
    )
    return (
        requests.join(counted, [*spec.series, "start"], "left")
        .withColumn("problem", problem)
        .drop("_known")
    )


def validate_weather(weather: DataFrame, required: DataFrame, spec: PanelSpec) -> DataFrame:
    """Columns present, no repeated month, every required month covered."""
    require_columns(weather, [*spec.keys, *spec.exog], "weather")
    clean = weather.withColumn(spec.time, cal.month_start(spec.time))
    require_none(duplicate_months(clean, spec), "weather has repeated months")
    require_none(missing_months(required, clean, spec.keys), "weather is missing months")
    return clean
