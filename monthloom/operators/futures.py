"""Measures for months that have not been observed yet.

Every builder returns ``(series, month, measures)`` for all series at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions import calendar as cal
from monthloom.functions import maths
from monthloom.operators.aggregate import climatology
from monthloom.operators.clean import override_values
from monthloom.operators.joins import by_month_of_year, months_for_series, strict_by_month_of_year
from monthloom.spec import PanelSpec


def future_months(history: DataFrame, spec: PanelSpec, start: Column, periods: int) -> DataFrame:
    """All series with ``periods`` months from ``start``."""
    keys = history.select(*spec.series).distinct()
    return months_for_series(keys, start, F.add_months(start, periods - 1), spec.time)


def after_history(history: DataFrame, spec: PanelSpec) -> Column:
    """Month after the last month on record over all series."""
    return history.agg(F.add_months(F.max(spec.time), 1).alias("start")).scalar()


def from_climatology(history: DataFrame, months: DataFrame, spec: PanelSpec) -> DataFrame:
    return by_month_of_year(months, climatology(history, spec), spec).select(*spec.keys, *spec.exog)


def from_year(history: DataFrame, months: DataFrame, spec: PanelSpec, year: int, on_problem: str = "raise") -> DataFrame:
    """Observed measures of one year, month by month; an absent month is an error, or marked (``mark``)."""
    source = history.filter(F.year(spec.time) == year).select(
        *spec.series, F.month(spec.time).alias("month"), *spec.exog
    )
    found = strict_by_month_of_year(months, source, spec, on_problem=on_problem)
    return found.select(*spec.keys, *spec.exog, *(["problem"] if on_problem == "mark" else []))


def by_persistence(
    history: DataFrame, spec: PanelSpec, start: Column, periods: int, repeat: int = 12, if_none: float | None = None
) -> DataFrame:
    """Last ``repeat`` rows of each series repeated cyclically over the horizon.

    ``if_none`` stands for the measures of a series without any row; a measure
    that is null in a row stays null.
    """
    row = F.struct(spec.time, *spec.exog)
    tail = history.groupBy(*spec.series).agg(
        F.slice(
            F.array_sort(F.collect_list(row)),
            -F.least(F.lit(repeat), F.count(F.lit(1)).cast("int")),
            repeat,
        ).alias("_tail")
    )
    none = F.lit(if_none).cast("double")

    def at(month: Column, step: Column) -> Column:
        source = maths.cyclic_pick(F.col("_tail"), step + 1)
        return F.struct(month.alias(spec.time), *[
            F.when(F.size("_tail") > 0, source[m]).otherwise(none).alias(m) for m in spec.exog])

    # picked inside the array, so no row carries the whole tail
    months = tail.withColumn("_months", cal.months_from(start, periods))
    return months.select(*spec.series, F.inline(F.transform("_months", at)))


def constant(months: DataFrame, spec: PanelSpec, values: dict[str, float]) -> DataFrame:
    return months.select(*spec.keys, *[F.lit(values[m]).cast("double").alias(m) for m in spec.exog])


def with_overrides(base: DataFrame, overrides: DataFrame, spec: PanelSpec) -> DataFrame:
    """Measures of ``overrides`` win where given; others keep the base value."""
    return override_values(base, overrides, spec.keys, [m for m in spec.exog if m in overrides.columns])
