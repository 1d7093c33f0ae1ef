"""Feature frames: lags, rolling means, calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions import calendar as cal
from monthloom.operators import windows as win
from monthloom.spec import PanelSpec


def lag_names(spec: PanelSpec) -> list[str]:
    return [f"target_lag_{k}" for k in spec.lags]


def roll_names(spec: PanelSpec) -> list[str]:
    return [f"target_roll_mean_{n}" for n in spec.rolls]


CALENDAR = ("month", "year", "month_sin", "month_cos")


def calendar_columns(time: Column) -> dict[str, Column]:
    month = F.month(time)
    return {
        "month": month,
        "year": F.year(time),
        "month_sin": cal.cyclic_sin(month),
        "month_cos": cal.cyclic_cos(month),
    }


def create_features(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Lags, full-window rolling means and calendar: one exchange by series."""
    w = win.series_window(spec)
    columns = win.lag_columns(spec.target, spec.lags, w, "target_lag_")
    columns |= {f"target_roll_mean_{n}": win.rolling_mean(spec.target, n, w) for n in spec.rolls}
    columns |= calendar_columns(F.col(spec.time))
    return panel.withColumns(columns)


def create_district_features(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Calendar with quarter, lags, rolling means and first difference.

    Series are grouped by their own key.  ``diff_1`` contains the current
    target and is therefore left out of ``district_feature_names``.
    """
    w = win.series_window(spec)
    time = F.col(spec.time)
    columns = {"month": F.month(time), "quarter": F.quarter(time), "year": F.year(time)}
    columns |= win.lag_columns(spec.target, spec.lags, w, "lag_")
    columns |= {f"rolling_mean_{n}": win.rolling_mean(spec.target, n, w) for n in spec.rolls}
    columns["diff_1"] = F.col(spec.target) - F.lag(spec.target, 1).over(w)
    return panel.withColumns(columns)


def feature_names(spec: PanelSpec) -> list[str]:
    return [*spec.series, *spec.exog, *lag_names(spec), *roll_names(spec), *CALENDAR]


def district_feature_names(spec: PanelSpec) -> list[str]:
    return [
        *spec.exog, "month", "quarter", "year",
        *[f"lag_{k}" for k in spec.lags],
        *[f"rolling_mean_{n}" for n in spec.rolls],
    ]


def present_features(df: DataFrame, names: list[str]) -> list[str]:
    """Wanted names that the frame has, in the wanted order."""
    have = set(df.columns)
    return [c for c in names if c in have]


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def split_inputs(df: DataFrame, spec: PanelSpec, drop: list[str]) -> tuple[DataFrame, DataFrame]:
    """Inputs without the target and the named columns, and the target alone."""
    return df.drop(spec.target, *drop), df.select(spec.target)
