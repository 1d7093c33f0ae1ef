"""Writers: every output is a folder of part files written by the executors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions import calendar as cal
from monthloom.functions.fixed import TARGET_LABEL, WEATHER_LABELS
from monthloom.spec import PanelSpec

NAME_LENGTH = 31


def save_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return path


def save_forecast(forecast: DataFrame, path: str) -> str:
    return save_csv(forecast, path)


def save_table(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def year_bucket(time: Column, train_until: int, test_until: int) -> Column:
    year = F.year(time)
    return (
        F.when(year <= train_until, "train").when(year <= test_until, "test").otherwise("remainder")
    )


def save_by_bucket(df: DataFrame, path: str, time: str, train_until: int = 2024, test_until: int = 2025) -> str:
    """One folder per bucket from a single pass; a reader of one bucket opens only it."""
    marked = df.withColumn("bucket", year_bucket(F.col(time), train_until, test_until))
    marked.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return path


def table_name(name: str) -> str:
    return name[:NAME_LENGTH]


def export_tables(tables: Mapping[str, DataFrame], root: str, fmt: str = "csv") -> dict[str, str]:
    """One folder per named table below ``root``; names are cut to 31 characters."""
    short = [table_name(name) for name in tables]
    if len(set(short)) < len(short):
        raise ValueError(f"table names are equal after {NAME_LENGTH} characters")
    out = {}
    for name, df in tables.items():
        path = f"{root}/{table_name(name)}"
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))
        out[name] = path
    return out


def labelled_history(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """History with display labels and the month as ``yyyy-MM``."""
    return panel.withColumn(spec.time, cal.month_key(spec.time)).withColumnsRenamed(
        {**WEATHER_LABELS, spec.target: TARGET_LABEL}
    )


def forecast_export(forecast: DataFrame, spec: PanelSpec) -> DataFrame:
    """Forecast with ISO months and predictions to one decimal (half-even)."""
    return forecast.select(
        *spec.series, cal.day_key(spec.time).alias(spec.time), F.bround("prediction", 1).alias("prediction")
    )


def weather_export(weather: DataFrame, spec: PanelSpec) -> DataFrame:
    return weather.select(*spec.series, cal.day_key(spec.time).alias(spec.time), *spec.exog)
