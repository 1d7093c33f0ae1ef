"""Joins by series and month.

No side is hinted as broadcast: the planner measures each side and broadcasts
only below ``spark.sql.autoBroadcastJoinThreshold``, otherwise it sorts and
merges, splitting partitions that one key makes large.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthloom.functions import calendar as cal
from monthloom.operators.validate import require_none
from monthloom.spec import PanelSpec


def left_by_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left equi-join; a non-key name on both sides keeps the left column."""
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.drop(*clash), keys, "left")


def join_observed(forecast: DataFrame, history: DataFrame, spec: PanelSpec, how: str = "inner") -> DataFrame:
    """Forecast rows with the observed target of the same series and month."""
    seen = history.select(*spec.keys, F.col(spec.target).alias("observe"))
    return forecast.join(seen, spec.keys, how)


def lookup_table(spark: SparkSession, name: str, values: Mapping[str, object], schema: T.StructType) -> DataFrame:
    """Small fixed dictionary as a table; ``schema`` names the value columns."""
    rows = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in values.items()]
    return spark.createDataFrame(rows, T.StructType([T.StructField(name, T.StringType(), False), *schema.fields]))


def strict_lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Lookup whose key must exist: the rows of an unknown key fail the job."""
    marked = table.withColumn("_found", F.lit(True))
    joined = df.join(marked, key, "left")
    found = F.coalesce(
        F.col("_found"),
        F.raise_error(F.concat(F.lit(f"no entry for {key} "), F.coalesce(F.col(key), F.lit("null")))).cast("boolean"),
    )
    return joined.filter(found).drop("_found")


def lookup_or(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    return df.join(table, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def only_requested(df: DataFrame, months: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(months.select(*keys).distinct(), keys, "left_semi")


def asof_before(
    requests: DataFrame,
    observed: DataFrame,
    series: list[str],
    time: str,
    values: list[str],
    suffix: str = "",
    unique: bool = False,
) -> DataFrame:
    """Latest observation strictly before each request, per series.

    Requests are first reduced to distinct (series, month) pairs, so the
    merged sequence of a series is no longer than twice its months, whatever
    the number of requests; the result is joined back by equality.  Requests
    that consist of the pair alone and are ``unique`` need neither step.
    """
    if unique and set(requests.columns) != {*series, time}:
        raise ValueError("unique requests hold the series and the month only")
    pairs = requests if unique else requests.select(*series, time).distinct()
    asked = pairs.select(*series, F.col(time), F.lit(0).alias("_seen"), F.lit(None).alias("_row"))
    row = F.struct(F.col(time).alias("observed_at"), *[F.col(v) for v in values])
    seen = observed.select(*series, F.col(time), F.lit(1).alias("_seen"), row.alias("_row"))
    # at an equal month the request sorts first, which makes "before" strict
    w = Window.partitionBy(*series).orderBy(time, "_seen").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        asked.unionByName(seen)
        .withColumn("_last", F.last("_row", ignorenulls=True).over(w))
        .filter(F.col("_seen") == 0)
        .select(
            *series, time,
            F.col("_last.observed_at").alias("observed_at"),
            *[F.col(f"_last.`{v}`").alias(f"{v}{suffix}") for v in values],
        )
    )
    return found if unique else requests.join(found, [*series, time], "left")


def months_for_series(keys: DataFrame, start: Column, stop: Column, time: str) -> DataFrame:
    """Every series with every month from ``start`` to ``stop``."""
    return keys.withColumn(time, F.explode(cal.month_list(start, stop)))


def by_month_of_year(future: DataFrame, table: DataFrame, spec: PanelSpec, month: str = "month") -> DataFrame:
    """Attach a (series, month of year) table to future months."""
    return (
        future.withColumn(month, F.month(spec.time))
        .join(table, [*spec.series, month], "left")
    )


def strict_by_month_of_year(
    future: DataFrame, table: DataFrame, spec: PanelSpec, month: str = "month", on_problem: str = "raise"
) -> DataFrame:
    """As above, but an absent month is an error, or a row with a ``problem`` (``mark``)."""
    if on_problem == "mark":
        found = by_month_of_year(future, table.withColumn("_found", F.lit(True)), spec, month)
        problem = F.when(F.col("_found").isNull(), F.lit("no source row for the month"))
        return found.withColumn("problem", problem).drop("_found")
    keyed = future.withColumn(month, F.month(spec.time))
    absent = keyed.select(*spec.series, month).distinct().join(
        table.select(*spec.series, month), [*spec.series, month], "left_anti"
    )
    require_none(absent, "months without a source row")
    return by_month_of_year(future, table, spec, month)


def year_before(df: DataFrame, history: DataFrame, spec: PanelSpec, name: str = "year_before") -> DataFrame:
    """Target of the same series twelve months earlier."""
    shifted = history.select(
        *spec.series,
        F.add_months(spec.time, 12).alias(spec.time),
        F.col(spec.target).alias(name),
    )
    return df.join(shifted, spec.keys, "left")


def difference_by_month(left: DataFrame, right: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``left - right`` aligned on the keys; a key on one side only gives null."""
    return (
        left.select(*keys, F.col(value).alias("_left"))
        .join(right.select(*keys, F.col(value).alias("_right")), keys, "full")
        .select(*keys, (F.col("_left") - F.col("_right")).alias(name))
    )
