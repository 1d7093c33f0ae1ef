"""Per-series window operators.

Every window is partitioned by the series key and ordered by month, so one
exchange on the series serves all of them, and a partition holds at most one
row per month of record (see ``PanelSpec``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions import calendar as cal
from monthloom.session import written
from monthloom.spec import PanelSpec


def series_window(spec: PanelSpec):
    return Window.partitionBy(*spec.series).orderBy(F.col(spec.time).asc_nulls_last())


def with_positions(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """Place of each row in a total order, counted from 1; no sort spans one task.

    Rows are dealt by ranges of the order and ranked in their range; the sizes
    of the ranges, one small row each, add up to the places before them.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = ranged.withColumn("_rank", rank).join(before, "_range")
    return ranked.withColumn(name, F.col("_before") + F.col("_rank")).drop("_range", "_rank", "_before")


def lag_columns(value: str, lags, window, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{k}": F.lag(value, k).over(window) for k in lags}


def rolling_mean(value: str, n: int, window) -> Column:
    """Mean of the previous ``n`` rows; null unless all ``n`` hold a value."""
    frame = window.rowsBetween(-n, -1)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def with_lags(df: DataFrame, spec: PanelSpec, prefix: str | None = None) -> DataFrame:
    prefix = f"{spec.target}_lag_" if prefix is None else prefix
    return df.withColumns(lag_columns(spec.target, spec.lags, series_window(spec), prefix))


def with_rolling_means(df: DataFrame, spec: PanelSpec, prefix: str | None = None) -> DataFrame:
    prefix = f"{spec.target}_roll_mean_" if prefix is None else prefix
    w = series_window(spec)
    return df.withColumns({f"{prefix}{n}": rolling_mean(spec.target, n, w) for n in spec.rolls})


def with_partial_rolling_means(df: DataFrame, spec: PanelSpec, prefix: str | None = None) -> DataFrame:
    """Mean of the last ``n`` known values before each row; fewer if fewer, 0 if none.

    Known values are ranked among themselves first, so a null target never
    shortens the look-back.  Clustering on the series first lets both windows
    share one exchange.
    """
    prefix = f"{spec.target}_roll_mean_" if prefix is None else prefix
    known = F.col(spec.target).isNotNull()
    among_known = (
        Window.partitionBy(*spec.series, "_known").orderBy(spec.time)
    )
    before = series_window(spec).rowsBetween(Window.unboundedPreceding, -1)
    out = df.repartition(*spec.series).withColumn("_known", known)
    out = out.withColumns({
        f"_tail_{n}": F.when(known, F.avg(spec.target).over(among_known.rowsBetween(-(n - 1), 0)))
        for n in spec.rolls
    })
    out = out.withColumns({
        f"{prefix}{n}": F.coalesce(F.last(f"_tail_{n}", ignorenulls=True).over(before), F.lit(0.0))
        for n in spec.rolls
    })
    return out.drop("_known", *[f"_tail_{n}" for n in spec.rolls])


def with_difference(df: DataFrame, spec: PanelSpec, name: str = "diff_1") -> DataFrame:
    return df.withColumn(name, F.col(spec.target) - F.lag(spec.target, 1).over(series_window(spec)))


def with_exog_lags(df: DataFrame, spec: PanelSpec, deepest: int = 3) -> DataFrame:
    w = series_window(spec)
    return df.withColumns({
        f"{v}_lag_{k}": (F.lag(v, k).over(w) if k else F.col(v))
        for v in spec.exog
        for k in range(deepest + 1)
    })


def with_calendar_lags(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Lags by calendar month: a gap gives null instead of an older row."""
    w = Window.partitionBy(*spec.series).orderBy(cal.month_number(spec.time))
    return df.withColumns({
        f"{spec.target}_lag_{k}": F.max(spec.target).over(w.rangeBetween(-k, -k)) for k in spec.lags
    })


def last_rows(df: DataFrame, spec: PanelSpec, n: int) -> DataFrame:
    """Last ``n`` months of every series."""
    w = Window.partitionBy(*spec.series).orderBy(F.col(spec.time).desc())
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def with_horizon(df: DataFrame, groups: list[str], time: str, name: str = "h") -> DataFrame:
    """1-based step number of each row inside its group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(time)))


def next_period(df: DataFrame, spec: PanelSpec, name: str = "next_period") -> DataFrame:
    """Month after the last one on record, per series."""
    return df.groupBy(*spec.series).agg(F.add_months(F.max(spec.time), 1).alias(name))
