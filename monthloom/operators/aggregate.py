"""Panel builds and descriptive aggregates.

Grouped aggregates combine on the map side, so a key that holds a large share
of the rows reaches the shuffle as one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions import maths
from monthloom.operators.windows import with_exog_lags, with_positions
from monthloom.spec import PanelSpec

PIVOT_LIMIT = 2000  # columns of a wide table; the long forms have no limit


def _measure(spec: PanelSpec, name: str) -> Column:
    how = spec.exog_agg.get(name, "avg")
    return F.coalesce(F.sum(name), F.lit(0.0)) if how == "sum" else F.avg(name)


def build_panel(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per (series, month): target summed, each present measure combined.

    Null keys are dropped and an all-null target sums to zero.
    """
    for key in spec.keys:
        df = df.filter(F.col(key).isNotNull())
    measures = [m for m in spec.exog if m in df.columns]
    return df.groupBy(*spec.keys).agg(
        F.coalesce(F.sum(spec.target), F.lit(0.0)).alias(spec.target),
        *[_measure(spec, m).alias(m) for m in measures],
    )


def climatology(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Mean measures by series and month of year."""
    return (
        panel.groupBy(*spec.series, F.month(spec.time).alias("month"))
        .agg(*[F.avg(m).alias(m) for m in spec.exog])
    )


def total_by_month(df: DataFrame, time: str, value: str, name: str) -> DataFrame:
    return df.groupBy(time).agg(F.sum(value).alias(name))


def year_over_year(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Total of the last year on record, of the year before, and the change in %."""
    year = F.year(spec.time)
    by_year = panel.groupBy(year.alias("year")).agg(F.sum(spec.target).alias("total"))
    # one row per calendar year from here on
    years = F.array_sort(F.collect_list(F.struct("year", "total")))
    last = F.element_at(F.col("_years"), -1)
    before = F.get(F.filter("_years", lambda y: y["year"] == last["year"] - 1), 0)
    return by_year.agg(years.alias("_years")).select(
        last["year"].alias("year"),
        last["total"].alias("total"),
        F.coalesce(before["total"], F.lit(0.0)).alias("previous_total"),
    ).withColumn(
        "delta_percent",
        F.coalesce(maths.change_percent(F.col("total"), F.col("previous_total")), F.lit(0.0)),
    )


def arg_max(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key with the largest total, smallest key first on a tie, and that total."""
    totals = df.groupBy(key).agg(F.sum(value).alias("_total"))
    best = F.min_by(F.struct(key, "_total"), F.struct(-F.col("_total"), F.col(key)))
    return totals.agg(best.alias("_best")).select(
        F.col(f"_best.{key}").alias(key), F.col("_best._total").alias("total")
    )


def peak_keys(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Month of year with the largest total, and top series of the last year."""
    monthly = panel.withColumn("month", F.month(spec.time))
    peak = arg_max(monthly, "month", spec.target).select(
        F.lit("peak_month").alias("what"), F.col("month").cast("string").alias("key"), "total"
    )
    last_year = panel.agg(F.max(F.year(spec.time)).alias("y")).scalar()
    top = arg_max(panel.filter(F.year(spec.time) == last_year), spec.series[0], spec.target).select(
        F.lit("top_series").alias("what"), F.col(spec.series[0]).alias("key"), "total"
    )
    return peak.unionByName(top)


def coverage(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    return panel.agg(
        F.countDistinct(*spec.series).alias("series"),
        F.countDistinct(spec.time).alias("months"),
    )


def time_range(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    return panel.agg(F.min(spec.time).alias("first_period"), F.max(spec.time).alias("last_period"))


def distinct_values(df: DataFrame, column: Column, limit: int = PIVOT_LIMIT) -> list:
    """Sorted distinct values for column headings; an error beyond ``limit``.

    A table with one column per value only exists for a bounded number of
    values; larger sets stay in long form.
    """
    rows = df.select(column.alias("v")).filter(F.col("v").isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct values; use the long form instead of a pivot")
    return sorted(r["v"] for r in rows)


def year_totals_by_series(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """(series, year, total, place): series with the largest total of the latest year come first.

    ``panel`` is read twice; the places are those of a table of series.
    """
    totals = panel.groupBy(*spec.series, F.year(spec.time).alias("year")).agg(F.sum(spec.target).alias("total"))
    latest = panel.agg(F.max(F.year(spec.time))).scalar()
    last = totals.groupBy(*spec.series).agg(F.max(F.when(F.col("year") == latest, F.col("total"))).alias("_last"))
    placed = with_positions(last, F.col("_last").desc_nulls_last(), *spec.series, name="place").drop("_last")
    return totals.join(placed, list(spec.series))


def means_by_month_and_series(df: DataFrame, time: str, series: str, value: str) -> DataFrame:
    """(month, series, mean, total): half-even to whole numbers, with the total of the month's means."""
    means = df.groupBy(time, series).agg(F.bround(F.avg(value), 0).alias("mean"))
    return means.join(means.groupBy(time).agg(F.sum("mean").alias("total")), time)


def pivot_year_totals(panel: DataFrame, spec: PanelSpec, years: list[int] | None = None) -> DataFrame:
    """Series by year totals, largest latest year first."""
    year = F.year(spec.time)
    years = years or distinct_values(panel, year)
    wide = (
        panel.withColumn("_year", year)
        .groupBy(*spec.series)
        .pivot("_year", years)
        .agg(F.sum(spec.target))
    )
    return wide.orderBy(F.col(f"`{years[-1]}`").desc_nulls_last(), *spec.series)


def pivot_series_means(df: DataFrame, time: str, series: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Month by series means, half-even to whole numbers, with a row total if several."""
    keys = keys or distinct_values(df, F.col(series))
    wide = df.groupBy(time).pivot(series, keys).agg(F.bround(F.avg(value), 0))
    if len(keys) > 1:
        parts = [F.coalesce(F.col(f"`{k}`"), F.lit(0.0)) for k in keys]
        wide = wide.withColumn("Total", sum(parts[1:], parts[0]))
    return wide


def seasonal_profile(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Share of each month of year in the series total of monthly means."""
    means = panel.groupBy(*spec.series, F.month(spec.time).alias("month")).agg(
        F.avg(spec.target).alias("mean")
    )
    total = F.sum("mean").over(Window.partitionBy(*spec.series))
    return means.withColumn("share", maths.percent_of(F.col("mean"), total)).drop("mean")


def lagged_correlation(panel: DataFrame, spec: PanelSpec, deepest: int = 3) -> DataFrame:
    """Pearson correlation of the target with every measure shifted 0..deepest rows.

    All shifted columns come from one window and all correlations from one
    aggregate, which is then turned into long form.
    """
    lagged = with_exog_lags(panel, spec, deepest)
    names = [(v, k) for v in spec.exog for k in range(deepest + 1)]
    wide = lagged.agg(*[F.corr(spec.target, f"{v}_lag_{k}").alias(f"{v}_lag_{k}") for v, k in names])
    entries = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.lit(k).alias("lag"), F.col(f"{v}_lag_{k}").alias("correlation"))
        for v, k in names
    ])
    return wide.select(F.inline(entries))


def key_list(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def hierarchy_pairs(df: DataFrame, upper: str, lower: str) -> DataFrame:
    """Distinct (upper, lower) pairs: the hierarchy in long form, of any size."""
    return df.select(upper, lower).filter(F.col(upper).isNotNull() & F.col(lower).isNotNull()).distinct()


def hierarchy(df: DataFrame, upper: str, lower: str, limit: int) -> DataFrame:
    """Lower keys of every upper key, with the same pair as a JSON object.

    For hierarchies known to be small: a row holds all members of a key.

    Members are counted before they are gathered: an upper key with more than
    ``limit`` of them fails the job and is to be read from ``hierarchy_pairs``.
    """
    pairs = hierarchy_pairs(df, upper, lower)
    sizes = pairs.groupBy(upper).agg(F.count(F.lit(1)).alias("_n"))
    fits = F.when(F.col("_n") <= limit, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"more than {limit} members of "), F.col(upper))).cast("boolean"))
    grouped = pairs.join(sizes.filter(fits), upper).groupBy(upper).agg(
        F.array_sort(F.collect_list(lower)).alias("members"))
    return grouped.withColumn("json", F.to_json(F.create_map(F.col(upper), F.col("members"))))


def year_totals(panel: DataFrame, spec: PanelSpec, year: int | Column, name: str = "cas") -> DataFrame:
    return panel.filter(F.year(spec.time) == year).groupBy(*spec.series).agg(F.sum(spec.target).alias(name))


def totals_ascending(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias("total")).orderBy("total", key)


def forecast_summary(forecast: DataFrame, history: DataFrame, spec: PanelSpec) -> DataFrame:
    """Total, months, peak month, top series and change on the same months a year before."""
    totals = forecast.agg(
        F.sum("prediction").alias("total"), F.countDistinct(spec.time).alias("months")
    )
    peak = arg_max(forecast, spec.time, "prediction").select(
        F.col(spec.time).alias("peak_period"), F.col("total").alias("peak_total")
    )
    top = arg_max(forecast, spec.series[0], "prediction").select(
        F.col(spec.series[0]).alias("top_series"), F.col("total").alias("top_total")
    )
    # the months a year before times the forecast series, as two semi-joins
    asked = forecast.select(F.add_months(spec.time, -12).alias(spec.time)).distinct()
    before = (
        history.join(asked, spec.time, "left_semi")
        .join(forecast.select(*spec.series).distinct(), list(spec.series), "left_semi")
        .agg(F.coalesce(F.sum(spec.target), F.lit(0.0)).alias("v"))
    )
    picked = totals.withColumns({
        "_peak": peak.select(F.struct("*")).scalar(),
        "_top": top.select(F.struct("*")).scalar(),
        "year_before": before.scalar(),
    })
    return picked.select(
        "total", "months", "_peak.peak_period", "_peak.peak_total", "_top.top_series", "_top.top_total",
        "year_before",
    ).withColumn(
        "change_percent",
        F.when(F.col("year_before") > 0, maths.change_percent(F.col("total"), F.col("year_before"))),
    )
