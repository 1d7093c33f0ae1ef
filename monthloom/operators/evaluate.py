"""Error measures, alert thresholds and residual distributions.

Each flavour of metrics is one aggregate; ``by`` adds groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.functions import maths
from monthloom.operators.windows import with_horizon
from monthloom.spec import PanelSpec

# Fixed value: smallest denominator of the floored percentage error (2 ** -52).
EPSILON = 2.220446049250313e-16


def _r_squared(y: Column, error: Column, flat: Column) -> Column:
    """1 - SSres / SStot; ``flat`` is the value for a constant observed series."""
    n = F.count(y)
    total = F.var_pop(y) * n
    return F.when(n < 2, F.lit(None)).when(total > 0, 1 - F.sum(error * error) / total).otherwise(flat)


def _backtest_columns(y: str, p: str) -> list[Column]:
    obs, error = F.col(y), F.col(p) - F.col(y)
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.when(obs > 0, F.abs(error / obs))) * 100).alias("mape"),
        _r_squared(obs, error, F.lit(None).cast("double")).alias("r2"),
        F.avg(error).alias("bias"),
    ]


def backtest_metrics(df: DataFrame, y: str = "observe", p: str = "prevu", by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE, MAPE over positive observations, R2 and bias."""
    return df.groupBy(*by).agg(*_backtest_columns(y, p))


def training_metrics(df: DataFrame, y: str = "observe", p: str = "prevu", by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE, sMAPE, MAPE over non-zero observations, accuracy and R2.

    Predictions are clamped at zero first; sMAPE skips zero denominators and
    is zero when it skips them all.
    """
    obs, pred = F.col(y), maths.at_least_zero(p)
    error = pred - obs
    size = F.abs(obs) + F.abs(pred)
    mape = F.avg(F.when(obs != 0, F.abs(error / obs))) * 100
    flat = F.when(F.sum(error * error) == 0, 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.coalesce(F.avg(F.when(size != 0, 2 * F.abs(error) / size)) * 100, F.lit(0.0)).alias("smape"),
        mape.alias("mape"),
        F.when(mape.isNotNull(), F.greatest(F.lit(0.0), 100 - mape)).alias("accuracy"),
        _r_squared(obs, error, flat).alias("r2"),
    )


def floored_metrics(df: DataFrame, y: str = "observe", p: str = "prevu", by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE, MAPE as a ratio with a floored denominator, accuracy (may be negative)."""
    obs, error = F.col(y), F.col(p) - F.col(y)
    mape = F.avg(F.abs(error) / F.greatest(F.abs(obs), F.lit(EPSILON)))
    return df.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        mape.alias("mape"),
        ((1 - mape) * 100).alias("accuracy"),
    )


def metrics_by_series(df: DataFrame, spec: PanelSpec, y: str = "observe", p: str = "prevu") -> DataFrame:
    """Back-test metrics of every series with totals and the total gap in %, in one aggregate."""
    return df.groupBy(*spec.series).agg(
        F.sum(y).alias("observed_total"), F.sum(p).alias("predicted_total"), *_backtest_columns(y, p)
    ).withColumn("gap_percent", maths.change_percent(F.col("predicted_total"), F.col("observed_total")))


def alert_thresholds(history: DataFrame, spec: PanelSpec, multiplier: float = 2.0) -> DataFrame:
    """Mean plus ``multiplier`` sample deviations of the known targets, per series."""
    return (
        history.groupBy(*spec.series)
        .agg(F.avg(spec.target).alias("mean"), F.stddev_samp(spec.target).alias("std"))
        .filter(F.col("mean").isNotNull())
        .withColumn("threshold", F.col("mean") + multiplier * F.col("std"))
    )


def detect_alerts(forecast: DataFrame, thresholds: DataFrame, spec: PanelSpec) -> DataFrame:
    """Forecast months above the threshold of their series."""
    return (
        forecast.join(thresholds.select(*spec.series, "threshold"), list(spec.series))
        .filter(F.col("prediction") > F.col("threshold"))
    )


def errors_by_horizon(backtest: DataFrame, groups: list[str], spec: PanelSpec) -> DataFrame:
    """Step number, gap and gap in % (null unless the observation is positive)."""
    gap = F.col("prevu") - F.col("observe")
    return with_horizon(backtest, groups, spec.time).withColumns({
        "gap": gap,
        "gap_percent": F.when(F.col("observe") > 0, maths.percent_of(gap, F.col("observe"))),
    })


def exact_quantiles(df: DataFrame, column: str, shares: list[float], accuracy: int = 10_000) -> list[float]:
    """Interpolated quantiles of a written table, in two passes.

    A mergeable sketch gives a value on either side of each quantile; the second
    pass counts what lies below, and ranks only the distinct values in between,
    a share of about ``8 / accuracy`` of the rows.
    """
    margin = 4 / accuracy
    around = [s for q in shares for s in (max(0.0, q - margin), min(1.0, q + margin))]
    first = df.agg(F.count(column).alias("n"), F.percentile_approx(column, around, accuracy).alias("at"),
                   F.min(column).alias("low"), F.max(column).alias("high")).first()
    found = []
    for k, share in enumerate(shares):
        if not first["n"]:
            found.append(None)
            continue
        low, high = first["at"][2 * k], first["at"][2 * k + 1]
        low, high = first["low"] if share <= margin else low, first["high"] if share >= 1 - margin else high
        rank = share * (first["n"] - 1)
        values = df.filter(F.col(column).between(low, high)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        below = df.filter(F.col(column) < low).count()
        upto = F.sum("n").over(Window.orderBy(column)) + below
        ends = values.select(F.col(column).alias("v"), upto.alias("upto")).agg(
            F.min(F.when(F.col("upto") > int(rank), F.col("v"))), F.min(F.when(F.col("upto") >= rank + 1, F.col("v")))).first()
        if below > rank or ends[0] is None or ends[1] is None:
            raise RuntimeError(f"the sketch misses the quantile {share}")
        found.append(ends[0] + (ends[1] - ends[0]) * (rank - int(rank)))
    return found


def residual_histogram(df: DataFrame, y: str, p: str, bins: int | None = 10) -> DataFrame:
    """Count of ``y - p`` per equal-width bin; the top edge belongs to the last bin.

    ``bins=None`` takes the Freedman-Diaconis width, twice the distance of the
    quartiles over the cube root of the number; pass a written table then.
    """
    residual = df.select((F.col(y) - F.col(p)).alias("_r")).filter(F.col("_r").isNotNull())
    low, high = F.min("_r"), F.max("_r")
    if bins is None:
        quartiles = exact_quantiles(residual, "_r", [0.25, 0.75])
        spread = None if quartiles[0] is None else float(quartiles[1] - quartiles[0])
        width = F.lit(2.0) * F.lit(spread).cast("double") / F.cbrt(F.count("_r").cast("double"))
        count = F.coalesce(F.greatest(F.lit(1), F.ceil((high - low) / F.nullif(width, F.lit(0.0))).cast("int")), F.lit(1))
    else:
        count = F.lit(bins)
    edges = residual.agg(F.struct(low.alias("low"), high.alias("high"), count.alias("bins")).alias("e"))
    placed = residual.withColumn("_e", edges.scalar())
    span = F.nullif(F.col("_e.high") - F.col("_e.low"), F.lit(0.0))
    index = F.coalesce(F.floor((F.col("_r") - F.col("_e.low")) / span * F.col("_e.bins")), F.lit(0))
    return (
        placed.withColumn("bin", F.least(index, F.col("_e.bins") - 1).cast("int"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
