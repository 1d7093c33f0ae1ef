"""Fits of every region and of every cut-off at once, next to SQL that fits them one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthloom.operators import features, forecast, normal
from monthloom.plans import tables as t
from monthloom.plans.forecasting import _BACKTEST, _CUTOFFS
from monthloom.plans.learned import _COMPLETE
from monthloom.plans.registry import query
from monthloom.plans.sql import FEATURES
from monthloom.session import scratch_dir, written
from monthloom.sources import registry
from monthloom.spec import REGION

_ROWS = FEATURES + f",\ncomplete AS (SELECT * FROM features WHERE {_COMPLETE}),\n"


def _frame(spark, d):
    panel = t.panel_once(spark, d)
    frame = features.complete_rows(features.create_features(panel, REGION), features.feature_names(REGION))
    return panel, written(frame, "frame")


@query("S12_regions", "district algorithm r:rmse i:training_rows r:slope r:intercept",
       """SELECT DRS AS district, 'line' AS algorithm, round_even(sqrt(avg(power(cas - a - b * target_lag_1, 2))), 4) AS rmse,
            count(*) AS training_rows, any_value(b) AS slope, any_value(a) AS intercept
          FROM complete JOIN lines USING (DRS) GROUP BY DRS""",
       ctes=_ROWS + "lines AS (SELECT DRS, regr_slope(cas, target_lag_1) AS b, regr_intercept(cas, target_lag_1) AS a "
                    "FROM complete GROUP BY DRS HAVING var_pop(target_lag_1) > 0)")
def a_line_for_every_region(spark, d):
    """One model per region, fitted in one aggregate, written as one batch of runs and read again."""
    _, frame = _frame(spark, d)
    fits = normal.fit_by_group(frame, ["DRS"], ["target_lag_1"], "cas").filter("coefficients IS NOT NULL")
    path = scratch_dir(spark, "region-runs")
    weights = F.create_map(F.lit("target_lag_1"), F.get("coefficients", F.lit(0)).cast("string"),
                           F.lit("intercept"), F.get("coefficients", F.lit(1)).cast("string"))
    registry.append_runs(fits.select(
        F.col("DRS").alias("district"), F.lit("line").alias("algorithm"), "rmse", F.col("n").cast("int").alias("training_rows"),
        F.lit("1.0.0").alias("version"), weights.alias("best_params"), F.array(F.lit("target_lag_1")).alias("features")), path)
    return registry.read_runs(spark, path).select(
        "district", "algorithm", "rmse", "training_rows", F.col("best_params")["target_lag_1"].cast("double").alias("slope"),
        F.col("best_params")["intercept"].cast("double").alias("intercept"))


_REFITTED = _ROWS + """
lines AS (SELECT CAST(c AS DATE) AS cutoff, regr_intercept(cas, target_lag_1) AS a, regr_slope(cas, target_lag_1) AS b
  FROM complete JOIN (VALUES """ + ", ".join(f"('{c}')" for c in _CUTOFFS) + """) v(c) ON PERIODE <= CAST(c AS DATE) GROUP BY c),
"""


def _refitted_backtest() -> str:
    """The recursive back-test with the line of its cut-off in place of the fixed rule."""
    at = _BACKTEST.index("list_append(r.hist, ")
    step = _BACKTEST[at:_BACKTEST.index("\n", at)]
    sql = _BACKTEST.replace(step, "list_append(r.hist, greatest(0.0, lines.a + lines.b * r.hist[-1]))")
    joined = "ON f.DRS = r.DRS AND f.cutoff = r.cutoff AND f.h = r.h + 1"
    if joined not in sql:
        raise ValueError("the recursion has another form")
    return sql.replace(joined, joined + " JOIN lines ON lines.cutoff = r.cutoff")


@query("T21_refits", "DRS d:cutoff d:PERIODE r:observe r:prevu problem", "SELECT * FROM back", ctes=_REFITTED + _refitted_backtest())
def backtests_with_refits(spark, d):
    """A line refitted up to every cut-off, all from one window of running sums, then the recursion from each."""
    panel, frame = _frame(spark, d)
    fits = normal.fit_by_cutoff(frame, "PERIODE", _CUTOFFS, ["target_lag_1"], "cas").select("cutoff", "coefficients")
    return forecast.backtest(panel, REGION, _CUTOFFS, 12, rule=normal.line_rule(["target_lag_1"]), on_problem="mark", fits=fits)
