"""Checks of aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthloom.functions import text
from monthloom.operators import aggregate as agg
from monthloom.operators import evaluate, joins, windows
from monthloom.operators.forecast import national
from monthloom.operators.validate import duplicate_months
from monthloom.plans import tables as t
from monthloom.plans.combining import CENTROIDS, FITTED, _centroids, _fitted
from monthloom.plans.forecasting import _BACKTEST, _CLIM_FUTURE, backtests, forecast_all_regions
from monthloom.plans.registry import query
from monthloom.plans.sql import CLIMATOLOGY, W, WEDGE, recursion
from monthloom.session import written
from monthloom.spec import DISTRICT, NATION, REGION

PAIRS = FITTED + ",\npairs AS (SELECT DRS, PERIODE, cas AS observe, prediction AS prevu FROM fitted)"


def _pairs(spark, d):
    return _fitted(spark, d).select(
        "DRS", "PERIODE", F.col("cas").alias("observe"), F.col("prediction").alias("prevu"))


@query("A1", f"DRS d:PERIODE r:cas {WEDGE}", "SELECT * FROM panel")
def region_panel(spark, d):
    return t.panel(spark, d)


@query("A2", f"d:PERIODE r:cas {WEDGE}",
       "SELECT PERIODE, sum(cas) AS cas, "
       + ", ".join(f"coalesce(sum({w}), 0) AS {w}" if w == "precipitation" else f"avg({w}) AS {w}" for w in W)
       + " FROM merged GROUP BY PERIODE")
def national_panel(spark, d):
    return agg.build_panel(t.merged(spark, d), NATION)


@query("A3", f"DRS i:month {WEDGE}", "SELECT * FROM clim", ctes=CLIMATOLOGY)
def monthly_climatology(spark, d):
    return agg.climatology(t.panel(spark, d), REGION)


@query("A4", "d:PERIODE r:cas", "SELECT PERIODE, sum(cas) AS cas FROM panel GROUP BY PERIODE")
def national_series(spark, d):
    return agg.total_by_month(t.panel(spark, d), "PERIODE", "cas", "cas")


@query("A5", "d:PERIODE r:National_Prediction i:unanswered",
       "SELECT PERIODE, sum(prediction) AS National_Prediction, count(*) - count(prediction) AS unanswered "
       "FROM answered GROUP BY PERIODE", ctes=_CLIM_FUTURE + "," + recursion("future"))
def national_predictions(spark, d):
    return national(forecast_all_regions(spark, d))


@query("A6", "i:year r:total r:previous_total r:delta_percent",
       """SELECT y.year, y.total, p.total AS previous_total, (y.total - p.total) / p.total * 100 AS delta_percent
          FROM years y JOIN years p ON p.year = y.year - 1 WHERE y.year = (SELECT max(year) FROM years)""",
       ctes="years AS (SELECT year(PERIODE) AS year, sum(cas) AS total FROM panel GROUP BY ALL)")
def last_year_against_previous(spark, d):
    return agg.year_over_year(t.panel(spark, d), REGION)


@query("A7", "what key r:total",
       """SELECT 'peak_month' AS what, CAST(month AS VARCHAR) AS key, total FROM (SELECT month(PERIODE) AS month,
            sum(cas) AS total FROM panel GROUP BY ALL ORDER BY total DESC, month LIMIT 1)
          UNION ALL SELECT 'top_series', DRS, total FROM (SELECT DRS, sum(cas) AS total FROM panel
            WHERE year(PERIODE) = (SELECT max(year(PERIODE)) FROM panel) GROUP BY DRS ORDER BY total DESC, DRS LIMIT 1)""")
def peaks(spark, d):
    return agg.peak_keys(t.panel_once(spark, d), REGION)


@query("A8", "i:series i:months", "SELECT count(DISTINCT DRS) AS series, count(DISTINCT PERIODE) AS months FROM panel")
def covered(spark, d):
    return agg.coverage(t.panel(spark, d), REGION)


@query("A9", "d:first_period d:last_period",
       "SELECT min(PERIODE) AS first_period, max(PERIODE) AS last_period FROM panel")
def period_bounds(spark, d):
    return agg.time_range(t.panel(spark, d), REGION)


@query("A10", "DRS i:year r:total i:place",
       """SELECT DRS, year, total, place FROM years JOIN (SELECT DRS, row_number() OVER (ORDER BY max(CASE WHEN year = (SELECT
            max(year) FROM years) THEN total END) DESC NULLS LAST, DRS) AS place FROM years GROUP BY DRS) USING (DRS)""",
       ctes="years AS (SELECT DRS, year(PERIODE) AS year, sum(cas) AS total FROM panel GROUP BY ALL)")
def totals_by_year(spark, d):
    return agg.year_totals_by_series(t.panel_once(spark, d), REGION)


@query("A11", "d:PERIODE DRS r:mean r:total",
       "SELECT PERIODE, DRS, m AS mean, sum(m) OVER (PARTITION BY PERIODE) AS total FROM "
       "(SELECT PERIODE, DRS, round_even(avg(cas / 2), 0) AS m FROM panel GROUP BY ALL)")
def means_by_region(spark, d):
    halves = t.panel_once(spark, d).withColumn("v", F.col("cas") / 2)
    return agg.means_by_month_and_series(halves, "PERIODE", "DRS", "v")


@query("A12", "DRS i:month r:share",
       "SELECT DRS, month, m / sum(m) OVER (PARTITION BY DRS) * 100 AS share FROM "
       "(SELECT DRS, month(PERIODE) AS month, avg(cas) AS m FROM panel GROUP BY ALL)")
def season(spark, d):
    return agg.seasonal_profile(t.panel(spark, d), REGION)


_LAGGED = [(w, k) for w in W for k in range(4)]


@query("A13", "variable i:lag r:correlation",
       " UNION ALL ".join(f"SELECT '{w}' AS variable, {k} AS lag, corr(cas, {w}_{k}) AS correlation FROM lagged"
                          for w, k in _LAGGED),
       ctes="lagged AS MATERIALIZED (SELECT cas, " + ", ".join(
           f"lag({w}, {k}) OVER (PARTITION BY DRS ORDER BY PERIODE) AS {w}_{k}" for w, k in _LAGGED) + " FROM panel)")
def correlations(spark, d):
    return agg.lagged_correlation(t.panel(spark, d), REGION)


@query("A14", "DRS r:mean r:std r:threshold",
       "SELECT DRS, avg(cas) AS mean, stddev_samp(cas) AS std, avg(cas) + 2 * stddev_samp(cas) AS threshold "
       "FROM panel GROUP BY DRS")
def thresholds(spark, d):
    return evaluate.alert_thresholds(t.panel(spark, d), REGION)


_BACK = """avg(abs(prevu - observe)) AS mae, sqrt(avg((prevu - observe) * (prevu - observe))) AS rmse,
  avg(CASE WHEN observe > 0 THEN abs((prevu - observe) / observe) END) * 100 AS mape,
  CASE WHEN count(*) > 1 AND var_pop(observe) > 0
    THEN 1 - sum((prevu - observe) * (prevu - observe)) / (var_pop(observe) * count(*)) END AS r2,
  avg(prevu - observe) AS bias"""


@query("A15", "r:mae r:rmse r:mape r:r2 r:bias", f"SELECT {_BACK} FROM pairs", ctes=PAIRS)
def metrics_of_backtest(spark, d):
    return evaluate.backtest_metrics(_pairs(spark, d))


@query("A16", "DRS r:mae r:rmse r:smape r:mape r:accuracy r:r2",
       f"""SELECT DRS, mae, rmse, smape, mape, greatest(0, 100 - mape) AS accuracy, r2 FROM (SELECT DRS, {_BACK},
         avg(CASE WHEN abs(observe) + abs(prevu) <> 0 THEN 2 * abs(prevu - observe) / (abs(observe) + abs(prevu)) END)
           * 100 AS smape FROM pairs GROUP BY DRS)""", ctes=PAIRS)
def metrics_of_training(spark, d):
    return evaluate.training_metrics(_pairs(spark, d), by=("DRS",))


@query("A17", "DRS r:mae r:rmse r:mape r:accuracy",
       "SELECT DRS, mae, rmse, mape, (1 - mape) * 100 AS accuracy FROM (SELECT DRS, avg(abs(prevu - observe)) AS mae, "
       "sqrt(avg((prevu - observe) * (prevu - observe))) AS rmse, "
       "avg(abs(prevu - observe) / greatest(abs(observe), 2.220446049250313e-16)) AS mape FROM pairs GROUP BY DRS)", ctes=PAIRS)
def metrics_with_floor(spark, d):
    return evaluate.floored_metrics(_pairs(spark, d), by=("DRS",))


@query("A18", "DRS r:observed_total r:predicted_total r:gap_percent r:mae r:rmse r:mape r:r2 r:bias i:unanswered",
       f"SELECT DRS, observed_total, predicted_total, gap_percent, mae, rmse, mape, r2, bias, unanswered FROM "
       "(SELECT DRS, count(*) - count(prevu) AS unanswered FROM back GROUP BY DRS) LEFT JOIN "
       "(SELECT DRS, sum(observe) AS observed_total, sum(prevu) AS predicted_total, (sum(prevu) - sum(observe)) / "
       f"sum(observe) * 100 AS gap_percent, {_BACK} FROM back WHERE prevu IS NOT NULL GROUP BY DRS) USING (DRS)",
       ctes=_BACKTEST)
def metrics_of_every_region(spark, d):
    back = written(backtests(spark, d), "backtest")
    unanswered = back.groupBy("DRS").agg(F.sum(F.col("prevu").isNull().cast("long")).alias("unanswered"))
    return unanswered.join(evaluate.metrics_by_series(back.filter("prevu IS NOT NULL"), REGION), "DRS", "left")


@query("A19", "DRS i:position", "SELECT DRS, row_number() OVER (ORDER BY DRS) AS position FROM (SELECT DISTINCT DRS FROM surv)")
def region_list(spark, d):
    return windows.with_positions(agg.key_list(t.surveillance(spark, d), "DRS"), "DRS")


@query("A20", "DRS DISTRICT", "SELECT DISTINCT DRS, DISTRICT FROM surv")
def region_hierarchy(spark, d):
    return agg.hierarchy_pairs(t.surveillance(spark, d), "DRS", "DISTRICT")


@query("A21", "DRS d:PERIODE i:n", "SELECT DRS, PERIODE, count(*) AS n FROM merged GROUP BY ALL HAVING count(*) > 1")
def repeated_months(spark, d):
    return duplicate_months(t.merged(spark, d), REGION)


_MADE = _CLIM_FUTURE + "," + recursion("future") + """,
fitted AS (SELECT DRS, PERIODE, prediction FROM answered WHERE prediction IS NOT NULL)"""


def _made(spark, d):
    """The answered part of the recursive forecast, written as several figures read it."""
    return written(forecast_all_regions(spark, d).filter("problem IS NULL").select("DRS", "PERIODE", "prediction"), "forecast")


@query("A23", "r:total i:months d:peak_period r:peak_total top_series r:top_total r:year_before r:change_percent",
       """SELECT (SELECT sum(prediction) FROM fitted) AS total, (SELECT count(DISTINCT PERIODE) FROM fitted) AS months,
            m.PERIODE AS peak_period, m.v AS peak_total, s.DRS AS top_series, s.v AS top_total, b.v AS year_before,
            CASE WHEN b.v > 0 THEN ((SELECT sum(prediction) FROM fitted) - b.v) / b.v * 100 END AS change_percent
          FROM (SELECT PERIODE, sum(prediction) AS v FROM fitted GROUP BY ALL ORDER BY v DESC, PERIODE LIMIT 1) m,
               (SELECT DRS, sum(prediction) AS v FROM fitted GROUP BY ALL ORDER BY v DESC, DRS LIMIT 1) s,
               (SELECT sum(cas) AS v FROM panel WHERE DRS IN (SELECT DRS FROM fitted) AND PERIODE IN
                  (SELECT CAST(PERIODE - INTERVAL 12 MONTH AS DATE) FROM fitted)) b""", ctes=_MADE)
def forecast_figures(spark, d):
    return agg.forecast_summary(_made(spark, d), t.panel_once(spark, d), REGION)


@query("A23_by_region", "DRS r:total i:position",
       "SELECT DRS, total, row_number() OVER (ORDER BY total, DRS) AS position FROM "
       "(SELECT DRS, sum(prediction) AS total FROM fitted GROUP BY DRS)", ctes=_MADE)
def forecast_totals_ascending(spark, d):
    return windows.with_positions(agg.totals_ascending(_made(spark, d), "DRS", "prediction"), "total", "DRS")


@query("A25", "i:bin i:n",
       """SELECT least(CAST(floor((r - low) / (high - low) * 10) AS INTEGER), 9) AS bin, count(*) AS n
          FROM (SELECT observe - prevu AS r FROM pairs),
               (SELECT min(observe - prevu) AS low, max(observe - prevu) AS high FROM pairs) GROUP BY ALL""", ctes=PAIRS)
def residuals(spark, d):
    return evaluate.residual_histogram(written(_pairs(spark, d), "pairs"), "observe", "prevu", 10)


@query("A25_width", "i:bin i:n",
       """SELECT least(coalesce(CAST(floor((r - low) / nullif(high - low, 0) * bins) AS INTEGER), 0), bins - 1) AS bin, count(*) AS n
          FROM (SELECT observe - prevu AS r FROM pairs WHERE observe - prevu IS NOT NULL),
               (SELECT low, high, coalesce(greatest(1, CAST(ceil((high - low) / nullif(2 * (q3 - q1) / cbrt(n), 0)) AS INTEGER)), 1) AS bins
                FROM (SELECT min(observe - prevu) AS low, max(observe - prevu) AS high, count(observe - prevu) AS n,
                        quantile_cont(observe - prevu, 0.25) AS q1, quantile_cont(observe - prevu, 0.75) AS q3 FROM pairs)) GROUP BY ALL""",
       ctes=PAIRS)
def residuals_in_bins_of_their_own(spark, d):
    """As many bins as the spread of the residuals asks for."""
    return evaluate.residual_histogram(written(_pairs(spark, d), "pairs"), "observe", "prevu", None)


@query("A26", "DRS region r:cas r:lat r:lon",
       "SELECT DRS, replace(DRS, 'DRS ', '') AS region, sum(cas) AS cas, any_value(lat) AS lat, any_value(lon) AS lon "
       "FROM panel JOIN centroids USING (DRS) WHERE year(PERIODE) = (SELECT max(year(PERIODE)) FROM panel) GROUP BY DRS",
       ctes=CENTROIDS)
def region_map(spark, d):
    panel = t.panel_once(spark, d)
    last = panel.agg(F.max(F.year("PERIODE")).alias("y")).scalar()
    totals = joins.strict_lookup(agg.year_totals(panel, REGION, last), _centroids(spark, d), "DRS")
    return totals.withColumn("region", text.short_name("DRS"))


# -------------------------------------------------------------------- windows

_LAGS = "r:cas_lag_1 r:cas_lag_2 r:cas_lag_3 r:cas_lag_6 r:cas_lag_12"


@query("W1", f"DRS d:PERIODE {_LAGS}",
       "SELECT DRS, PERIODE, " + ", ".join(
           f"lag(cas, {k}) OVER (PARTITION BY DRS ORDER BY PERIODE) AS cas_lag_{k}" for k in (1, 2, 3, 6, 12))
       + " FROM panel")
def region_lags(spark, d):
    return windows.with_lags(t.panel(spark, d), REGION)


@query("W2", "DISTRICT d:PERIODE " + " ".join(f"r:lag_{k}" for k in range(1, 13)),
       "SELECT DISTRICT, PERIODE, " + ", ".join(
           f"lag(cas, {k}) OVER (PARTITION BY DISTRICT ORDER BY PERIODE) AS lag_{k}" for k in range(1, 13)) + " FROM surv")
def district_lags(spark, d):
    return windows.with_lags(t.surveillance(spark, d), DISTRICT, "lag_")


def _full(key, n, name):
    frame = f"(PARTITION BY {key} ORDER BY PERIODE ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(cas) OVER {frame} = {n} THEN avg(cas) OVER {frame} END AS {name}{n}"


@query("W3", "DRS d:PERIODE r:cas_roll_mean_3 r:cas_roll_mean_6 r:cas_roll_mean_12",
       "SELECT DRS, PERIODE, " + ", ".join(_full("DRS", n, "cas_roll_mean_") for n in (3, 6, 12)) + " FROM panel")
def full_rolling_means(spark, d):
    return windows.with_rolling_means(t.panel(spark, d), REGION.having(rolls=(3, 6, 12)))


def _partial(n):
    return (f"coalesce(list_avg(list_slice(known, -{n}, -1)), 0) AS target_roll_mean_{n}")


@query("W4", "DISTRICT d:PERIODE r:urgent r:target_roll_mean_3 r:target_roll_mean_6 r:target_roll_mean_12",
       "SELECT *, " + ", ".join(_partial(n) for n in (3, 6, 12)) + """ FROM (SELECT DISTRICT, PERIODE,
         nullif(tpi2, 0) AS urgent, list(nullif(tpi2, 0)) FILTER (nullif(tpi2, 0) IS NOT NULL) OVER
           (PARTITION BY DISTRICT ORDER BY PERIODE ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM surv)""")
def partial_rolling_means(spark, d):
    rows = t.surveillance(spark, d).withColumn("urgent", F.nullif(F.col("tpi2"), F.lit(0.0)))
    spec = DISTRICT.having(target="urgent", rolls=(3, 6, 12))
    return windows.with_partial_rolling_means(rows, spec, "target_roll_mean_")


@query("W5", "DISTRICT d:PERIODE r:diff_1",
       "SELECT DISTRICT, PERIODE, cas - lag(cas) OVER (PARTITION BY DISTRICT ORDER BY PERIODE) AS diff_1 FROM surv")
def differences(spark, d):
    return windows.with_difference(t.surveillance(spark, d), DISTRICT)


@query("W6", "DRS d:PERIODE " + " ".join(f"r:{w}_lag_{k}" for w, k in _LAGGED),
       "SELECT DRS, PERIODE, " + ", ".join(
           f"lag({w}, {k}) OVER (PARTITION BY DRS ORDER BY PERIODE) AS {w}_lag_{k}" for w, k in _LAGGED) + " FROM panel")
def weather_lags(spark, d):
    return windows.with_exog_lags(t.panel(spark, d), REGION)


@query("W7", "DRS d:PERIODE r:cas",
       "SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY DRS ORDER BY PERIODE DESC) <= 24")
def last_months(spark, d):
    return windows.last_rows(t.panel(spark, d), REGION, 24)


@query("W8", "DRS d:PERIODE i:h",
       "SELECT DRS, PERIODE, row_number() OVER (PARTITION BY DRS ORDER BY PERIODE) AS h FROM panel")
def step_numbers(spark, d):
    return windows.with_horizon(t.panel(spark, d), ["DRS"], "PERIODE")


@query("W9", "DISTRICT d:next_period",
       "SELECT DISTRICT, CAST(max(PERIODE) + INTERVAL 1 MONTH AS DATE) AS next_period FROM surv GROUP BY DISTRICT")
def next_months(spark, d):
    return windows.next_period(t.surveillance(spark, d), DISTRICT)


@query("W10", "DISTRICT d:PERIODE r:rolling_mean_3 r:rolling_mean_6",
       "SELECT DISTRICT, PERIODE, " + ", ".join(_full("DISTRICT", n, "rolling_mean_") for n in (3, 6)) + " FROM surv")
def district_rolling_means(spark, d):
    return windows.with_rolling_means(t.surveillance(spark, d), DISTRICT, "rolling_mean_")


@query("W1_calendar", "DISTRICT d:PERIODE " + " ".join(f"r:cas_lag_{k}" for k in (1, 2, 3, 6, 12)),
       "SELECT s.DISTRICT, s.PERIODE, " + ", ".join(f"l{k}.cas AS cas_lag_{k}" for k in (1, 2, 3, 6, 12)) + " FROM surv s "
       + " ".join(f"LEFT JOIN surv l{k} ON l{k}.DISTRICT = s.DISTRICT AND l{k}.PERIODE = CAST(s.PERIODE - INTERVAL {k} MONTH AS DATE)"
                  for k in (1, 2, 3, 6, 12)))
def calendar_lags(spark, d):
    return windows.with_calendar_lags(t.surveillance(spark, d), DISTRICT.having(lags=(1, 2, 3, 6, 12)))
