"""Checks of features, splits, futures, scenarios, recursion and back-tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthloom.functions import fixed
from monthloom.operators import evaluate, features, forecast, futures, joins, scenarios, split, validate

from monthloom.plans import tables as t
from monthloom.plans.combining import FITTED
from monthloom.plans.registry import query
from monthloom.plans.rules import RULE
from monthloom.plans.sql import (
    AHEAD, CLIMATOLOGY, DISTRICT_FEATURES, FEATURES, PARTIAL_MEAN_3, W, WCOLS, WEDGE,
    cols, recursion,
)
from monthloom.session import written
from monthloom.spec import DISTRICT, REGION

_T1 = (f"DRS d:PERIODE r:cas {WEDGE} r:target_lag_1 r:target_lag_2 r:target_lag_3 r:target_lag_6 r:target_lag_12 "
       "r:target_roll_mean_3 r:target_roll_mean_6 i:month i:year r:month_sin r:month_cos")


@query("T1", _T1, "SELECT * FROM features", ctes=FEATURES)
def region_features(spark, d):
    return features.create_features(t.panel(spark, d), REGION)


_T2 = (f"DISTRICT d:PERIODE r:cas {WEDGE} i:month i:quarter i:year " + " ".join(f"r:lag_{k}" for k in range(1, 13))
       + " r:rolling_mean_3 r:rolling_mean_6 r:diff_1")


@query("T2", _T2, "SELECT * FROM district_features", ctes=DISTRICT_FEATURES)
def district_features(spark, d):
    return features.create_district_features(t.merged(spark, d).drop("DRS", "tpi2"), DISTRICT)


@query("T3", "DRS d:PERIODE part",
       """SELECT DRS, PERIODE, CASE WHEN i > n - greatest(1, CAST(floor(n * 0.2) AS INTEGER)) THEN 'test' ELSE 'train' END AS part
          FROM panel JOIN (SELECT PERIODE, row_number() OVER (ORDER BY PERIODE) AS i, count(*) OVER () AS n
            FROM (SELECT DISTINCT PERIODE FROM panel)) USING (PERIODE)""")
def split_by_period(spark, d):
    return split.period_split(t.panel_once(spark, d), REGION)


@query("T4", "DISTRICT d:PERIODE part",
       """SELECT DISTRICT, PERIODE, CASE WHEN row_number() OVER (ORDER BY PERIODE, md5(DISTRICT), DISTRICT)
            <= CAST(floor(count(*) OVER () * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM surv""")
def split_by_rows(spark, d):
    return split.row_split(t.surveillance_once(spark, d), DISTRICT)


@query("T5", "DRS d:PERIODE i:fold",
       """SELECT DRS, PERIODE, CASE WHEN i >= n - 5 * (n // 6) THEN (i - (n - 5 * (n // 6))) // (n // 6) END AS fold
          FROM panel JOIN (SELECT PERIODE, row_number() OVER (ORDER BY PERIODE) - 1 AS i, count(*) OVER () AS n
            FROM (SELECT DISTINCT PERIODE FROM panel)) USING (PERIODE)""")
def folds(spark, d):
    return split.expanding_folds(t.panel_once(spark, d), REGION)


def _ahead(panel):
    return futures.future_months(panel, REGION, futures.after_history(panel, REGION), 12)


_CLIM_FUTURE = AHEAD + ",\n" + CLIMATOLOGY + f""",
future AS (SELECT a.DRS, a.PERIODE, a.h, {cols('c')} FROM ahead a
  LEFT JOIN clim c ON c.DRS = a.DRS AND c.month = month(a.PERIODE))"""


@query("T6", f"DRS d:PERIODE {WEDGE}", "SELECT * FROM future", ctes=_CLIM_FUTURE)
def weather_by_climatology(spark, d):
    panel = t.panel_once(spark, d)
    return futures.from_climatology(panel, _ahead(panel), REGION)


@query("T7", f"DRS d:PERIODE {WEDGE} problem",
       f"SELECT a.DRS, a.PERIODE, {cols('p')}, "
       "CASE WHEN p.DRS IS NULL THEN 'no source row for the month' END AS problem FROM ahead a LEFT JOIN panel p "
       "ON p.DRS = a.DRS AND month(p.PERIODE) = month(a.PERIODE) AND year(p.PERIODE) = 1998", ctes=AHEAD)
def weather_by_year(spark, d):
    panel = t.panel_once(spark, d)
    return futures.from_year(panel, _ahead(panel), REGION, 1998, on_problem="mark")


_PERSIST = """
bounds AS (SELECT max(PERIODE) AS last_month FROM panel),
tails AS (SELECT *, row_number() OVER (PARTITION BY DRS ORDER BY PERIODE) AS k, count(*) OVER (PARTITION BY DRS) AS n FROM
  (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY DRS ORDER BY PERIODE DESC) <= 12)),
""" + f"""
future AS (SELECT t.DRS, CAST(b.last_month + to_months(CAST(r.k AS INTEGER)) AS DATE) AS PERIODE, r.k AS h, {cols('t')}
  FROM bounds b, range(1, {{n}}) r(k) JOIN tails t ON t.k = (r.k - 1) % t.n + 1)"""


@query("T8", f"DRS d:PERIODE {WEDGE}", "SELECT * FROM future", ctes=_PERSIST.format(n=19))
def weather_by_persistence(spark, d):
    panel = t.panel_once(spark, d)
    return futures.by_persistence(panel, REGION, futures.after_history(panel, REGION), 18)


@query("T10", f"DISTRICT d:PERIODE {WEDGE}",
       f"SELECT DISTRICT, PERIODE, {', '.join('25.0 AS ' + w if w.startswith('temp') else w for w in W)} FROM weather")
def weather_with_override(spark, d):
    base = t.weather_once(spark, d)
    months = base.select("DISTRICT", "PERIODE")
    hot = {"temperature_moyenne": 25.0, "temperature_max": 25.0, "temperature_min": 25.0}
    given = futures.constant(months, DISTRICT.having(exog=tuple(hot)), hot)
    return futures.with_overrides(base, given, DISTRICT)


@query("T11", "problem DRS d:PERIODE",
       """SELECT 'repeated' AS problem, DRS, PERIODE FROM weather GROUP BY ALL HAVING count(*) > 1
          UNION ALL SELECT 'missing', DRS, PERIODE FROM dense ANTI JOIN weather USING (DRS, PERIODE)""",
       ctes="""
dense AS (SELECT DRS, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS PERIODE FROM (
  SELECT DISTINCT DRS, (SELECT min(PERIODE) FROM surv) AS a, (SELECT max(PERIODE) FROM weather) + INTERVAL 2 MONTH AS b FROM surv))""")
def weather_problems(spark, d):
    weather, cases = t.weather_once(spark, d), t.surveillance_once(spark, d)
    validate.require_columns(weather, [*REGION.keys, *REGION.exog], "weather")
    first = cases.agg(F.min("PERIODE").alias("m")).scalar()
    last = weather.agg(F.add_months(F.max("PERIODE"), 2).alias("m")).scalar()
    ends = cases.select("DRS").distinct().withColumns({"a": first, "b": last})
    required = joins.months_for_series(ends, F.col("a"), F.col("b"), "PERIODE")
    repeated = validate.duplicate_months(weather, REGION).select(F.lit("repeated").alias("problem"), "DRS", "PERIODE")
    missing = validate.missing_months(required, weather, ["DRS", "PERIODE"])
    return repeated.unionByName(missing.select(F.lit("missing").alias("problem"), "DRS", "PERIODE"))


def _adjusted_sql(source: str, extra: str = "") -> str:
    def scaled(name, pct):
        return f"CASE WHEN {name} IS NOT NULL THEN greatest(0, {name} * (1 + {pct} / 100)) END AS {name}"

    rows = ", ".join(f"('{n}', {a}, {b}, {c}, {e}, {f})" for n, a, b, c, e, f in fixed.RELATIVE_SCENARIOS)
    return (
        f"SELECT s.name AS scenario, DRS, PERIODE{extra}, temperature_moyenne + dt AS temperature_moyenne, "
        f"temperature_max + dt AS temperature_max, temperature_min + dt AS temperature_min, "
        f"{scaled('precipitation', 'rain')}, "
        "CASE WHEN humidite IS NOT NULL THEN least(greatest(humidite + dh, 0), 100) END AS humidite, "
        f"{scaled('vent', 'wind')}, {scaled('rayonnement_solaire', 'sun')} "
        f"FROM {source}, (VALUES {rows}) s(name, rain, dt, dh, wind, sun)"
    )


@query("T12", f"scenario DRS d:PERIODE {WEDGE}", _adjusted_sql("panel"))
def adjusted_weather(spark, d):
    presets = scenarios.relative_presets()
    assert presets[0].is_neutral() and not presets[1].is_neutral()
    return scenarios.apply_adjustments(t.panel(spark, d), presets)


@query("T13", f"scenario DISTRICT d:PERIODE {WEDGE}",
       "SELECT s.name AS scenario, DISTRICT, PERIODE, temp AS temperature_moyenne, temp AS temperature_max, "
       "temp AS temperature_min, rain AS precipitation, hum AS humidite, wind AS vent, sun AS rayonnement_solaire "
       "FROM surv, (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c}, {e}, {f})" for n, a, b, c, e, f in fixed.ABSOLUTE_SCENARIOS)
       + ") s(name, temp, rain, hum, wind, sun)")
def absolute_scenarios(spark, d):
    return scenarios.apply_absolute(t.surveillance(spark, d), DISTRICT, scenarios.absolute_presets())


# ------------------------------------------------------------------- recursion

_RETRO = f"""
future AS (SELECT DRS, PERIODE, row_number() OVER (PARTITION BY DRS ORDER BY PERIODE) AS h, {WCOLS}
  FROM panel WHERE PERIODE BETWEEN DATE '2000-01-01' AND DATE '2001-06-01')"""


@query("T14", "DRS d:PERIODE r:prediction problem", "SELECT * FROM answered", ctes=_RETRO + "," + recursion("future"))
def recursive_forecast(spark, d):
    """Retro-forecast of eighteen months with the observed weather."""
    panel = t.panel_once(spark, d)
    months = panel.filter(F.col("PERIODE").between(F.lit("2000-01-01").cast("date"), F.lit("2001-06-01").cast("date")))
    return forecast.forecast_by_rule(panel, months.drop("cas"), RULE, REGION, on_problem="mark")


@query("T15", "DRS d:PERIODE r:prediction problem", "SELECT * FROM answered", ctes=_CLIM_FUTURE + "," + recursion("future"))
def forecast_all_regions(spark, d):
    panel = t.panel_once(spark, d)
    return forecast.forecast_by_rule(panel, futures.from_climatology(panel, _ahead(panel), REGION), RULE, REGION, on_problem="mark")


@query("T16", "DRS d:PERIODE r:prediction problem", "SELECT * FROM answered", ctes=_PERSIST.format(n=13) + "," + recursion("future"))
def forecast_next_year(spark, d):
    panel = t.panel_once(spark, d)
    weather = futures.by_persistence(panel, REGION, futures.after_history(panel, REGION), 12)
    return forecast.forecast_by_rule(panel, weather, RULE, REGION, on_problem="mark")


def _partial_means(spark, d):
    panel = t.panel_once(spark, d)
    spec = REGION.having(rolls=(3, 6, 12))
    weather = futures.by_persistence(panel, spec, futures.after_history(panel, spec), 12, if_none=0.0)
    return forecast.forecast_by_rule(panel, weather, RULE, spec, fallback="partial", on_problem="mark")


@query("T17", "DRS d:PERIODE r:prediction problem", "SELECT * FROM answered",
       ctes=_PERSIST.format(n=13) + "," + recursion("future", mean=PARTIAL_MEAN_3, partial=True))
def forecast_with_partial_means(spark, d):
    return _partial_means(spark, d)


@query("T17_whole", "DRS d:PERIODE r:prediction problem", "SELECT * FROM answered",
       ctes=_PERSIST.format(n=13) + "," + recursion("future", mean=PARTIAL_MEAN_3, partial=True))
def forecast_with_partial_means_of_all(spark, d):
    """T17 under its earlier name."""
    return _partial_means(spark, d)


_SHOT = (("lag_1", 0.4), ("rolling_mean_3", 0.3), ("lag_12", 0.2), ("precipitation", 0.05), ("quarter", 0.1))
_SHOT_RULE = forecast.Rule(dict(_SHOT), 0.25)


def _shot_sql(terms) -> str:
    return "0.25" + "".join(f" + ({w}) * ({terms.get(n, 'f.' + n)})" for n, w in _SHOT)


def _complete_districts(spark, d):
    frame = features.create_district_features(t.merged(spark, d).drop("DRS", "tpi2"), DISTRICT)
    complete = features.complete_rows(frame, [c for c in frame.columns if c not in ("DISTRICT", "PERIODE")])
    return written(complete, "district_features")


_NO_HISTORY = "CASE WHEN f.PERIODE IS NULL THEN 'no history before the requested month' END"
_COMPLETE = DISTRICT_FEATURES + """,
complete AS (SELECT * FROM district_features WHERE lag_12 IS NOT NULL AND rolling_mean_6 IS NOT NULL AND diff_1 IS NOT NULL
  AND """ + " AND ".join(f"{w} IS NOT NULL" for w in W) + ")"
_CARRIED = ["cas", *W, "lag_1", "lag_12", "rolling_mean_3", "month", "quarter", "year"]


@query("T18", "DISTRICT d:PERIODE d:observed_at r:prediction problem",
       f"""SELECT a.DISTRICT, a.PERIODE, f.PERIODE AS observed_at,
             CASE WHEN f.PERIODE IS NOT NULL THEN
               {_shot_sql({'precipitation': 'coalesce(a.rain, f.precipitation)', 'quarter': 'quarter(a.PERIODE)'})} END AS prediction,
             {_NO_HISTORY} AS problem
           FROM (SELECT DISTRICT, PERIODE, CASE WHEN month(PERIODE) <= 6 THEN precipitation END AS rain FROM weather) a
           ASOF LEFT JOIN complete f ON f.DISTRICT = a.DISTRICT AND a.PERIODE > f.PERIODE""", ctes=_COMPLETE)
def one_shot_forecasts(spark, d):
    """One request per district and shipping month; the rain is given for half of them."""
    weather = t.weather_once(spark, d)
    given = weather.select(
        "DISTRICT", "PERIODE", F.when(F.month("PERIODE") <= 6, F.col("precipitation")).alias("precipitation"))
    return forecast.one_shot(
        weather.select("DISTRICT", "PERIODE"), _complete_districts(spark, d), DISTRICT,
        lambda rows: _SHOT_RULE.on(rows, clamp=False), _CARRIED, given, on_problem="mark", unique=True)


@query("T19", "DISTRICT d:PERIODE r:prediction problem",
       f"""SELECT a.DISTRICT, a.PERIODE, CASE WHEN f.PERIODE IS NOT NULL THEN {_shot_sql({'quarter': 'quarter(a.PERIODE)'})} END
             AS prediction, {_NO_HISTORY} AS problem
           FROM (SELECT DISTRICT, CAST(unnest(generate_series(DATE '2001-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE)
                   AS PERIODE FROM (SELECT DISTINCT DISTRICT FROM complete)
                 UNION ALL
                 SELECT DISTRICT, CAST(max(PERIODE) + INTERVAL 1 MONTH AS DATE) FROM complete GROUP BY DISTRICT) a
           ASOF LEFT JOIN complete f ON f.DISTRICT = a.DISTRICT AND a.PERIODE > f.PERIODE""", ctes=_COMPLETE)
def range_and_next_month(spark, d):
    """A range of months for every district, and the month after its last row."""
    frame = _complete_districts(spark, d)
    months = forecast.month_range_requests(frame, DISTRICT, F.lit("2001-01-01").cast("date"), F.lit("2001-12-01").cast("date"))
    asked = months.unionByName(forecast.next_month_requests(frame, DISTRICT))
    return forecast.one_shot(
        asked, frame, DISTRICT, lambda rows: _SHOT_RULE.on(rows, clamp=False), _CARRIED, on_problem="mark")


@query("T20", "DRS d:PERIODE r:prediction r:threshold",
       """SELECT f.DRS, f.PERIODE, f.prediction, t.threshold FROM answered f JOIN (SELECT DRS,
            avg(cas) + 0.1 * stddev_samp(cas) AS threshold FROM panel GROUP BY DRS) t USING (DRS)
          WHERE f.prediction > t.threshold""", ctes=_CLIM_FUTURE + "," + recursion("future"))
def alerts(spark, d):
    """Alerts on the recursive forecast of the next year."""
    limits = evaluate.alert_thresholds(t.panel_once(spark, d), REGION, 0.1)
    made = forecast_all_regions(spark, d).select("DRS", "PERIODE", "prediction")
    return evaluate.detect_alerts(made, limits, REGION)


# the last cut-off leaves fewer than twelve months on record
_CUTOFFS = ["1998-12-01", "1999-12-01", "2000-06-01", "2001-03-01"]
_BACKTEST = f"""
cuts AS (SELECT CAST(c AS DATE) AS cutoff, least(12, date_diff('month', CAST(c AS DATE), last_month)) AS expected
  FROM (VALUES {', '.join(f"('{c}')" for c in _CUTOFFS)}) v(c), (SELECT max(PERIODE) AS last_month FROM panel)),
future AS (SELECT DRS, cutoff, expected, PERIODE, row_number() OVER (PARTITION BY DRS, cutoff ORDER BY PERIODE) AS h, {WCOLS}
  FROM panel, cuts WHERE PERIODE > cutoff AND PERIODE <= cutoff + INTERVAL 12 MONTH),""" + recursion(
    "future", "cutoff", expect="expected") + """,
wanted AS (SELECT DRS, cutoff, k AS h, CAST(cutoff + to_months(CAST(k AS INTEGER)) AS DATE) AS PERIODE
  FROM (SELECT DISTINCT DRS FROM panel), cuts, range(1, 13) r(k) WHERE k <= expected),
back AS (SELECT w.DRS, w.cutoff, w.PERIODE, w.h, p.cas AS observe, m.prediction AS prevu,
    CASE WHEN c.DRS IS NULL THEN 'missing months' ELSE c.problem END AS problem
  FROM wanted w LEFT JOIN checked c ON c.DRS = w.DRS AND c.cutoff = w.cutoff
  LEFT JOIN made m ON m.DRS = w.DRS AND m.cutoff = w.cutoff AND m.PERIODE = w.PERIODE
  LEFT JOIN panel p ON p.DRS = w.DRS AND p.PERIODE = w.PERIODE)"""


def _backtest(spark, d):
    return forecast.backtest(t.panel_once(spark, d), REGION, _CUTOFFS, 12, rule=RULE, on_problem="mark")


@query("T21", "DRS d:cutoff d:PERIODE r:observe r:prevu problem", "SELECT * FROM back", ctes=_BACKTEST)
def backtests(spark, d):
    return _backtest(spark, d)


@query("T22", "DRS d:cutoff d:PERIODE i:h r:gap r:gap_percent problem",
       "SELECT DRS, cutoff, PERIODE, h, prevu - observe AS gap, problem, "
       "CASE WHEN observe > 0 THEN (prevu - observe) / observe * 100 END AS gap_percent FROM back", ctes=_BACKTEST)
def errors_by_step(spark, d):
    return evaluate.errors_by_horizon(_backtest(spark, d), ["DRS", "cutoff"], REGION)


# ------------------------------------------------------------------- scenarios

_SCENARIOS = _CLIM_FUTURE.replace("future AS", "usual AS") + f""",
future AS ({_adjusted_sql('usual', ', h')}),""" + recursion("future", "scenario")
_BASE = fixed.RELATIVE_SCENARIOS[0][0]


def _scenario_forecast(spark, d):
    panel = t.panel_once(spark, d)
    usual = futures.from_climatology(panel, _ahead(panel), REGION)
    every = scenarios.apply_adjustments(usual, scenarios.relative_presets())
    return forecast.forecast_by_rule(panel, every, RULE, REGION, ("scenario",), on_problem="mark")


@query("T23", "scenario DRS d:PERIODE r:prediction r:gap",
       f"""SELECT m.scenario, m.DRS, m.PERIODE, m.prediction, m.prediction - b.prediction AS gap FROM answered m
           JOIN answered b ON b.DRS = m.DRS AND b.PERIODE = m.PERIODE AND b.scenario = '{_BASE}'
           WHERE m.scenario <> '{_BASE}'""", ctes=_SCENARIOS)
def compared_scenarios(spark, d):
    return scenarios.scenario_gaps(_scenario_forecast(spark, d), REGION, _BASE)


@query("A22", "scenario r:total r:vs_base_percent i:unanswered",
       f"""SELECT scenario, sum(prediction) AS total, count(*) - count(prediction) AS unanswered, CASE WHEN scenario <> '{_BASE}' THEN (sum(prediction)
             - (SELECT sum(prediction) FROM answered WHERE scenario = '{_BASE}'))
             / (SELECT sum(prediction) FROM answered WHERE scenario = '{_BASE}') * 100 END AS vs_base_percent
           FROM answered GROUP BY scenario""", ctes=_SCENARIOS)
def totals_of_scenarios(spark, d):
    return scenarios.scenario_totals(_scenario_forecast(spark, d), _BASE)


@query("T24", "d:PERIODE r:National_Prediction i:unanswered",
       "SELECT PERIODE, sum(prediction) AS National_Prediction, count(*) - count(prediction) AS unanswered "
       "FROM answered GROUP BY PERIODE",
       ctes=_CLIM_FUTURE + "," + recursion("future"))
def national_forecast(spark, d):
    return forecast.national(forecast_all_regions(spark, d))


@query("T25", "DRS d:PERIODE r:cas r:prediction",
       """SELECT DRS, PERIODE, cas, prediction FROM fitted JOIN (SELECT PERIODE, row_number() OVER (ORDER BY PERIODE) AS i,
            count(*) OVER () AS n FROM (SELECT DISTINCT PERIODE FROM panel)) USING (PERIODE)
          WHERE i > n - greatest(1, CAST(floor(n * 0.2) AS INTEGER))""", ctes=FITTED)
def actual_and_predicted(spark, d):
    """Predictions on the complete rows of the test months."""
    frame = features.create_features(split.period_split(t.panel_once(spark, d), REGION), REGION)
    rows = features.complete_rows(frame.filter(F.col("part") == "test"), features.feature_names(REGION))
    return RULE.on(rows)
