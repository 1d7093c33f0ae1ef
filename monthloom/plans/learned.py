"""Learning operators run with learners whose results SQL can state: lines, stumps and means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions import fixed
from monthloom.operators import features, forecast, futures, learn, split
from monthloom.plans import tables as t
from monthloom.plans.forecasting import _CLIM_FUTURE, _PERSIST, _ahead
from monthloom.plans.registry import query
from monthloom.plans.sql import FEATURES, W, recursion
from monthloom.session import scratch_dir, written
from monthloom.sources import registry
from monthloom.spec import REGION

LAGS = [f"target_lag_{k}" for k in REGION.lags]
CALENDAR = ["month", "year"]
_COMPLETE = " AND ".join(f"{w} IS NOT NULL" for w in W) + " AND target_lag_12 IS NOT NULL"
_PARTS = FEATURES + f""",
complete AS (SELECT * FROM features WHERE {_COMPLETE}),
train AS (SELECT c.* FROM complete c JOIN months USING (PERIODE) WHERE i <= n - greatest(1, CAST(floor(n * 0.2) AS INTEGER))),
test AS (SELECT c.* FROM complete c JOIN months USING (PERIODE) WHERE i > n - greatest(1, CAST(floor(n * 0.2) AS INTEGER)))"""
_PARTS = _PARTS.replace("complete AS", """months AS (SELECT PERIODE, row_number() OVER (ORDER BY PERIODE) AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT PERIODE FROM panel)),
complete AS""", 1)


def _parts(spark, d) -> tuple[DataFrame, DataFrame]:
    stored = written(split.period_split(features.create_features(t.panel(spark, d), REGION), REGION), "features")
    frame = features.complete_rows(stored, features.feature_names(REGION))
    return frame.filter(F.col("part") == "train"), frame.filter(F.col("part") == "test")


# ---------------------------------------------------------------------- stumps


def _stump_sql(rows: str, value: str, name: str, of: tuple[str, ...] = ("month",)) -> str:
    """CTE ``name`` (feature, cut, low, high): the split with the least squared error."""
    sides = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {k} AS slot, c.{c} AS cut, "
        f"avg({value}) FILTER (r.{c} <= c.{c}) AS low, avg({value}) FILTER (r.{c} > c.{c}) AS high, "
        f"count(*) FILTER (r.{c} <= c.{c}) AS n_low, count(*) FILTER (r.{c} > c.{c}) AS n_high "
        f"FROM {rows} r, (SELECT DISTINCT {c} FROM {rows}) c GROUP BY c.{c}" for k, c in enumerate(of))
    return (f"{name} AS (SELECT feature, cut, low, high FROM ({sides}) WHERE n_high > 0 "
            "ORDER BY n_low * low * low + n_high * high * high DESC, slot, cut LIMIT 1)")


_STUMP = {"numTrees": 1, "maxDepth": 1, "bootstrap": False, "featureSubsetStrategy": "all", "subsamplingRate": 1.0}
_MONTHS = "(SELECT unnest(range(1, 13)) AS month)"


def _by_month(spark, model) -> DataFrame:
    rows = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return model.transform(rows).select("month", "prediction")


@query("M5", "i:month r:prediction",
       f"SELECT month, CASE WHEN month <= cut THEN low ELSE high END AS prediction FROM {_MONTHS}, stump",
       ctes=_PARTS + ",\n" + _stump_sql("train", "cas", "stump"))
def stump(spark, d):
    """A forest of one tree of depth one on the month of year."""
    return _by_month(spark, learn.fit(_parts(spark, d)[0], REGION, ["month"], learn.FOREST, _STUMP, key=None))


@query("M6", "i:month r:prediction",
       f"""SELECT month, (CASE WHEN month <= a.cut THEN a.low ELSE a.high END)
             + 0.1 * (CASE WHEN month <= b.cut THEN b.low ELSE b.high END) AS prediction FROM {_MONTHS}, first_stump a, second_stump b""",
       ctes=_PARTS + ",\n" + _stump_sql("train", "cas", "first_stump") + """,
residuals AS (SELECT month, 2 * (cas - CASE WHEN month <= cut THEN low ELSE high END) AS r FROM train, first_stump),
""" + _stump_sql("residuals", "r", "second_stump").replace("avg(r)", "avg(r.r)"))
def two_rounds(spark, d):
    """Two rounds of boosting: a stump on the target, and one on twice the residual, added at the step size."""
    params = {"maxIter": 2, "maxDepth": 1, "stepSize": 0.1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    return _by_month(spark, learn.fit(_parts(spark, d)[0], REGION, ["month"], learn.STAGED, params, key=None))


def _importance(spark, d) -> DataFrame:
    train, _ = _parts(spark, d)
    model = learn.fit(train, REGION, CALENDAR, learn.FOREST, _STUMP, key=None)
    return learn.importance_table(spark, model, train)


_IMPORTANCE = _PARTS + ",\n" + _stump_sql("train", "cas", "stump", tuple(CALENDAR)) + f""",
importance AS (SELECT c.feature, CASE WHEN c.feature = s.feature THEN 1.0 ELSE 0.0 END AS importance,
  '{fixed.FAMILY_CALENDAR}' AS famille FROM (VALUES {", ".join(f"('{c}')" for c in CALENDAR)}) c(feature), stump s)"""


@query("M13", "feature r:importance famille", "SELECT * FROM importance", ctes=_IMPORTANCE)
def importance(spark, d):
    return _importance(spark, d)


@query("O2", "feature r:importance", "SELECT feature, importance FROM importance ORDER BY importance DESC, feature LIMIT 1",
       ctes=_IMPORTANCE)
def most_important(spark, d):
    return learn.top_features(_importance(spark, d), 1)


@query("A24", "famille r:importance", "SELECT famille, sum(importance) AS importance FROM importance GROUP BY famille",
       ctes=_IMPORTANCE)
def importance_by_family(spark, d):
    return learn.family_importance(_importance(spark, d))


# ----------------------------------------------------------------------- lines


def _line_cte(rows: str, x: str = "target_lag_1", name: str = "line") -> str:
    return f"{name} AS (SELECT regr_intercept(cas, {x}) AS a, regr_slope(cas, {x}) AS b FROM {rows})"


@query("M7", "r:intercept r:slope", "SELECT a AS intercept, b AS slope FROM line", ctes=_PARTS + ",\n" + _line_cte("train"))
def line(spark, d):
    """Squared loss on one variable has a closed form."""
    model = learn.fit(_parts(spark, d)[0], REGION, LAGS[:1], learn.LINE, {}, key=None).stages[-1].stages[-1]
    return spark.createDataFrame([(float(model.intercept), float(model.coefficients[0]))], "intercept double, slope double")


_METRICS = """avg(abs(p - cas)) AS mae, sqrt(avg((p - cas) * (p - cas))) AS rmse,
  coalesce(avg(CASE WHEN abs(cas) + abs(p) <> 0 THEN 2 * abs(p - cas) / (abs(cas) + abs(p)) END) * 100, 0) AS smape,
  avg(CASE WHEN cas <> 0 THEN abs((p - cas) / cas) END) * 100 AS mape,
  greatest(0, 100 - avg(CASE WHEN cas <> 0 THEN abs((p - cas) / cas) END) * 100) AS accuracy,
  1 - sum((p - cas) * (p - cas)) / (var_pop(cas) * count(*)) AS r2"""
_M = "r:mae r:rmse r:smape r:mape r:accuracy r:r2"


@query("M10", _M, f"SELECT {_METRICS} FROM (SELECT cas, greatest(0, a + b * target_lag_1) AS p FROM test, line)",
       ctes=_PARTS + ",\n" + _line_cte("train"))
def evaluated_line(spark, d):
    train, test = _parts(spark, d)
    model = learn.fit(train, REGION, LAGS[:1], learn.LINE, {}, key=None)
    row = learn.evaluate_model(model, test, REGION)
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))


_MEAN = {"numTrees": 1, "maxDepth": 0, "bootstrap": False}


def _comparison(spark, d, more=()) -> DataFrame:
    """Lines on two lags and the plain mean, a forest of one leaf."""
    train, test = _parts(spark, d)
    near = learn.Learner("line on lag 1", learn.LINE.build)
    far = learn.Learner("line on lag 12", learn.LINE.build)
    mean = learn.Learner("mean", learn.FOREST.build)
    candidates = [(near, {"slot": 0}), (far, {"slot": len(LAGS) - 1}), (mean, _MEAN), *more]
    return written(learn.compare(train, test, REGION, LAGS, candidates, key=None)[0], "comparison")


_COMPARED = _PARTS + ",\n" + _line_cte("train") + ",\n" + _line_cte("train", "target_lag_12", "far_line") + f""",
scored AS (
  SELECT 'line on lag 1' AS model, cas, greatest(0, a + b * target_lag_1) AS p FROM test, line
  UNION ALL SELECT 'line on lag 12', cas, greatest(0, a + b * target_lag_12) FROM test, far_line
  UNION ALL SELECT 'mean', cas, (SELECT avg(cas) FROM train) FROM test),
compared AS (SELECT model, {_METRICS} FROM scored GROUP BY model)"""


@query("M11", f"model {_M} i:place",
       "SELECT *, row_number() OVER (ORDER BY rmse, model) AS place FROM compared", ctes=_COMPARED)
def model_comparison(spark, d):
    # one row per learner
    rows = learn.ranked(_comparison(spark, d)).collect()
    places = spark.createDataFrame([(r["model"], k) for k, r in enumerate(rows, 1)], "model string, place int")
    return spark.createDataFrame(rows, learn.RESULT_SCHEMA).join(places, "model")


@query("O3", f"model {_M}", "SELECT * FROM compared ORDER BY rmse, model LIMIT 1", ctes=_COMPARED)
def best_of_comparison(spark, d):
    return learn.best_model(_comparison(spark, d))


@query("M15", "model worked names_the_column",
       "SELECT model, true AS worked, false AS names_the_column FROM compared UNION ALL SELECT 'unusable', false, true", ctes=_COMPARED)
def failed_learners(spark, d):
    """A learner that cannot work does not stop the others and says why."""
    broken = learn.Learner("unusable", lambda params: learn.GBTRegressor(featuresCol="absent", labelCol="label"))
    return _comparison(spark, d, [(broken, {})]).select(
        "model", F.col("error").isNull().alias("worked"),
        F.coalesce(F.col("error").contains("absent"), F.lit(False)).alias("names_the_column"))


@query("M14", "parameter value",
       """SELECT * FROM (VALUES ('featuresCol', 'features'), ('labelCol', 'label'), ('maxDepth', '1'), ('numTrees', '1'),
            ('bootstrap', 'False')) v(parameter, value)""", base=False)
def parameters(spark, d):
    """Those of the stump's parameters that were set or name its columns."""
    model = learn.fit(_parts(spark, d)[0], REGION, ["month"], learn.FOREST, _STUMP, key=None)
    named = ["featuresCol", "labelCol", "maxDepth", "numTrees", "bootstrap"]
    return learn.parameter_sheet(spark, model).filter(F.col("parameter").isin(named))


# ---------------------------------------------------------------------- search


_FOLDS = 5
_SEARCHED = """,
fold_months AS (SELECT PERIODE, row_number() OVER (ORDER BY PERIODE) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT PERIODE FROM train)),
folded AS (SELECT t.*, CASE WHEN i >= n - 5 * (n // 6) THEN (i - (n - 5 * (n // 6))) // (n // 6) END AS fold
  FROM train t JOIN fold_months USING (PERIODE)),
long AS (""" + " UNION ALL ".join(f"SELECT {k} AS slot, {x} AS x, cas, fold FROM folded" for k, x in enumerate(LAGS)) + """),
fits AS (SELECT k, slot, free, CASE WHEN free THEN regr_intercept(cas, x) ELSE 0 END AS a,
    CASE WHEN free THEN regr_slope(cas, x) ELSE sum(x * cas) / sum(x * x) END AS b
  FROM long, range(5) r(k), (VALUES (true), (false)) f(free) WHERE fold IS NULL OR fold < k GROUP BY k, slot, free),
errors AS (SELECT l.slot, free, l.fold, sqrt(avg((a + b * x - cas) * (a + b * x - cas))) AS e
  FROM long l JOIN fits f ON f.slot = l.slot AND f.k = l.fold GROUP BY ALL),
tried AS (SELECT slot, free, avg(e) AS rmse FROM errors GROUP BY ALL)"""
_SPACE = {"slot": list(range(len(LAGS))), "fitIntercept": [True, False]}
_DRAWN = learn.random_points(_SPACE, 6)


def _searched(spark, d, points) -> DataFrame:
    train, _ = _parts(spark, d)
    found = learn.search(train, REGION, LAGS, learn.LINE, points, _FOLDS, key=None)
    best = learn.best_point(found)
    rows = [(r["params"]["slot"], r["params"]["fitIntercept"], r["rmse"], r is best) for r in found]
    return spark.createDataFrame(rows, "slot int, free boolean, rmse double, best boolean")


@query("M8", "i:slot free r:rmse best",
       "SELECT slot, free, rmse, rmse = min(rmse) OVER () AS best FROM tried", ctes=_PARTS + _SEARCHED)
def grid_search(spark, d):
    """Lines on every lag with and without intercept over five expanding folds."""
    return _searched(spark, d, learn.grid_points(_SPACE))


@query("M9", "i:slot free r:rmse best",
       "SELECT slot, free, rmse, rmse = min(rmse) OVER () AS best FROM tried JOIN (VALUES "
       + ", ".join(f"({p['slot']}, {p['fitIntercept']})" for p in _DRAWN) + ") v(slot, free) USING (slot, free)",
       ctes=_PARTS + _SEARCHED)
def random_search(spark, d):
    """Seeded draw of six of the points of the grid."""
    return _searched(spark, d, _DRAWN)


# ------------------------------------------------------------ fitted recursion


def _final_line(spark, d):
    panel = t.panel_once(spark, d)
    frame = features.complete_rows(features.create_features(panel, REGION), features.feature_names(REGION))
    return panel, learn.fit(frame, REGION, LAGS[:1], learn.LINE, {}, key=None)


_LINE = FEATURES + f",\ncomplete AS (SELECT * FROM features WHERE {_COMPLETE}),\n" + _line_cte("complete") + ",\n"


@query("M12", "DRS d:PERIODE r:prediction problem", "SELECT * FROM answered",
       ctes=_LINE + _CLIM_FUTURE + "," + recursion("future", line="line"))
def refit_and_forecast(spark, d):
    """Refit on all rows, then twelve recursive months under the usual weather."""
    panel, model = _final_line(spark, d)
    weather = futures.from_climatology(panel, _ahead(panel), REGION)
    return forecast.forecast_by_model(panel, weather, model, REGION, on_problem="mark")


@query("S6", "DRS d:PERIODE r:prediction problem", "SELECT * FROM answered",
       ctes=_LINE + _PERSIST.format(n=7) + "," + recursion("future", line="line"))
def stored_model(spark, d):
    """Save a fitted pipeline with features and history, load it, forecast with it."""
    panel, model = _final_line(spark, d)
    stored = registry.load_model(spark, registry.save_model(spark, scratch_dir(spark, "model"), model, LAGS[:1], panel))
    weather = futures.by_persistence(stored.history, REGION, futures.after_history(stored.history, REGION), 6)
    return forecast.forecast_by_model(stored.history, weather, stored.model, REGION, on_problem="mark")
