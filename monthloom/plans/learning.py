"""Registered queries that fit models on the feature frame."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.operators import features, forecast, futures, learn, split
from monthloom.operators.aggregate import build_panel
from monthloom.plans import tables as t
from monthloom.plans import workflows
from monthloom.plans.registry import query
from monthloom.plans.sql import FEATURES, W
from monthloom.session import scratch_dir, written
from monthloom.spec import NATION, REGION

NUMERIC = features.feature_names(REGION)[1:]
_COMPLETE = " AND ".join(f"{w} IS NOT NULL" for w in W) + " AND target_lag_12 IS NOT NULL"

# the largest sizes of the search spaces
WHOLE_FOREST = (learn.FOREST, {"numTrees": 200, "maxDepth": 15})
WHOLE_BOOSTING = (learn.BOOSTING, {"maxIter": 400, "maxDepth": 3, "stepSize": 0.05})
QUICK_ROBUST = (learn.ROBUST, {"epsilon": 1.35, "regParam": 0.01})


def _frame(spark, d) -> DataFrame:
    """Complete feature rows, marked train or test.

    The features of all months are written once; months are split before the
    incomplete rows go.
    """
    stored = written(features.create_features(t.panel(spark, d), REGION), "features")
    return features.complete_rows(split.period_split(stored, REGION), features.feature_names(REGION))


def _parts(frame):
    return frame.filter(F.col("part") == "train"), frame.filter(F.col("part") == "test")


def _naive_rmse(test: DataFrame):
    error = F.col("target_lag_12") - F.col("cas")
    return test.agg(F.sqrt(F.avg(error * error)).alias("naive_rmse"))


def _scored(spark, d, candidate) -> DataFrame:
    """Hold-out error of one learner next to the seasonal-naive error."""
    frame = _frame(spark, d)
    train, test = _parts(frame)
    results, _ = learn.compare(train, test, REGION, NUMERIC, [candidate])
    naive = _naive_rmse(test).first()[0]
    return results.select("model", "mae", "rmse", "smape", "mape", "accuracy", "r2", "error").withColumn(
        "naive_rmse", F.lit(naive))


@query("M1", "DRS i:slot i:width",
       "SELECT DRS, dense_rank() OVER (ORDER BY DRS) - 1 AS slot, (SELECT count(DISTINCT DRS) FROM panel) AS width FROM panel")
def key_indicators(spark, d):
    panel = t.panel_once(spark, d)
    learn.require_few_keys(panel, "DRS")
    coded = Pipeline(stages=learn.key_stages("DRS")).fit(panel).transform(panel)
    flags = vector_to_array("DRS_flags")
    return coded.select("DRS", (F.array_position(flags, F.lit(1.0)) - 1).alias("slot"), F.size(flags).alias("width"))


@query("M2", "i:c_custkey indicator i:value",
       "SELECT c_custkey, 'segment_' || c_mktsegment AS indicator, 1 AS value FROM customer", base=False)
def dummy_columns(spark, d):
    """Indicators in long form: the one that is set, whatever values there are."""
    customer = t.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return learn.set_indicators(customer, "c_mktsegment", "segment_").select("c_custkey", "indicator", "value")


@query("M3", "DRS d:PERIODE i:width r:total r:first r:last",
       "SELECT DRS, PERIODE, " + str(len(NUMERIC)) + " AS width, " + " + ".join(NUMERIC)
       + f" AS total, {NUMERIC[0]} AS first, {NUMERIC[-1]} AS last FROM features WHERE {_COMPLETE}", ctes=FEATURES)
def assembled_inputs(spark, d):
    frame = features.create_features(t.panel(spark, d), REGION)
    rows = features.complete_rows(frame, features.feature_names(REGION))
    coded = learn.encoder(None, NUMERIC).fit(rows).transform(rows)
    values = vector_to_array("features")
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return coded.select("DRS", "PERIODE", F.size(values).alias("width"), total.alias("total"),
                        F.get(values, 0).alias("first"), F.element_at(values, -1).alias("last"))


@query("M4", "DRS d:PERIODE r:scaled_rain r:scaled_lag",
       f"""SELECT DRS, PERIODE, (precipitation - avg(precipitation) OVER ()) / stddev_samp(precipitation) OVER () AS scaled_rain,
             (target_lag_1 - avg(target_lag_1) OVER ()) / stddev_samp(target_lag_1) OVER () AS scaled_lag
           FROM features WHERE {_COMPLETE}""", ctes=FEATURES)
def scaled_inputs(spark, d):
    frame = features.create_features(t.panel_once(spark, d), REGION)
    rows = features.complete_rows(frame, features.feature_names(REGION))
    coded = learn.encoder(None, ["precipitation", "target_lag_1"], scaled=True).fit(rows).transform(rows)
    values = vector_to_array("features")
    return coded.select("DRS", "PERIODE", F.get(values, 0).alias("scaled_rain"), F.get(values, 1).alias("scaled_lag"))


@query("M5_forest")
def forest(spark, d):
    return _scored(spark, d, WHOLE_FOREST)


@query("M6_boosting")
def boosting(spark, d):
    return _scored(spark, d, WHOLE_BOOSTING)


@query("M7_robust")
def robust_linear(spark, d):
    return _scored(spark, d, QUICK_ROBUST)


def _search_rows(spark, d, learner, points, n_splits):
    frame = _frame(spark, d)
    train, _ = _parts(frame)
    found = learn.search(train, REGION, NUMERIC, learner, points, n_splits)
    best = learn.best_point(found)
    rows = [(r["model"], {k: str(v) for k, v in r["params"].items()}, r["rmse"], r is best) for r in found]
    made = spark.createDataFrame(rows, "model string, params map<string,string>, rmse double, best boolean")
    return made.withColumn("params", F.to_json("params"))


@query("M8_forest")
def grid_search(spark, d):
    """Every point of the whole forest space over five expanding folds."""
    return _search_rows(spark, d, learn.FOREST, learn.grid_points(learn.FOREST.space), 5)


@query("M9_forest")
def random_search(spark, d):
    """Forty seeded points of the whole forest space over five expanding folds."""
    points = learn.random_points(learn.FOREST.space, learn.RANDOM_POINTS["forest"])
    return _search_rows(spark, d, learn.FOREST, points, 5)


@query("M10_boosting")
def fitted_and_evaluated(spark, d):
    frame = _frame(spark, d)
    train, test = _parts(frame)
    model = learn.fit(train, REGION, NUMERIC, *WHOLE_BOOSTING)
    row = learn.evaluate_model(model, test, REGION)
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))


def _comparison(spark, d):
    frame = _frame(spark, d)
    train, test = _parts(frame)
    results, models = learn.compare(train, test, REGION, NUMERIC, [WHOLE_FOREST, WHOLE_BOOSTING, QUICK_ROBUST])
    return results, models


@query("M11_learners")
def model_comparison(spark, d):
    return learn.ranked(_comparison(spark, d)[0]).drop("params")


@query("O3_learners")
def best_of_comparison(spark, d):
    return learn.best_model(_comparison(spark, d)[0]).drop("params")


def _final(spark, d, candidate=WHOLE_BOOSTING):
    """Model refitted on every complete row, with the panel and its frame."""
    panel = t.panel_once(spark, d)
    frame = features.complete_rows(features.create_features(panel, REGION), features.feature_names(REGION))
    return panel, frame, learn.fit(frame, REGION, NUMERIC, *candidate)


@query("M11_training")
def training(spark, d):
    """The whole training task at its real size; its comparison, with the learner that was refitted and stored."""
    done = workflows.train(t.panel_once(spark, d), REGION, scratch_dir(spark, "training"), on_problem="mark")
    return learn.ranked(done.results).withColumn("best", F.col("model") == done.best).withColumn("params", F.to_json("params"))


@query("M12_boosting", "DRS d:PERIODE r:prediction problem")
def refit_and_forecast(spark, d):
    """Refit on all rows, then twelve recursive months under the usual weather."""
    panel, _, model = _final(spark, d)
    months = futures.future_months(panel, REGION, futures.after_history(panel, REGION), 12)
    return forecast.forecast_by_model(panel, futures.from_climatology(panel, months, REGION), model, REGION, on_problem="mark")


def _importance(spark, d):
    _, frame, model = _final(spark, d)
    return learn.importance_table(spark, model, frame)


@query("M13_boosting")
def importance(spark, d):
    return _importance(spark, d)


@query("O2_boosting")
def top_twenty(spark, d):
    return learn.top_features(_importance(spark, d))


@query("A24_boosting")
def importance_by_family(spark, d):
    return learn.family_importance(_importance(spark, d))


@query("M14_boosting")
def parameters(spark, d):
    return learn.parameter_sheet(spark, _final(spark, d)[2])


@query("T14_model", "DRS d:cutoff d:PERIODE r:observe r:prevu problem")
def model_backtest(spark, d):
    """Back-test with a model trained up to the cut-off only."""
    panel = t.panel_once(spark, d)
    frame = features.complete_rows(features.create_features(panel, REGION), features.feature_names(REGION))
    known = frame.filter(F.col("PERIODE") <= F.lit("1999-12-01").cast("date"))
    model = learn.fit(known, REGION, NUMERIC, *WHOLE_BOOSTING)
    return forecast.backtest(panel, REGION, ["1999-12-01"], 12, model=model, on_problem="mark")


@query("T16_linear", "DRS d:PERIODE r:prediction problem")
def fitted_line_forecast(spark, d):
    """A fitted linear model turned into a column rule for the array fold."""
    panel = t.panel_once(spark, d)
    frame = features.complete_rows(features.create_features(panel, REGION), features.feature_names(REGION))
    plain = learn.Learner("line", learn.ROBUST.build)
    rule = learn.as_rule(learn.fit(frame, REGION, NUMERIC, plain, QUICK_ROBUST[1], key=None), frame)
    weather = futures.by_persistence(panel, REGION, futures.after_history(panel, REGION), 12)
    return forecast.forecast_by_rule(panel, weather, rule, REGION, on_problem="mark")


@query("M5_national", "d:PERIODE r:cas r:prediction")
def national_forest(spark, d):
    """The national series as one more series of the same kind: fitted before the held-out months, predicted for them."""
    spec = REGION.having(exog_agg=NATION.exog_agg)
    nation = build_panel(t.merged(spark, d).withColumn("DRS", F.lit("national")), spec)
    stored = written(features.create_features(nation, spec), "national")
    frame = features.complete_rows(split.period_split(stored, spec), features.feature_names(spec))
    train, test = _parts(frame)
    model = learn.fit(train, spec, NUMERIC, *WHOLE_FOREST, key=None)
    return model.transform(test).select("PERIODE", "cas", "prediction")
