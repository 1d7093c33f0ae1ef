"""Fitted learners checked by SQL over their node tables and stored predictions, searches against single fits."""

import duckdb
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from monthloom.operators import estimators, features, forecast, futures, learn, normal, trees
from monthloom.plans import learning
from monthloom.plans.catalogue import QUERIES
from monthloom.plans.tables import panel_once
from monthloom.spec import REGION as SPEC
from tests.conftest import SF_DIR

NUMERIC = features.feature_names(SPEC)[1:]
SMALL = {"maxIter": 6, "maxDepth": 3, "l1": 1.0, "stepSize": 0.3}


@pytest.fixture(scope="module")
def trained(spark, stored):
    from monthloom.plans import tables

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tables, "surveillance", lambda s, d: stored["surveillance"])
        patch.setattr(tables, "weather", lambda s, d: stored["weather"])
        panel = panel_once(spark, SF_DIR)
        frame = learning._frame(spark, SF_DIR)
        train, test = (p.cache() for p in learning._parts(frame))
    return panel, train, test, learn.fit(train, SPEC, NUMERIC, learn.BOOSTING, SMALL)


def node_sql(nodes: str, values: str) -> str:
    """Predictions of every row by walking a node table in SQL."""
    return f"""WITH RECURSIVE walk AS (
        SELECT v.row, n.tree, n.node, n.slot, n.threshold, n.low, n.high, n.value FROM {values} v, {nodes} n
        WHERE n.node = (SELECT min(node) FROM {nodes} m WHERE m.tree = n.tree)
        UNION ALL
        SELECT w.row, c.tree, c.node, c.slot, c.threshold, c.low, c.high, c.value FROM walk w
        JOIN {values} v ON v.row = w.row
        JOIN {nodes} c ON c.tree = w.tree AND c.node = CASE WHEN v.x[w.slot + 1] <= w.threshold THEN w.low ELSE w.high END
        WHERE w.slot >= 0)
      SELECT row, sum(value) AS total FROM walk WHERE slot < 0 GROUP BY row ORDER BY row"""


def test_predictions_are_those_of_the_node_table(spark, trained):
    from pyspark.ml.functions import vector_to_array

    _, _, test, model = trained
    last = model.stages[-1]
    scored = model.transform(test).select(vector_to_array("features").alias("x"), "prediction", "cas").toPandas()
    nodes = last.node_table(spark).toPandas()
    values = scored[["x"]].assign(row=range(len(scored)))
    con = duckdb.connect()
    con.register("nodes", nodes)
    con.register("vals", values)
    totals = [r[1] for r in con.execute(node_sql("nodes", "vals")).fetchall()]
    assert np.allclose(np.array(totals) + last.trees.base, scored["prediction"])
    # metrics from the stored predictions
    con.register("scored", scored[["prediction", "cas"]])
    mae, rmse = con.execute("""SELECT avg(abs(greatest(prediction, 0) - cas)), sqrt(avg(power(greatest(prediction, 0) - cas, 2)))
      FROM scored""").fetchone()
    found = learn.evaluate_model(model, test, SPEC)
    assert (found["mae"], found["rmse"]) == (pytest.approx(mae), pytest.approx(rmse))
    # importance from the node table
    counts = dict(con.execute("SELECT slot, count(*) FROM nodes WHERE slot >= 0 GROUP BY slot").fetchall())
    assert {r["slot"]: r["n"] for r in learn.split_counts(spark, last).collect()} == counts
    table = learn.importance_table(spark, model, test)
    assert learn.top_features(table, 20).count() == 20 and learn.top_features(table, 1).first()["importance"] == max(counts.values())
    assert learn.family_importance(table).agg(F.sum("importance")).first()[0] == sum(counts.values())
    assert "nodes" not in {r["parameter"] for r in learn.parameter_sheet(spark, model).collect()}


def test_stored_and_loaded(spark, trained, tmp_path):
    _, train, test, model = trained
    line = learn.fit(train, SPEC, NUMERIC, learn.EPSILON, {"epsilon": 0.5, "cost": 1.0})
    for k, m in enumerate((model, line)):
        m.save(f"{tmp_path}/{k}")
        again = PipelineModel.load(f"{tmp_path}/{k}")
        a, b = (v.transform(test).agg(F.sum("prediction"), F.max("prediction")).first() for v in (m, again))
        assert tuple(a) == pytest.approx(tuple(b))


def test_array_fold_equals_the_stepwise_forecast(spark, trained):
    """The same months by expression and by running the pipeline step by step."""
    panel, train, _, model = trained
    weather = futures.by_persistence(panel, SPEC, futures.after_history(panel, SPEC), 12)
    folded = forecast.forecast_by_rule(panel, weather, learn.as_tree_rule(model, train), SPEC, on_problem="mark")
    steps = forecast.forecast_by_model(panel, weather, model, SPEC, 12, on_problem="mark")
    a, b = ({(r["DRS"], r["PERIODE"]): (r["prediction"], r["problem"]) for r in f.collect()} for f in (folded, steps))
    assert a.keys() == b.keys() and len(a) == 300
    assert all(a[k][1] == b[k][1] and (a[k][0] is None or abs(a[k][0] - b[k][0]) < 1e-9) for k in a)
    assert "ExistingRDD" not in folded._jdf.queryExecution().executedPlan().toString()  # no checkpoint


POINTS = [
    (learn.BOOSTING, [{"maxIter": n, "maxDepth": d, "stepSize": 0.2} for n in (3, 8) for d in (2, 4)]),
    (learn.LEAFWISE, [{"maxIter": n, "maxDepth": 0, "leaves": 5, "l1": 1.0} for n in (2, 5)]),
    (learn.SYMMETRIC, [{"maxIter": 4, "symmetric": True, "maxDepth": 2}]),
    (learn.EPSILON, [{"epsilon": 0.5, "cost": 0.1}, {"epsilon": 2.0, "cost": 1.0}]),
]


@pytest.mark.parametrize("learner, points", POINTS, ids=lambda v: getattr(v, "name", ""))
def test_many_fits_at_once_score_like_single_fits(spark, trained, learner, points):
    """Points that share a fit, and all folds, against one distributed fit for each."""
    _, train, _, _ = trained
    together = learn.search(train, SPEC, NUMERIC, learner, points, 2)
    alone = learn.Learner(learner.name, learner.build, scaled=learner.scaled)
    single = learn.search(train, SPEC, NUMERIC, alone, points, 2)
    assert [r["params"] for r in together] == points
    assert [r["rmse"] for r in together] == pytest.approx([r["rmse"] for r in single], rel=1e-6)


def test_forests_at_once_score_near_library_forests(spark, trained):
    _, train, _, _ = trained
    points = [{"numTrees": 40, "maxDepth": 5, "minInstancesPerNode": 4, "featureSubsetStrategy": "all"}]
    together = learn.search(train, SPEC, NUMERIC, learn.FOREST, points, 2)[0]["rmse"]
    single = learn.search(train, SPEC, NUMERIC, learn.Learner("forest", learn.FOREST.build), points, 2)[0]["rmse"]
    assert abs(together - single) < 0.1 * single


def test_searches_repeat(spark, trained):
    _, train, _, _ = trained
    points = learn.random_points(learn.BOOSTING.space, 3)
    points = [{**p, "maxIter": 5} for p in points]
    a, b = (learn.search(train.repartition(n), SPEC, NUMERIC, learn.BOOSTING, points, 2) for n in (2, 5))
    assert a == b


def test_large_tables_are_fitted_by_spark(spark, trained, monkeypatch):
    _, train, test, model = trained
    monkeypatch.setattr(trees, "SMALL_CELLS", 0)
    large = learn.fit(train, SPEC, NUMERIC, learn.BOOSTING, {**SMALL, "maxIter": 3})
    monkeypatch.undo()
    small = learn.fit(train, SPEC, NUMERIC, learn.BOOSTING, {**SMALL, "maxIter": 3})
    a, b = (m.transform(test).select("DRS", "PERIODE", "prediction").orderBy("DRS", "PERIODE").toPandas()["prediction"] for m in (large, small))
    assert np.allclose(a, b)


def test_lines_of_many_groups_against_brute_force(spark):
    draw = np.random.default_rng(4)
    rows = []
    for g in range(6):
        x = draw.normal(size=(40, 3)) * [1, 50, 0.01]
        y = x @ [g, 0.1, 30] + g + draw.normal(size=40)
        rows += [(f"g{g}", *map(float, r), float(v)) for r, v in zip(x, y)]
    rows += [("flat", 1.0, float(k), 2.0, 1.0) for k in range(5)] + [("one", 1.0, 1.0, 1.0, 1.0), ("g0", None, 1.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "g string, a double, b double, c double, y double")
    fits = {r["g"]: r for r in normal.fit_by_group(table, ["g"], ["a", "b", "c"], "y").collect()}
    assert fits["flat"]["coefficients"] is None and fits["one"]["coefficients"] is None
    for g in range(6):
        own = np.array([r[1:] for r in rows if r[0] == f"g{g}" and r[1] is not None])
        x = np.c_[own[:, :3], np.ones(len(own))]
        w = np.linalg.lstsq(x, own[:, 3], rcond=None)[0]
        assert fits[f"g{g}"]["coefficients"] == pytest.approx(w.tolist(), rel=1e-6, abs=1e-8)
        assert fits[f"g{g}"]["rmse"] == pytest.approx(np.sqrt(np.mean((x @ w - own[:, 3]) ** 2)), rel=1e-6)


def test_cutoffs_before_between_and_after_the_months(spark):
    rows = [(f"2020-{m:02d}-01", float(m), float(m * m % 7)) for m in range(1, 11) if m != 6]
    table = spark.createDataFrame(rows, "t string, x double, y double").withColumn("t", F.col("t").cast("date"))
    cutoffs = ["2019-01-01", "2020-03-01", "2020-06-15", "2030-01-01"]
    found = {str(r["cutoff"]): r for r in normal.fit_by_cutoff(table, "t", cutoffs, ["x"], "y").collect()}
    assert set(found) == set(cutoffs[1:])
    for c, r in found.items():
        own = np.array([v[1:] for v in rows if v[0] <= c])
        assert r["n"] == len(own) and r["coefficients"] == pytest.approx(np.polyfit(own[:, 0], own[:, 1], 1).tolist())


def test_exact_quantiles_of_a_large_table(spark):
    from monthloom.operators.evaluate import exact_quantiles
    from monthloom.session import written

    draw = np.random.default_rng(5)
    values = np.r_[draw.normal(size=4000), np.zeros(2500)]
    table = written(spark.createDataFrame([(float(v),) for v in values], "v double"), "values")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    for accuracy in (10_000, 100):
        assert exact_quantiles(table, "v", shares, accuracy) == pytest.approx(np.quantile(values, shares).tolist())
    assert exact_quantiles(table.limit(0), "v", [0.5]) == [None]


def test_nothing_to_predict_from(spark, trained):
    with pytest.raises(ValueError, match="no rows"):
        estimators.HistogramBoosting(featuresCol="features", labelCol="label").fit(
            learn.encoder(None, ["cas"]).fit(trained[1]).transform(trained[1].withColumn("label", F.col("cas"))).limit(0))


def test_real_boosting_beats_the_seasonal_naive_forecast(spark, quick_tables):
    row = QUERIES["M6_boosting"](spark, SF_DIR).first()
    assert row["error"] is None and row["rmse"] < row["naive_rmse"]
