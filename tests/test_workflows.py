"""Whole tasks on a small panel."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from monthloom.functions import fixed
from monthloom.operators import futures, joins, learn, scenarios
from monthloom.operators.aggregate import hierarchy
from monthloom.operators.forecast import Rule
from monthloom.plans import workflows
from monthloom.session import sized_for
from monthloom.sources import registry
from pyspark.sql import types as T
from tests import panels
from tests.panels import SPEC, W, months, random_panel, to_spark

RULE = Rule({"target_lag_1": 0.6, "vent": 0.1})


@pytest.fixture(scope="module")
def panel(spark):
    pdf = random_panel(33, series=3, n=40, gap=0.0)
    return to_spark(spark, pdf[pdf["DRS"] != "DRS Z"]).cache()


def test_shared_weather_serves_every_series(spark, panel):
    shared = panel.filter("DRS = 'DRS A' and PERIODE >= '2018-01-01'").select("PERIODE", *W)
    made = workflows.predict_range(panel, RULE, SPEC, "2018-01", "2018-04", shared)
    assert made.groupBy("DRS").count().filter("count = 4").count() == 3
    nation = workflows.predict_national_range(panel, RULE, SPEC, "2018-01", "2018-04", shared)
    assert nation.agg(F.sum("National_Prediction")).first()[0] == pytest.approx(made.agg(F.sum("prediction")).first()[0])
    one = workflows.predict_range(panel, RULE, SPEC, "2018-01", "2018-04", shared, ["DRS B"])
    assert one.exceptAll(made).count() == 0 and one.count() == 4


def test_errors_of_a_range(spark, panel):
    weather = panel.select("DRS", "PERIODE", *W)
    with pytest.raises(ValueError, match="start must not be after stop"):
        workflows.predict_range(panel, RULE, SPEC, "2018-04", "2018-01", weather)
    with pytest.raises(Exception, match="unknown series"):
        workflows.predict_range(panel, RULE, SPEC, "2018-01", "2018-02", weather, ["DRS Q"]).collect()
    with pytest.raises(Exception, match="missing feature values"):
        workflows.predict_range(panel, RULE, SPEC, "2018-01", "2018-12", weather).collect()
    with pytest.raises(ValueError, match="missing columns: vent"):
        workflows.predict_range(panel, RULE, SPEC, "2018-01", "2018-02", weather.drop("vent"))


def test_forecast_many_and_next_year(spark, panel):
    made = workflows.forecast_many(
        panel, RULE, SPEC, "2018-05", 14, lambda asked: futures.from_climatology(panel, asked, SPEC))
    assert made.count() == 3 * 14
    assert made.agg(F.max("PERIODE")).first()[0] == dt.date(2019, 6, 1)
    year = workflows.forecast_next_year(panel, RULE, SPEC, 18)
    assert year.count() == 3 * 18 and year.agg(F.min("PERIODE")).first()[0] == dt.date(2018, 5, 1)


def test_scenarios_are_compared_with_the_base(spark, panel):
    made = workflows.compare_scenarios(panel, RULE, SPEC, "2018-05", 6, [scenarios.Adjustment("windy", wind_pct=50)])
    totals = {r["scenario"]: r for r in scenarios.scenario_totals(made).collect()}
    assert totals["windy"]["vs_base_percent"] > 0 and totals[fixed.BASE_SCENARIO]["vs_base_percent"] is None


def test_training_stores_everything(spark, panel, tmp_path):
    points = {"forest": [{"numTrees": 3, "maxDepth": 2}, {"numTrees": 5, "maxDepth": 3}], "boosting": [{"maxIter": 3}]}
    done = workflows.train(
        panel, SPEC, str(tmp_path), learners=(learn.FOREST, learn.BOOSTING), points=lambda l: points[l.name], n_splits=2)
    stored = registry.load_model(spark, f"{tmp_path}/DRS")
    assert stored.features[0] == "DRS" and done.best in points
    run = registry.read_runs(spark, f"{tmp_path}/runs").first()
    assert run["algorithm"] == done.best and run["best_params"] == {k: str(v) for k, v in done.params.items()}
    ahead = spark.read.option("header", True).csv(f"{tmp_path}/next_months")
    assert ahead.count() == 36 and ahead.columns == ["DRS", "PERIODE", "prediction"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/comparison").count() == 2


def test_fixed_tables_as_lookups(spark):
    centroids = joins.lookup_table(
        spark, "DRS", panels.REGION_CENTROIDS,
        T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
    asked = spark.createDataFrame([("DRS Dakar",), ("DRS Thies",)], "DRS string")
    assert {r["lat"] for r in joins.strict_lookup(asked, centroids, "DRS").collect()} == {14.72, 14.79}
    colours = joins.lookup_table(
        spark, "region", panels.REGION_COLOURS, T.StructType([T.StructField("colour", T.StringType())]))
    places = spark.createDataFrame([("Kolda",), ("Elsewhere",)], "region string")
    got = joins.lookup_or(places, colours, "region", "colour", panels.OTHER_COLOUR)
    assert {(r["region"], r["colour"]) for r in got.collect()} == {("Kolda", "darkblue"), ("Elsewhere", "blue")}


def test_hierarchy_is_bounded(spark):
    df = spark.range(50).select(F.lit("a").alias("u"), F.col("id").cast("string").alias("l"))
    assert len(hierarchy(df, "u", "l", 100).first()["members"]) == 50
    with pytest.raises(Exception, match="more than 10 members of a"):
        hierarchy(df, "u", "l", 10).collect()


def test_shuffle_partitions_follow_the_input():
    assert sized_for(100 * 10**12, 8000)["spark.sql.shuffle.partitions"] == str(-(-100 * 10**12 // (128 * 1024 * 1024)))
    assert sized_for(10**6, 8)["spark.sql.shuffle.partitions"] == "16"
