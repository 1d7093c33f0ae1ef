"""Recursion, back-tests and their validation against brute force."""

import datetime as dt

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from monthloom.operators import features, forecast, futures, scenarios, validate
from monthloom.operators.forecast import Rule
from tests.panels import SPEC, W, brute_forecast, months, random_panel, to_spark

WEIGHTS = {"target_lag_1": 0.5, "target_lag_12": 0.2, "target_roll_mean_3": 0.4, "target_roll_mean_6": -0.3,
           "vent": 0.05, "month": -0.1}
RULE = Rule(WEIGHTS, 1.0)


def future_of(panel, start, n):
    keys = panel["DRS"].unique()
    source = random_panel(99, series=1, n=n, gap=0.0)
    source = source[source["DRS"] == "DRS A"]
    out = []
    for k in keys:
        rows = source[W].copy()
        rows.insert(0, "PERIODE", months(start, n))
        rows.insert(0, "DRS", k)
        out.append(rows)
    return pd.concat(out, ignore_index=True).assign(cas=None)[["DRS", "PERIODE", "cas", *W]]


def long_series(pdf):
    return pdf[pdf["DRS"] != "DRS Z"]


@pytest.mark.parametrize("start", ["2018-05-01", "2017-03-01"])
def test_fold_equals_brute_force(spark, start):
    """Ahead of the history, and inside it, where later observations must not count."""
    pdf = long_series(random_panel(7, n=40, gap=0.1))
    ahead = future_of(pdf, start, 15)
    want = brute_forecast(pdf, ahead, WEIGHTS, 1.0)
    got = forecast.forecast_by_rule(to_spark(spark, pdf), to_spark(spark, ahead).drop("cas"), RULE, SPEC).collect()
    assert len(got) == len(want) == 6 * 15
    for r in got:
        assert r["prediction"] == pytest.approx(want[(r["DRS"], r["PERIODE"])], abs=1e-9)
        assert r["prediction"] >= 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), horizon=st.integers(1, 24))
def test_fold_on_random_panels(spark, seed, horizon):
    pdf = long_series(random_panel(seed, series=3, n=30, gap=0.2))
    ahead = future_of(pdf, "2017-07-01", horizon)
    want = brute_forecast(pdf, ahead, WEIGHTS, 1.0)
    got = forecast.forecast_by_rule(to_spark(spark, pdf), to_spark(spark, ahead).drop("cas"), RULE, SPEC)
    assert {(r["DRS"], r["PERIODE"]): round(r["prediction"], 6) for r in got.collect()} == {
        k: round(v, 6) for k, v in want.items()}


def test_clamped_value_is_fed_back(spark):
    pdf = long_series(random_panel(0, series=1, n=12, gap=0.0))
    ahead = future_of(pdf, "2016-01-01", 2)
    got = forecast.forecast_by_rule(
        to_spark(spark, pdf), to_spark(spark, ahead).drop("cas"), Rule({"target_lag_1": 1.0}, -1000.0), SPEC)
    assert [r["prediction"] for r in got.orderBy("PERIODE").collect()] == [0.0, 0.0]


def test_partial_means_allow_short_history(spark):
    pdf = random_panel(0, series=1, n=12, gap=0.0)
    pdf = pdf[pdf["DRS"] == "DRS Z"]
    ahead = future_of(pdf, "2015-04-01", 3)
    rule = Rule({"target_roll_mean_3": 1.0})
    got = forecast.forecast_by_rule(
        to_spark(spark, pdf), to_spark(spark, ahead).drop("cas"), rule, SPEC, fallback="partial")
    assert [r["prediction"] for r in got.orderBy("PERIODE").collect()] == [5.0, 5.0, 5.0]


def panel_and_future(spark, change=lambda pdf, ahead: (pdf, ahead)):
    pdf = long_series(random_panel(0, series=2, n=24, gap=0.0))
    ahead = future_of(pdf, "2017-01-01", 4)
    pdf, ahead = change(pdf, ahead)
    return to_spark(spark, pdf), to_spark(spark, ahead).drop("cas")


@pytest.mark.parametrize("change,message", [
    (lambda p, a: (p, a.assign(DRS=a["DRS"].replace("DRS B", "DRS Q"))), "unknown series"),
    (lambda p, a: (p[(p["DRS"] == "DRS A") | (p["PERIODE"] >= dt.date(2016, 2, 1))], a), "found 11"),
    (lambda p, a: (p, a[(a["DRS"] == "DRS A") | (a["PERIODE"] != dt.date(2017, 2, 1))]), "missing months"),
    (lambda p, a: (p, pd.concat([a, a.tail(1)])), "repeated months"),
    (lambda p, a: (p, a.assign(vent=[None] + a["vent"].tolist()[1:])), "missing feature values"),
])
def test_bad_requests_are_named(spark, change, message):
    history, ahead = panel_and_future(spark, change)
    with pytest.raises(Exception, match=message):
        forecast.forecast_by_rule(history, ahead, RULE, SPEC).collect()
    made = forecast.forecast_by_rule(history, ahead, RULE, SPEC, on_problem="mark").collect()
    assert len(made) == ahead.count()  # every request is answered
    marked = {r["DRS"]: r["problem"] for r in made if r["problem"]}
    assert len(marked) == 1 and message in next(iter(marked.values()))
    assert all((r["prediction"] is None) == (r["DRS"] in marked) for r in made)
    found = forecast.problems(forecast.prepare(history, ahead, SPEC), SPEC).collect()
    assert len(found) == 1 and message in found[0]["problem"]


def test_null_target_inside_the_reach_is_an_error_or_marked(spark):
    def change(p, a):
        p = p.copy()
        p.loc[(p["DRS"] == "DRS A") & (p["PERIODE"] == dt.date(2016, 11, 1)), "cas"] = None
        return p, a

    history, ahead = panel_and_future(spark, change)
    with pytest.raises(Exception, match="missing feature values"):
        forecast.forecast_by_rule(history, ahead, RULE, SPEC).collect()
    made = forecast.forecast_by_rule(history, ahead, RULE, SPEC, on_problem="mark").collect()
    assert len(made) == ahead.count()
    assert {r["DRS"] for r in made if r["problem"] == "missing feature values" and r["prediction"] is None} == {"DRS A"}
    assert {r["DRS"] for r in made if r["problem"] is None and r["prediction"] is not None} == {"DRS B"}


def test_forecast_plan_has_no_python_and_no_product(spark):
    history, ahead = panel_and_future(spark)
    plan = forecast.forecast_by_rule(history, ahead, RULE, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_neutral_scenario_equals_base_and_national_is_the_sum(spark):
    history, ahead = panel_and_future(spark)
    base = forecast.forecast_by_rule(history, ahead, RULE, SPEC)
    every = scenarios.apply_adjustments(ahead, [scenarios.Adjustment("same"), scenarios.Adjustment("hot", temp_delta=2)])
    tagged = forecast.forecast_by_rule(history, every, RULE, SPEC, ("scenario",))
    same = tagged.filter("scenario = 'same'").drop("scenario")
    assert same.exceptAll(base).count() == 0 and tagged.count() == 2 * base.count()
    total = base.agg(F.sum("prediction")).first()[0]
    assert forecast.national(base).agg(F.sum("National_Prediction")).first()[0] == pytest.approx(total)


def test_backtest_sees_nothing_after_the_cutoff(spark):
    pdf = long_series(random_panel(11, series=3, n=36, gap=0.0))
    cutoffs = ["2016-06-01", "2017-02-01"]
    got = forecast.backtest(to_spark(spark, pdf), SPEC, cutoffs, 12, rule=RULE).collect()
    # the second cut-off is ten months before the last observation
    assert len(got) == 3 * (12 + 10)
    for cut in cutoffs:
        c = dt.date.fromisoformat(cut)
        known = pdf[pdf["PERIODE"] <= c]
        ahead = pdf[(pdf["PERIODE"] > c) & (pdf["PERIODE"] <= (pd.Timestamp(c) + pd.DateOffset(months=12)).date())]
        want = brute_forecast(known, ahead, WEIGHTS, 1.0)
        mine = {(r["DRS"], r["PERIODE"]): r for r in got if r["cutoff"] == c}
        assert set(mine) == set(want)
        for k, r in mine.items():
            assert r["prevu"] == pytest.approx(want[k], abs=1e-9)
    spoiled = pdf.copy()
    spoiled.loc[spoiled["PERIODE"] > dt.date(2016, 6, 1), "cas"] = 999.0
    again = forecast.backtest(to_spark(spark, spoiled), SPEC, cutoffs[:1], 12, rule=RULE).collect()
    before = {(r["DRS"], r["PERIODE"]): r["prevu"] for r in got if r["cutoff"] == dt.date(2016, 6, 1)}
    assert {(r["DRS"], r["PERIODE"]): r["prevu"] for r in again} == before


def test_backtest_with_a_gap_is_reported_or_marked(spark):
    pdf = long_series(random_panel(11, series=2, n=36, gap=0.0))
    pdf = pdf[(pdf["DRS"] == "DRS B") | (pdf["PERIODE"] != dt.date(2016, 7, 1))]
    panel = to_spark(spark, pdf)
    with pytest.raises(Exception, match="missing months"):
        forecast.backtest(panel, SPEC, ["2016-06-01"], 12, rule=RULE).collect()
    made = forecast.backtest(panel, SPEC, ["2016-06-01"], 12, rule=RULE, on_problem="mark").collect()
    assert len(made) == 24  # the month without a row is asked for as well
    assert {r["problem"] for r in made if r["DRS"] == "DRS A"} == {"missing months"}
    assert all((r["prevu"] is None) == (r["DRS"] == "DRS A") for r in made)
    with pytest.raises(ValueError, match="skip"):
        forecast.backtest(panel, SPEC, ["2016-06-01"], 12, rule=RULE, on_problem="skip")


def test_one_shot_keeps_the_lags_of_the_last_row(spark):
    pdf = long_series(random_panel(1, series=2, n=20, gap=0.0))
    frame = features.create_features(to_spark(spark, pdf), SPEC).na.drop()
    asked = spark.createDataFrame(
        [("DRS A", dt.date(2017, 3, 1)), ("DRS A", dt.date(2016, 5, 1)), ("DRS B", dt.date(2017, 3, 1))], "DRS string, PERIODE date")
    given = spark.createDataFrame([("DRS B", dt.date(2017, 3, 1), 77.0)], "DRS string, PERIODE date, vent double")
    rule = Rule({"target_lag_1": 1.0, "vent": 1.0, "month": 1.0})
    got = {(r["DRS"], r["PERIODE"]): r for r in forecast.one_shot(
        asked, frame, SPEC, lambda rows: rule.on(rows, clamp=False), ["target_lag_1", *W], given).collect()}
    for (key, month), r in got.items():
        mine = pdf[(pdf["DRS"] == key) & (pdf["PERIODE"] < month)].sort_values("PERIODE")
        vent = 77.0 if key == "DRS B" else mine["vent"].iloc[-1]
        assert r["prediction"] == pytest.approx(mine["cas"].iloc[-2] + vent + month.month)
    early = spark.createDataFrame([("DRS A", dt.date(2015, 1, 1))], "DRS string, PERIODE date")
    with pytest.raises(Exception, match="no history before"):
        forecast.one_shot(early, frame, SPEC, lambda rows: rule.on(rows), ["target_lag_1", *W]).collect()


def test_weather_validation(spark):
    pdf = long_series(random_panel(0, series=2, n=6, gap=0.0))
    weather = to_spark(spark, pdf)
    required = weather.select("DRS", "PERIODE")
    assert validate.validate_weather(weather, required, SPEC).count() == 12
    with pytest.raises(ValueError, match="missing columns: vent"):
        validate.validate_weather(weather.drop("vent"), required, SPEC)
    with pytest.raises(ValueError, match="repeated months"):
        validate.validate_weather(weather.unionByName(weather.limit(1)), required, SPEC)
    with pytest.raises(ValueError, match="missing months.*2015-06-01"):
        validate.validate_weather(weather.filter("PERIODE < '2015-06-01'"), required, SPEC)
    with pytest.raises(ValueError, match="missing feature values"):
        validate.require_values(weather.withColumn("vent", F.lit(None).cast("double")), ["vent"])


def test_climatology_future_covers_the_horizon(spark):
    panel = to_spark(spark, long_series(random_panel(0, series=3, n=24, gap=0.0)))
    ahead = futures.future_months(panel, SPEC, futures.after_history(panel, SPEC), 18)
    made = futures.from_climatology(panel, ahead, SPEC)
    assert made.count() == 3 * 18 and made.filter("vent is null").count() == 0


def test_repeated_months_of_history_are_a_problem(spark):
    history, ahead = panel_and_future(spark)
    twice = history.unionByName(history.filter("DRS = 'DRS A'").limit(1))
    with pytest.raises(Exception, match="repeated months of history"):
        forecast.forecast_by_rule(twice, ahead, RULE, SPEC).collect()
    made = forecast.forecast_by_rule(twice, ahead, RULE, SPEC, on_problem="mark").collect()
    assert {r["DRS"] for r in made if r["problem"]} == {"DRS A"}
