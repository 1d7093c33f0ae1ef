"""Features, windows, futures and scenarios against plain pandas."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from monthloom.operators import aggregate, evaluate, features, futures, joins, learn, scenarios, split, windows
from monthloom.spec import PanelSpec
from tests.panels import SPEC, W, months, pandas_features, random_panel, to_spark


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.mark.parametrize("seed,nulls", [(0, 0.0), (1, 0.15)])
def test_features_match_pandas(spark, seed, nulls):
    pdf = random_panel(seed, null_target=nulls)
    got = rows(features.create_features(to_spark(spark, pdf), SPEC), "DRS", "PERIODE")
    want = pandas_features(pdf)
    assert len(got) == len(want)
    for _, w in want.iterrows():
        r = got[(w["DRS"], w["PERIODE"])]
        for c in [*features.lag_names(SPEC), *features.roll_names(SPEC)]:
            assert (r[c] is None) == bool(pd.isna(w[c])), c
            if r[c] is not None:
                assert r[c] == pytest.approx(w[c])
        assert r["month_sin"] == pytest.approx(math.sin(2 * math.pi * w["PERIODE"].month / 12), abs=1e-12)


def test_partial_means_skip_nulls_before_the_tail(spark):
    pdf = random_panel(3, null_target=0.3)
    got = rows(windows.with_partial_rolling_means(to_spark(spark, pdf), SPEC, "m_"), "DRS", "PERIODE")
    for _, g in pdf.sort_values("PERIODE").groupby("DRS"):
        past = []
        for _, r in g.iterrows():
            for n in SPEC.rolls:
                tail = past[-n:]
                want = sum(tail) / len(tail) if tail else 0.0
                assert got[(r["DRS"], r["PERIODE"])][f"m_{n}"] == pytest.approx(want)
            if not pd.isna(r["cas"]):
                past.append(r["cas"])


def test_calendar_lag_is_null_at_a_gap(spark):
    pdf = random_panel(0, series=1, n=6, gap=0.0)
    pdf = pdf[(pdf["DRS"] == "DRS A") & (pdf["PERIODE"] != dt.date(2015, 3, 1))]
    spec = SPEC.having(lags=(1,))
    by_row = rows(windows.with_lags(to_spark(spark, pdf), spec), "PERIODE")
    by_month = rows(windows.with_calendar_lags(to_spark(spark, pdf), spec), "PERIODE")
    april = (dt.date(2015, 4, 1),)
    assert by_row[april]["cas_lag_1"] is not None and by_month[april]["cas_lag_1"] is None


def test_features_need_one_exchange_and_no_python(spark, tmp_path):
    path = str(tmp_path / "panel")
    to_spark(spark, random_panel()).write.parquet(path)
    plan = features.create_features(spark.read.parquet(path), SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Window ") == 1
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_persistence_wraps_around(spark):
    pdf = random_panel(5, series=2, n=30, gap=0.05)
    panel = to_spark(spark, pdf)
    got = rows(futures.by_persistence(panel, SPEC, futures.after_history(panel, SPEC), 14), "DRS", "PERIODE")
    last = pdf["PERIODE"].max()
    ahead = months(pd.Timestamp(last) + pd.DateOffset(months=1), 14)
    for key, g in pdf.sort_values("PERIODE").groupby("DRS"):
        tail = g.tail(12)
        for i, m in enumerate(ahead):
            assert got[(key, m)]["vent"] == tail.iloc[i % len(tail)]["vent"]


def test_persistence_of_twelve_is_the_last_year(spark):
    panel = to_spark(spark, random_panel(2, series=2, n=24, gap=0.0)).filter("DRS <> 'DRS Z'")
    made = futures.by_persistence(panel, SPEC, futures.after_history(panel, SPEC), 12)
    shifted = panel.filter("PERIODE >= '2016-01-01'").withColumn("PERIODE", F.add_months("PERIODE", 12)).drop("cas")
    assert made.exceptAll(shifted.select(made.columns)).count() == 0


def test_reference_year_with_absent_month_is_an_error(spark):
    pdf = random_panel(0, series=2, n=24, gap=0.0)
    pdf = pdf[pdf["PERIODE"] != dt.date(2015, 5, 1)]
    panel = to_spark(spark, pdf)
    ahead = futures.future_months(panel, SPEC, futures.after_history(panel, SPEC), 12)
    with pytest.raises(ValueError, match="months without a source row"):
        futures.from_year(panel, ahead, SPEC, 2015)


def test_scenario_bounds_and_neutral(spark):
    pdf = random_panel(1, series=1, n=3, gap=0.0)
    pdf["humidite"] = 99.0
    panel = to_spark(spark, pdf)
    wet = scenarios.Adjustment("wet", precip_pct=-100, humid_delta=5, temp_delta=1.5, wind_pct=-150)
    got = scenarios.apply_adjustments(panel, [wet, scenarios.Adjustment("none")])
    for r in got.filter("scenario = 'wet'").collect():
        assert r["humidite"] == 100.0 and r["precipitation"] == 0.0 and r["vent"] == 0.0
    same = got.filter("scenario = 'none'").drop("scenario")
    assert same.exceptAll(panel.select(same.columns)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("share,size", [(0.8, 37), (0.5, 10), (0.8, 1)])
def test_row_split_takes_exactly_the_share(spark, share, size):
    pdf = random_panel(4, series=size, n=7, gap=0.3)
    marked = split.row_split(to_spark(spark, pdf), SPEC, share).collect()
    train = [r for r in marked if r["part"] == "train"]
    test = [r for r in marked if r["part"] == "test"]
    assert len(train) == int(len(pdf) * share) and len(train) + len(test) == len(pdf)
    if train and test:
        assert max(r["PERIODE"] for r in train) <= min(r["PERIODE"] for r in test)


def test_period_split_and_folds(spark):
    pdf = random_panel(0, series=3, n=29, gap=0.0)
    panel = to_spark(spark, pdf)
    held = {r["PERIODE"] for r in split.period_split(panel, SPEC).filter("part = 'test'").collect()}
    assert held == set(months("2015-01-01", 29)[-5:])
    marked = split.expanding_folds(panel, SPEC)
    fold = {r["PERIODE"]: r["fold"] for r in marked.collect()}
    ordered = [fold[m] for m in months("2015-01-01", 29)]
    assert ordered == [None] * 9 + [i for i in range(5) for _ in range(4)]
    for i in range(5):
        train, valid = split.fold_parts(marked, i)
        assert train.agg(F.max("PERIODE")).first()[0] < valid.agg(F.min("PERIODE")).first()[0]


def test_arg_max_prefers_the_first_key(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 1.0)], "k string, v double")
    assert tuple(aggregate.arg_max(df, "k", "v").first()) == ("a", 2.0)


def test_panel_build_drops_null_keys_and_sums_nulls_to_zero(spark):
    df = spark.createDataFrame(
        [("x", dt.date(2020, 1, 1), None, 1.0), (None, dt.date(2020, 1, 1), 4.0, 1.0)],
        "DRS string, PERIODE date, cas double, vent double")
    got = aggregate.build_panel(df, SPEC).collect()
    assert [tuple(r) for r in got] == [("x", dt.date(2020, 1, 1), 0.0, 1.0)]


def test_threshold_of_a_single_row_is_null(spark):
    got = rows(evaluate.alert_thresholds(to_spark(spark, random_panel()), SPEC), "DRS")
    assert got[("DRS Z",)]["std"] is None and got[("DRS Z",)]["threshold"] is None
    assert got[("DRS A",)]["threshold"] is not None


def pairs(spark, data):
    return spark.createDataFrame([(float(a), float(b)) for a, b in data], "observe double, prevu double")


def test_metrics_of_a_perfect_forecast(spark):
    df = pairs(spark, [(1, 1), (2, 2), (4, 4)])
    m = evaluate.backtest_metrics(df).first()
    assert (m["mae"], m["rmse"], m["mape"], m["r2"], m["bias"]) == (0, 0, 0, 1, 0)
    assert evaluate.training_metrics(df).first()["accuracy"] == 100


def test_metrics_with_zeros_and_constants(spark):
    zeros = pairs(spark, [(0, 0), (0, 0)])
    b, t = evaluate.backtest_metrics(zeros).first(), evaluate.training_metrics(zeros).first()
    assert b["mape"] is None and b["r2"] is None
    assert t["smape"] == 0 and t["mape"] is None and t["accuracy"] is None and t["r2"] == 1
    one = pairs(spark, [(3, 4)])
    assert evaluate.backtest_metrics(one).first()["r2"] is None
    negative = pairs(spark, [(1, -5), (2, 2)])
    assert evaluate.training_metrics(negative).first()["mae"] == pytest.approx(0.5)
    assert evaluate.floored_metrics(pairs(spark, [(1, 4)])).first()["accuracy"] == pytest.approx(-200)


def test_histogram_counts_every_residual(spark):
    df = pairs(spark, [(i % 17, (i * 7) % 5) for i in range(500)])
    for bins in (10, None):
        got = evaluate.residual_histogram(df, "observe", "prevu", bins)
        assert got.agg(F.sum("n")).first()[0] == 500
    assert evaluate.residual_histogram(pairs(spark, [(2, 1)] * 4), "observe", "prevu").collect()[0]["n"] == 4


def test_strict_lookup_fails_on_an_unknown_key(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    table = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(Exception, match="no entry for k b"):
        joins.strict_lookup(df, table, "k").collect()


def test_asof_is_strict_and_bounded(spark):
    seen = spark.createDataFrame(
        [("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 3, 1), 3.0)], "s string, m date, v double")
    ask = spark.createDataFrame(
        [("a", dt.date(2020, i, 1)) for i in (1, 2, 3, 4)] * 3 + [("b", dt.date(2020, 1, 1))], "s string, m date")
    got = joins.asof_before(ask, seen, ["s"], "m", ["v"]).collect()
    assert len(got) == 13
    once = joins.asof_before(ask.distinct(), seen, ["s"], "m", ["v"], unique=True).collect()
    assert {tuple(r) for r in once} == {tuple(r) for r in got} and len(once) == 5
    assert {(r["s"], r["m"].month, r["v"]) for r in got} == {
        ("a", 1, None), ("a", 2, 1.0), ("a", 3, 1.0), ("a", 4, 3.0), ("b", 1, None)}


def test_pivot_of_too_many_keys_is_an_error(spark):
    df = spark.range(30).select(F.col("id").alias("k"))
    with pytest.raises(ValueError, match="more than 10"):
        aggregate.distinct_values(df, F.col("k"), 10)


def test_long_forms_take_new_years_regions_and_values(spark):
    rows = [(f"R{k}", dt.date(y, m, 1), float(k * y + m)) for k in range(30) for y in (1999, 2010, 2055) for m in (1, 2)]
    panel = spark.createDataFrame(rows, "DRS string, PERIODE date, cas double")
    totals = aggregate.year_totals_by_series(panel, SPEC).collect()
    assert len(totals) == 90 and {r["year"] for r in totals} == {1999, 2010, 2055}
    assert [r["DRS"] for r in sorted(totals, key=lambda r: r["place"])][::3] == [f"R{k}" for k in range(29, -1, -1)]
    means = aggregate.means_by_month_and_series(panel, "PERIODE", "DRS", "cas").collect()
    assert len(means) == 180
    january = [r for r in means if r["PERIODE"] == dt.date(1999, 1, 1)]
    assert {r["total"] for r in january} == {sum(r["mean"] for r in january)}
    values = spark.createDataFrame([(k, f"v{k % 7}" if k else None) for k in range(50)], "id int, kind string")
    assert {r["indicator"] for r in learn.set_indicators(values, "kind", "is_").collect()} == {f"is_v{k}" for k in range(7)}


@pytest.mark.parametrize("parts", [1, 5])
def test_positions_are_the_total_order(spark, parts):
    df = spark.createDataFrame([(k * 37 % 101, k) for k in range(101)], "a int, b int").repartition(parts)
    placed = windows.with_positions(df, F.col("a").desc()).collect()
    assert sorted((r["position"], r["a"]) for r in placed) == [(k + 1, 100 - k) for k in range(101)]
    assert windows.with_positions(df.limit(0), "a").count() == 0
