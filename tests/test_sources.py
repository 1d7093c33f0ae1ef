"""Files, model folders and the run registry."""

import json
import os

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from monthloom.functions import calendar as cal
from monthloom.functions import text
from monthloom.functions.fixed import MONTHS_EN, MONTHS_FR
from monthloom.operators import clean, features, learn, split
from monthloom.operators.forecast import forecast_by_model
from monthloom.session import checkpoint_root
from monthloom.sources import readers, registry, writers
from tests.panels import SPEC, W, months, random_panel, to_spark


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_import_of_any_delimiter(spark, tmp_path, sep):
    path = tmp_path / "w.csv"
    header = sep.join(f" {c} " for c in ["DRS", "PERIODE", *W])
    lines = [sep.join(["DRS A", "2020-02-17", *["1.5"] * 7]), sep.join(["DRS B", "2020-01-03", *["2.5"] * 7])]
    path.write_text("\n".join([header, *lines]) + "\n")
    got = readers.read_weather_import(spark, str(path), SPEC).collect()
    assert [(r["DRS"], r["PERIODE"].isoformat(), r["vent"]) for r in got] == [
        ("DRS A", "2020-02-01", 1.5), ("DRS B", "2020-01-01", 2.5)]
    only = readers.read_weather_import(spark, str(path), SPEC, "DRS B").collect()
    assert [r["DRS"] for r in only] == ["DRS B"]


def test_import_names_missing_columns(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("PERIODE;vent\n2020-01-01;1\n")
    with pytest.raises(ValueError, match="temperature_moyenne"):
        readers.read_weather_import(spark, str(path), SPEC)
    path.write_text("MOIS;vent\n2020-01-01;1\n")
    with pytest.raises(ValueError, match="PERIODE"):
        readers.read_weather_import(spark, str(path), SPEC)


def test_geo_points_with_mark_commas_and_breaks(spark, tmp_path):
    path = tmp_path / "points.csv"
    path.write_bytes(("\ufeffregion,departement,latitude,longitude,adresse\n"
                      'Dakar,Dakar Nord,14.7,-17.4,"Rue 1, Dakar"\nThies,Mbour,14.4,-16.9,"Route\nde Mbour, ""B"""\n').encode())
    got = readers.read_geo_points(spark, str(path)).orderBy("region").collect()
    assert [r["region"] for r in got] == ["Dakar", "Thies"]
    assert got[0]["adresse"] == "Rue 1, Dakar" and got[1]["adresse"] == 'Route\nde Mbour, "B"'


def test_history_is_clustered_by_series(spark, tmp_path):
    path = str(tmp_path / "h")
    writers.save_table(to_spark(spark, random_panel()), path)
    history = readers.load_history(spark, path, SPEC)
    plan = features.create_features(history, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    with pytest.raises(ValueError, match="missing columns: absent"):
        readers.load_history(spark, path, SPEC.having(target="absent"))


def test_buckets_prune_to_one_folder(spark, tmp_path):
    path = writers.save_by_bucket(to_spark(spark, random_panel()), str(tmp_path / "b"), "PERIODE", 2016, 2017)
    read = spark.read.parquet(path).filter("bucket = 'test'")
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().executedPlan().toString()
    assert {r[0] for r in read.select(F.year("PERIODE")).distinct().collect()} == {2017}


def test_export_names_are_cut(spark, tmp_path):
    df = to_spark(spark, random_panel(series=1, n=2))
    long = "a" * 40
    paths = writers.export_tables({long: df, "b": df}, str(tmp_path))
    assert paths[long].endswith("/" + "a" * 31)
    with pytest.raises(ValueError):
        writers.export_tables({long: df, long + "b": df}, str(tmp_path))


def test_registry_unifies_documents_and_lines(spark, tmp_path):
    docs, lines = tmp_path / "docs", str(tmp_path / "lines")
    docs.mkdir()
    (docs / "a.json").write_text(json.dumps(
        [{"district": "x", "algorithm": "forest", "accuracy": 84.2, "training_rows": 28, "best_params": {"max_depth": 5}, "features": ["lag_1"]},
         {"district": "y", "algorithm": "forest", "accuracy": 90.1, "training_rows": 28}], indent=4))
    (docs / "b.json").write_text(json.dumps({"district": "x", "algorithm": "boosting", "rmse": 78.66729, "best_params": {"rate": 0.03}}, indent=4))
    registry.append_run(spark, lines, "x", "line", 70.123456, 378, "1.0.0", {"c": 100}, ["a", "b"])
    registry.append_run(spark, lines, "z", "line", 1.0, 5, "1.0.0", {}, [])
    runs = registry.read_run_documents(spark, str(docs)).unionByName(registry.read_runs(spark, lines))
    assert runs.count() == 5
    best = {r["district"]: r for r in registry.best_runs(runs).collect()}
    assert best["x"]["rmse"] == 70.1235 and best["x"]["best_params"] == {"c": "100"}
    assert best["y"]["accuracy"] == 90.1 and best["z"]["algorithm"] == "line"


def test_missing_model_part_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="features"):
        registry.load_model(spark, str(tmp_path / "none"))


def test_checkpoint_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert checkpoint_root(spark) == (named or spark.sparkContext.getCheckpointDir())


# -------------------------------------------------------------------- functions


def test_french_months_round_trip(spark):
    rows = [(m.isoformat(), f"{fr} {m.year}", f"{en} {m.year}") for m, fr, en in zip(months("2021-01-01", 12), MONTHS_FR, MONTHS_EN)]
    df = spark.createDataFrame(rows, "d string, fr string, en string")
    got = df.select(
        "*", cal.parse_french_month("fr").cast("string").alias("a"), cal.english_month_text("fr").alias("b"),
        cal.parse_english_month("en").cast("string").alias("c")).collect()
    assert all(r["a"] == r["d"] and r["b"] == r["en"] and r["c"] == r["d"] for r in got)
    shuffled = df.select(F.col("fr").alias("PERIODE")).orderBy("PERIODE")
    assert [r[0] for r in clean.sort_by_french_month(shuffled).collect()] == [r[1] for r in rows]


@pytest.mark.parametrize("value,want", [
    ("1234567.5", "1 234 568"), ("2.5", "2"), ("-0.2", "0"), ("-1234.0", "-1 234"), (None, "—"), ("x", "—"), ("NaN", "—")])
def test_grouped_integer(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(text.grouped_integer("v")).first()[0] == want


# --------------------------------------------------------------------- learning


@pytest.fixture(scope="module")
def trained(spark):
    pdf = random_panel(21, series=4, n=48, gap=0.0)
    # a seasonal level per series, which the models can find
    pdf["cas"] = [
        20.0 * (ord(k[-1]) - 64) + 10 * (p.month in (8, 9, 10)) + (i % 3) for i, (k, p) in enumerate(zip(pdf["DRS"], pdf["PERIODE"]))
    ]
    panel = to_spark(spark, pdf[pdf["DRS"] != "DRS Z"]).cache()
    names = features.feature_names(SPEC)
    frame = features.complete_rows(features.create_features(split.period_split(panel, SPEC), SPEC), names).cache()
    model = learn.fit(frame.filter("part = 'train'"), SPEC, names[1:], learn.STAGED, {"maxIter": 5, "maxDepth": 3})
    return panel, frame, names[1:], model


def test_unknown_key_is_all_zeros(spark, trained):
    _, frame, numeric, model = trained
    odd = frame.limit(1).withColumn("DRS", F.lit("never seen"))
    vector = model.transform(odd).first()["DRS_flags"]
    assert vector.size == 4 and vector.numNonzeros() == 0


def test_comparison_skips_what_fails(spark, trained):
    _, frame, numeric, _ = trained
    train, test = frame.filter("part = 'train'"), frame.filter("part = 'test'")
    broken = learn.Learner("broken", lambda p: learn.GBTRegressor(featuresCol="absent", labelCol="label"))
    results, models = learn.compare(train, test, SPEC, numeric, [(learn.FOREST, {"numTrees": 10, "maxDepth": 5}), (broken, {})])
    rows = {r["model"]: r for r in results.collect()}
    assert rows["broken"]["error"] and rows["broken"]["rmse"] is None and set(models) == {"forest"}
    assert learn.best_model(results).first()["model"] == "forest"
    assert rows["forest"]["rmse"] < 20
    with pytest.raises(RuntimeError, match="no learner worked"):
        learn.compare(train, test, SPEC, numeric, [(broken, {})])


def test_model_steps_equal_one_by_one_prediction(spark, trained):
    """Each step equals the model applied to features of the grown history."""
    panel, _, _, model = trained
    start = "2018-01-01"
    ahead = panel.filter((F.col("PERIODE") >= start) & (F.col("PERIODE") < "2018-09-01")).drop("cas")
    history = panel.filter(F.col("PERIODE") < start)
    got = {(r["DRS"], r["PERIODE"]): r["prediction"] for r in forecast_by_model(history, ahead, model, SPEC, 8).collect()}
    known = history
    for m in months(start, 8):
        row = ahead.filter(F.col("PERIODE") == F.lit(m)).withColumn("cas", F.lit(None).cast("double"))
        frame = features.create_features(known.unionByName(row), SPEC).filter(F.col("PERIODE") == F.lit(m))
        made = model.transform(frame).select("DRS", "PERIODE", F.greatest(F.lit(0.0), "prediction").alias("cas"), *W).collect()
        for r in made:
            assert got[(r["DRS"], m)] == pytest.approx(r["cas"])
        known = known.unionByName(spark.createDataFrame(made, panel.select("DRS", "PERIODE", "cas", *W).schema))


def test_requests_of_unequal_length(spark, trained):
    panel, _, _, model = trained
    ahead = panel.filter("PERIODE >= '2018-01-01'").drop("cas")
    short = ahead.filter("DRS <> 'DRS A' or PERIODE < '2018-03-01'").filter("PERIODE < '2018-05-01'")
    got = forecast_by_model(panel, short, model, SPEC, 6).groupBy("DRS").count().collect()
    assert {r["DRS"]: r["count"] for r in got} == {"DRS A": 2, "DRS B": 4, "DRS C": 4, "DRS D": 4}
    with pytest.raises(Exception, match="more than 3 months"):
        forecast_by_model(panel, short, model, SPEC, 3).collect()


def test_split_counts_match_the_node_count(spark, trained):
    _, frame, _, model = trained
    inner = sum((tree.numNodes - 1) // 2 for tree in model.stages[-1].trees)
    assert sum(r["n"] for r in learn.split_counts(spark, model.stages[-1]).collect()) == inner
    table = learn.importance_table(spark, model, frame)
    assert table.count() == 4 + 18 and learn.top_features(table, 20).count() == 20
    assert learn.family_importance(table).agg(F.sum("importance")).first()[0] == inner
    assert table.filter("feature = 'Région : A'").first()["famille"] == "Région (one-hot)"


def test_random_points_are_seeded_and_distinct():
    a, b = learn.random_points(learn.BOOSTING.space, 80), learn.random_points(learn.BOOSTING.space, 80)
    assert a == b and len({json.dumps(p, sort_keys=True) for p in a}) == 80
    assert len(learn.random_points({"x": [1, 2]}, 10)) == 2
    assert len(learn.grid_points({"x": [1, 2], "y": [3, 4, 5]})) == 6


def test_search_scores_every_point(spark, trained):
    _, frame, numeric, _ = trained
    points = learn.grid_points({"numTrees": [3], "maxDepth": [2, 4]})
    found = learn.search(frame, SPEC, numeric, learn.FOREST, points, n_splits=2)
    assert [r["params"] for r in found] == points and all(r["rmse"] > 0 for r in found)
    assert learn.best_point(found)["rmse"] == min(r["rmse"] for r in found)


def test_store_and_load(spark, tmp_path, trained):
    panel, frame, numeric, model = trained
    path = registry.save_model(spark, str(tmp_path / "m"), model, numeric, panel)
    stored = registry.load_model(spark, path)
    assert isinstance(stored.model, PipelineModel) and stored.features == list(numeric)
    a, b = (m.transform(frame).agg(F.sum("prediction")).first()[0] for m in (model, stored.model))
    assert a == pytest.approx(b) and stored.history.count() == panel.count()


def test_line_as_rule_gives_the_same_predictions(spark, trained):
    _, frame, numeric, _ = trained
    plain = learn.Learner("line", learn.ROBUST.build)
    model = learn.fit(frame, SPEC, numeric, plain, {"regParam": 0.1}, key=None)
    ruled = learn.as_rule(model, frame).on(model.transform(frame), "by_rule", clamp=False)
    assert ruled.filter(F.abs(F.col("by_rule") - F.col("prediction")) > 1e-6).count() == 0


def test_too_many_keys_for_indicators(spark):
    with pytest.raises(ValueError, match="leave the key out"):
        learn.require_few_keys(spark.range(500).withColumn("k", F.col("id").cast("string")), "k", 100)


def test_unreadable_cells_are_named_and_commas_read(spark, tmp_path):
    header = ";".join(["DRS", " PERIODE ", *W])
    good = ";".join(["DRS A", "2025-01-01", *["12,5", "1.5", " 3 ", "", "7", "8", "9"]])
    (tmp_path / "good.csv").write_text(f"{header}\n{good}\n", encoding="utf-8")
    row = readers.read_weather_import(spark, str(tmp_path / "good.csv"), SPEC).first()
    assert [row[w] for w in W] == [12.5, 1.5, 3.0, None, 7.0, 8.0, 9.0]
    (tmp_path / "bad.csv").write_text(f"{header}\n{good.replace('12,5', 'warm')}\n", encoding="utf-8")
    with pytest.raises(Exception, match="unreadable number in temperature_moyenne: warm"):
        readers.read_weather_import(spark, str(tmp_path / "bad.csv"), SPEC).collect()
    texts = spark.createDataFrame([("Janvier 2021",), (None,), ("Brumaire 2021",)], "PERIODE string")
    assert clean.with_parsed_french_months(texts.limit(2)).count() == 2
    with pytest.raises(Exception, match="unreadable month: Brumaire 2021"):
        clean.with_parsed_french_months(texts).collect()


def test_scratch_tables_go_with_their_owner(spark):
    from monthloom.session import scratch, written

    kept = written(spark.range(3).toDF("id"), "kept")
    with scratch(spark):
        inner = written(spark.range(5).toDF("id"), "inner")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and inner.count() == 5
    assert not os.path.exists(path) and kept.count() == 3
