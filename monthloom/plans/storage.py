"""Checks of sources and sinks: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthloom.functions import calendar as cal
from monthloom.functions import fixed
from monthloom.operators import features, forecast, futures, learn
from monthloom.operators.clean import insert_before
from monthloom.plans import tables as t
from monthloom.plans.combining import FITTED, _fitted, fitted_rows
from monthloom.plans.learning import NUMERIC, QUICK_ROBUST
from monthloom.plans.registry import query
from monthloom.plans.rules import RULE
from monthloom.plans.sql import AHEAD, CLIMATOLOGY, MONTHS_FR, W, WCOLS, WEDGE, cols, recursion
from monthloom.session import scratch_dir, written
from monthloom.sources import readers, registry, writers
from monthloom.spec import DISTRICT, REGION

WEATHER_FILE = DISTRICT.having(series=("DISTRICT",))


@query("S1", f"DRS DISTRICT PERIODE {WEDGE}",
       f"SELECT DRS, DISTRICT, ({MONTHS_FR})[month(PERIODE)] || ' ' || year(PERIODE) AS PERIODE, {WCOLS} FROM weather")
def weather_file(spark, d):
    path = scratch_dir(spark, "weather")
    texts = t.weather(spark, d).withColumn("PERIODE", cal.french_month_text("PERIODE"))
    writers.save_csv(texts.select("DRS", "DISTRICT", "PERIODE", *W), path)
    return readers.read_csv(spark, path, readers.weather_schema(REGION))


@query("S2", "DRS DISTRICT d:PERIODE r:cas r:tpi2", "SELECT * FROM surv")
def surveillance_table(spark, d):
    return readers.read_table(spark, writers.save_table(t.surveillance(spark, d), scratch_dir(spark, "surveillance")))


@query("S3", f"DISTRICT d:PERIODE {WEDGE}", "SELECT * FROM weather")
def tolerant_import(spark, d):
    """Semicolons, padded header names, days inside the month."""
    path = scratch_dir(spark, "import")
    weather = t.weather(spark, d).select("DISTRICT", F.date_add("PERIODE", 14).alias("PERIODE"), *W)
    writers.save_csv(weather.toDF(*[f" {c}  " for c in weather.columns]), path, ";")
    return readers.read_weather_import(spark, path, WEATHER_FILE)


@query("S4", "region departement r:latitude r:longitude adresse",
       "SELECT n_name AS region, c_name AS departement, CAST(c_custkey AS DOUBLE) AS latitude, c_acctbal AS longitude, "
       "c_mktsegment || ', ' || n_name || ', \"' || c_name || '\"' AS adresse FROM customer JOIN nation ON c_nationkey = n_nationkey",
       base=False)
def geo_points(spark, d):
    """Every part starts with a byte-order mark; addresses hold commas and quotes."""
    path = scratch_dir(spark, "points")
    nation, customer = t.table(spark, d, "nation"), t.table(spark, d, "customer")
    points = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("\ufeffregion"), F.col("c_name").alias("departement"),
        F.col("c_custkey").cast("double").alias("latitude"), F.col("c_acctbal").alias("longitude"),
        F.concat("c_mktsegment", F.lit(", "), "n_name", F.lit(', "'), "c_name", F.lit('"')).alias("adresse"))
    return readers.read_geo_points(spark, writers.save_csv(points, path))


@query("S5", "DRS d:PERIODE r:cas", "SELECT DRS, PERIODE, cas FROM panel")
def stored_history(spark, d):
    panel = t.panel(spark, d).withColumn("PERIODE", F.col("PERIODE").cast("string"))
    return readers.load_history(spark, writers.save_table(panel, scratch_dir(spark, "history")), REGION)


@query("S6_robust", "DRS d:PERIODE r:prediction problem")
def stored_model(spark, d):
    """Save a fitted pipeline with features and history, load it, forecast with it."""
    panel = t.panel_once(spark, d)
    frame = features.complete_rows(features.create_features(panel, REGION), features.feature_names(REGION))
    path = registry.save_model(
        spark, scratch_dir(spark, "model"), learn.fit(frame, REGION, NUMERIC, *QUICK_ROBUST), NUMERIC, panel)
    stored = registry.load_model(spark, path)
    weather = futures.by_persistence(stored.history, REGION, futures.after_history(stored.history, REGION), 6)
    return forecast.forecast_by_model(stored.history, weather, stored.model, REGION, on_problem="mark")


@query("S7", "DRS PERIODE r:prediction",
       "SELECT DRS, strftime(PERIODE, '%Y-%m-%d') AS PERIODE, prediction FROM fitted", ctes=FITTED)
def forecast_file(spark, d):
    path = writers.save_forecast(_fitted(spark, d).select("DRS", "PERIODE", "prediction"), scratch_dir(spark, "forecast"))
    schema = T.StructType([T.StructField("DRS", T.StringType()), T.StructField("PERIODE", T.StringType()),
                           T.StructField("prediction", T.DoubleType())])
    return readers.read_csv(spark, path, schema)


@query("S8", "bucket DISTRICT d:PERIODE r:vent",
       "SELECT CASE WHEN year(PERIODE) <= 1999 THEN 'train' WHEN year(PERIODE) <= 2000 THEN 'test' ELSE 'remainder' END "
       "AS bucket, DISTRICT, PERIODE, vent FROM weather")
def year_buckets(spark, d):
    path = writers.save_by_bucket(t.weather(spark, d), scratch_dir(spark, "buckets"), "PERIODE", 1999, 2000)
    return readers.read_table(spark, path)


@query("S9", f"DRS DISTRICT d:PERIODE r:cas {WEDGE} r:tpi2", "SELECT * FROM merged")
def wide_table(spark, d):
    wide = insert_before(t.merged(spark, d), list(W), "tpi2")
    return readers.read_table(spark, writers.save_table(wide, scratch_dir(spark, "wide")))


@query("S10", "source DRS PERIODE r:prediction r:precipitation",
       """SELECT 'previsions' AS source, DRS, strftime(PERIODE, '%Y-%m-%d') AS PERIODE, round_even(prediction, 1) AS prediction,
            CAST(NULL AS DOUBLE) AS precipitation FROM fitted
          UNION ALL SELECT 'meteo_utilisee', DRS, strftime(PERIODE, '%Y-%m-%d'), CAST(NULL AS DOUBLE), precipitation FROM panel""", ctes=FITTED)
def named_exports(spark, d):
    """Forecast and weather used, one folder per name."""
    panel = t.panel_once(spark, d)
    made = writers.forecast_export(fitted_rows(panel), REGION)
    used = writers.weather_export(panel, REGION)
    paths = writers.export_tables({"previsions": made, "meteo_utilisee": used}, scratch_dir(spark, "export"), "parquet")
    parts = [
        readers.read_table(spark, p).withColumn("source", F.lit(name)) for name, p in paths.items()
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


_RUNS = """
runs AS (
  SELECT DRS AS district, 'seasonal_naive' AS algorithm, sqrt(avg((cas - target_lag_12) * (cas - target_lag_12))) AS rmse,
    count(*) AS training_rows FROM fitted GROUP BY DRS
  UNION ALL
  SELECT DRS, 'rolling_mean', sqrt(avg((cas - target_roll_mean_6) * (cas - target_roll_mean_6))), count(*) FROM fitted GROUP BY DRS
  UNION ALL
  SELECT DRS, 'rule', sqrt(avg((cas - prediction) * (cas - prediction))), count(*) FROM fitted GROUP BY DRS)"""


def _runs(spark, d):
    """Error of three simple forecasts per region, as runs to record."""
    rows = _fitted(spark, d)
    guess = {"seasonal_naive": "target_lag_12", "rolling_mean": "target_roll_mean_6", "rule": "prediction"}
    errors = rows.groupBy("DRS").agg(
        F.count(F.lit(1)).alias("training_rows"),
        *[F.sqrt(F.avg((F.col("cas") - F.col(c)) * (F.col("cas") - F.col(c)))).alias(a) for a, c in guess.items()])
    entries = F.array(*[F.struct(F.lit(a).alias("algorithm"), F.col(a).alias("rmse")) for a in guess])
    return errors.select(F.col("DRS").alias("district"), "training_rows", F.inline(entries)).withColumns({
        "version": F.lit("1.0.0"),
        "best_params": F.create_map(F.lit("window"), F.lit("12")),
        "features": F.array(F.lit("target_lag_12"), F.lit("target_roll_mean_6")),
    })


@query("S11", "district algorithm r:rmse i:training_rows version", "SELECT *, '1.0.0' AS version FROM "
       "(SELECT district, algorithm, round_even(rmse, 4) AS rmse, training_rows FROM runs)", ctes=FITTED + "," + _RUNS)
def appended_runs(spark, d):
    """Two appends to one folder; the reader sees both."""
    path = scratch_dir(spark, "runs")
    runs = written(_runs(spark, d), "runs")
    registry.append_runs(runs.filter("algorithm = 'rule'"), path)
    registry.append_runs(runs.filter("algorithm <> 'rule'"), path)
    return registry.read_runs(spark, path)


@query("S12", "district algorithm r:rmse i:training_rows version",
       "SELECT 'national' AS district, algorithm, round_even(avg(rmse), 4) AS rmse, sum(training_rows) AS training_rows, "
       "'1.0.0' AS version FROM runs GROUP BY algorithm", ctes=FITTED + "," + _RUNS)
def batch_of_runs(spark, d):
    """One batch written as a whole, from the three national averages."""
    path = scratch_dir(spark, "batch")
    means = _runs(spark, d).groupBy("algorithm").agg(F.avg("rmse"), F.sum("training_rows")).orderBy("algorithm").collect()
    registry.write_batch(spark, path, [
        registry.run_row("national", a, r, n, "1.0.0", {"window": 12}, ["target_lag_12"]) for a, r, n in means])
    return registry.read_runs(spark, path)


@query("S13", "district algorithm r:rmse i:training_rows",
       "SELECT district, algorithm, round_even(rmse, 4) AS rmse, training_rows FROM runs "
       "QUALIFY row_number() OVER (PARTITION BY district ORDER BY round_even(rmse, 4), algorithm) = 1", ctes=FITTED + "," + _RUNS)
def best_runs(spark, d):
    """Objects and arrays of objects in one registry, best run per region."""
    lines, arrays = scratch_dir(spark, "runs"), scratch_dir(spark, "arrays")
    runs = written(_runs(spark, d), "runs")
    registry.append_runs(runs.filter("algorithm = 'rule'"), lines)
    # one text file per region, holding an array of objects
    rest = runs.filter("algorithm <> 'rule'").withColumn("rmse", F.bround("rmse", 4))
    rest.groupBy("district").agg(
        F.to_json(F.collect_list(F.struct("district", "algorithm", "rmse", "training_rows", "version", "best_params"))).alias("value")
    ).withColumn("file", F.col("district")).select("value", "file").write.partitionBy("file").text(arrays)
    found = registry.read_runs(spark, lines).unionByName(
        registry.read_run_documents(spark, arrays).select(*registry.RUN_SCHEMA.fieldNames()))
    return registry.best_runs(found)


_LABELS = fixed.WEATHER_LABELS | {"cas": fixed.TARGET_LABEL}


@query("S14", "DRS|PERIODE|" + "|".join(f"r:{v}" for v in _LABELS.values()),
       "SELECT DRS, strftime(PERIODE, '%Y-%m') AS PERIODE, " + ", ".join(f'{k} AS "{v}"' for k, v in _LABELS.items()) + " FROM panel")
def labelled_export(spark, d):
    labelled = writers.labelled_history(t.panel(spark, d), REGION)
    path = writers.save_csv(labelled, scratch_dir(spark, "labelled"))
    schema = T.StructType([T.StructField(c, T.StringType() if c in ("DRS", "PERIODE") else T.DoubleType()) for c in labelled.columns])
    return readers.read_csv(spark, path, schema)


@query("T9", "DRS d:PERIODE r:prediction problem", "SELECT * FROM answered",
       ctes=AHEAD + ",\n" + CLIMATOLOGY + f""",
future AS (SELECT a.DRS, a.PERIODE, a.h, {cols('c')} FROM ahead a
  LEFT JOIN clim c ON c.DRS = a.DRS AND c.month = month(a.PERIODE)),""" + recursion("future"))
def forecast_with_imported_weather(spark, d):
    """Weather template written, imported again and used for a forecast."""
    panel = t.panel_once(spark, d)
    months = futures.future_months(panel, REGION, futures.after_history(panel, REGION), 12)
    template = writers.weather_export(futures.from_climatology(panel, months, REGION), REGION)
    path = writers.save_csv(template, scratch_dir(spark, "template"), "\t")
    return forecast.forecast_by_rule(panel, readers.read_weather_import(spark, path, REGION), RULE, REGION, on_problem="mark")
