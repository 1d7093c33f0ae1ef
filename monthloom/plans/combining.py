"""Checks of joins, set operations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F



from monthloom.operators import clean, features, futures, joins, scenarios, validate, windows
from monthloom.operators.aggregate import climatology, total_by_month
from monthloom.plans import tables as t
from monthloom.plans.registry import query
from monthloom.plans.rules import RULE
from monthloom.plans.sql import AHEAD, CLIMATOLOGY, FEATURES, W, WCOLS, WEDGE, cols, rule_on_columns
from monthloom.spec import REGION

DRY = scenarios.relative_presets()[2]


def fitted_rows(panel):
    """Rule predictions on the complete feature rows."""
    frame = features.create_features(panel, REGION)
    return RULE.on(features.complete_rows(frame, features.feature_names(REGION)))


def _fitted(spark, d):
    return fitted_rows(t.panel(spark, d))


FITTED = FEATURES + f""",
fitted AS (SELECT *, {rule_on_columns()} AS prediction FROM features
  WHERE target_lag_12 IS NOT NULL AND {' AND '.join(f'{w} IS NOT NULL' for w in W)})"""


@query("J1", f"DRS DISTRICT d:PERIODE r:cas {WEDGE} r:tpi2", "SELECT * FROM merged")
def surveillance_with_weather(spark, d):
    return t.merged(spark, d)


@query("J2", f"DRS d:PERIODE {WEDGE}",
       f"SELECT a.DRS, a.PERIODE, {cols('c')} FROM ahead a LEFT JOIN replay c ON a.DRS = c.DRS AND a.PERIODE = c.PERIODE",
       ctes=AHEAD + f""",
replay AS (SELECT DRS, CAST(PERIODE + INTERVAL 12 MONTH AS DATE) AS PERIODE, {WCOLS} FROM panel)""")
def future_with_weather(spark, d):
    panel = t.panel_once(spark, d)
    months = futures.future_months(panel, REGION, futures.after_history(panel, REGION), 12)
    replay = panel.withColumn("PERIODE", F.add_months("PERIODE", 12)).select("DRS", "PERIODE", *W)
    return joins.left_by_keys(months, replay, ["DRS", "PERIODE"])


@query("J3", "DRS d:PERIODE r:prediction r:observe",
       "SELECT f.DRS, f.PERIODE, f.prediction, p.cas AS observe FROM fitted f JOIN panel p USING (DRS, PERIODE)", ctes=FITTED)
def forecast_and_observed(spark, d):
    panel = t.panel_once(spark, d)
    return joins.join_observed(fitted_rows(panel).select("DRS", "PERIODE", "prediction"), panel, REGION)


def _centroids(spark, d):
    """Stand-in centroids: one coordinate pair per nation."""
    return t.table(spark, d, "nation").select(
        F.concat(F.lit("DRS "), "n_name").alias("DRS"),
        F.col("n_nationkey").cast("double").alias("lat"), (-F.col("n_regionkey")).cast("double").alias("lon"))


CENTROIDS = ("centroids AS (SELECT 'DRS ' || n_name AS DRS, CAST(n_nationkey AS DOUBLE) AS lat, "
             "CAST(-n_regionkey AS DOUBLE) AS lon FROM nation)")


@query("J4", "DRS r:cas r:lat r:lon",
       "SELECT DRS, sum(cas) AS cas, any_value(lat) AS lat, any_value(lon) AS lon FROM panel JOIN centroids USING (DRS) "
       "GROUP BY DRS", ctes=CENTROIDS)
def centroid_lookup(spark, d):
    totals = t.panel(spark, d).groupBy("DRS").agg(F.sum("cas").alias("cas"))
    return joins.strict_lookup(totals, _centroids(spark, d), "DRS")


@query("J5", "i:c_custkey colour",
       "SELECT c_custkey, coalesce(colour, 'blue') AS colour FROM places LEFT JOIN (SELECT 'DRS ' || n_name AS DRS, "
       "lower(r_name) AS colour FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey < 3) USING (DRS)")
def colour_lookup(spark, d):
    nation, region = t.table(spark, d, "nation"), t.table(spark, d, "region")
    colours = nation.filter("n_regionkey < 3").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("DRS "), "n_name").alias("DRS"), F.lower("r_name").alias("colour"))
    return joins.lookup_or(t.places(spark, d), colours, "DRS", "colour", "blue")


@query("J6", "DISTRICT d:PERIODE",
       """SELECT DISTRICT, PERIODE FROM dense ANTI JOIN surv USING (DISTRICT, PERIODE)""",
       ctes="""
dense AS (SELECT DISTRICT, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS PERIODE FROM (
  SELECT DISTINCT DISTRICT, (SELECT min(PERIODE) FROM surv) AS a, (SELECT max(PERIODE) FROM surv) AS b FROM surv))""")
def absent_months(spark, d):
    seen = t.surveillance_once(spark, d)
    ends = seen.agg(F.struct(F.min("PERIODE").alias("a"), F.max("PERIODE").alias("b")).alias("e")).scalar()
    keys = seen.select("DISTRICT").distinct().withColumn("e", ends)
    dense = joins.months_for_series(keys, F.col("e.a"), F.col("e.b"), "PERIODE")
    return validate.missing_months(dense, seen, ["DISTRICT", "PERIODE"])


@query("J7", "DRS d:PERIODE r:cas",
       "SELECT * FROM panel SEMI JOIN (SELECT DRS, PERIODE FROM weather WHERE precipitation > 35) USING (DRS, PERIODE)")
def requested_months(spark, d):
    return joins.only_requested(t.panel(spark, d), t.weather(spark, d).filter("precipitation > 35"), ["DRS", "PERIODE"])


@query("J8", "DISTRICT d:PERIODE d:observed_at r:cas r:tpi2",
       """SELECT w.DISTRICT, w.PERIODE, s.PERIODE AS observed_at, s.cas, s.tpi2
          FROM weather w ASOF LEFT JOIN surv s ON w.DISTRICT = s.DISTRICT AND w.PERIODE > s.PERIODE""")
def latest_before(spark, d):
    asked = t.weather(spark, d).select("DISTRICT", "PERIODE")
    return joins.asof_before(asked, t.surveillance(spark, d), ["DISTRICT"], "PERIODE", ["cas", "tpi2"], unique=True)


@query("J9", "DRS d:PERIODE", "SELECT DRS, PERIODE FROM ahead", ctes=AHEAD)
def series_by_months(spark, d):
    panel = t.panel_once(spark, d)
    return futures.future_months(panel, REGION, futures.after_history(panel, REGION), 12)


@query("J10", "DRS d:PERIODE r:cas r:usual",
       "SELECT p.DRS, p.PERIODE, p.cas, c.precipitation AS usual FROM panel p "
       "LEFT JOIN clim c ON c.DRS = p.DRS AND c.month = month(p.PERIODE)", ctes=CLIMATOLOGY)
def climatology_lookup(spark, d):
    panel = t.panel_once(spark, d)
    usual = climatology(panel, REGION).select("DRS", "month", F.col("precipitation").alias("usual"))
    return joins.by_month_of_year(panel, usual, REGION)


@query("J11", "DRS d:PERIODE r:cas r:then problem",
       "SELECT p.DRS, p.PERIODE, p.cas, y.precipitation AS then, "
       "CASE WHEN y.DRS IS NULL THEN 'no source row for the month' END AS problem FROM panel p LEFT JOIN panel y "
       "ON y.DRS = p.DRS AND month(y.PERIODE) = month(p.PERIODE) AND year(y.PERIODE) = 1998")
def reference_year_lookup(spark, d):
    panel = t.panel_once(spark, d)
    year = panel.filter(F.year("PERIODE") == 1998).select(
        "DRS", F.month("PERIODE").alias("month"), F.col("precipitation").alias("then"))
    return joins.strict_by_month_of_year(panel, year, REGION, on_problem="mark")


@query("J12", "DRS d:PERIODE r:cas r:year_before",
       "SELECT p.DRS, p.PERIODE, p.cas, b.cas AS year_before FROM panel p LEFT JOIN panel b "
       "ON b.DRS = p.DRS AND b.PERIODE = CAST(p.PERIODE - INTERVAL 12 MONTH AS DATE)")
def same_month_year_before(spark, d):
    panel = t.panel_once(spark, d)
    return joins.year_before(panel, panel, REGION)


@query("J13", "DRS d:PERIODE r:gap",
       "SELECT coalesce(s.DRS, w.DRS) AS DRS, coalesce(s.PERIODE, w.PERIODE) AS PERIODE, w.precipitation - s.cas AS gap "
       "FROM (SELECT DRS, PERIODE, sum(cas) AS cas FROM surv GROUP BY ALL) s FULL JOIN "
       "(SELECT DRS, PERIODE, avg(precipitation) AS precipitation FROM weather GROUP BY ALL) w "
       "ON s.DRS = w.DRS AND s.PERIODE = w.PERIODE")
def aligned_difference(spark, d):
    cases = t.surveillance(spark, d).groupBy("DRS", "PERIODE").agg(F.sum("cas").alias("v"))
    rain = t.weather(spark, d).groupBy("DRS", "PERIODE").agg(F.avg("precipitation").alias("v"))
    return joins.difference_by_month(rain, cases, ["DRS", "PERIODE"], "v", "gap")


@query("J14", "d:PERIODE|r:normal|r:hot_dry|r:rainy",
       "SELECT PERIODE, round_even(sum(cas) + 25.0, 0) AS normal, round_even(sum(cas) + 35.0, 0) AS hot_dry, "
       "round_even(sum(cas) + 28.0, 0) AS rainy FROM panel GROUP BY PERIODE")
def scenarios_side_by_side(spark, d):
    nation = total_by_month(t.panel(spark, d), "PERIODE", "cas", "cas")
    every = scenarios.apply_absolute(nation, REGION.having(series=("cas",)), scenarios.absolute_presets())
    made = every.withColumn("prediction", F.col("cas") + F.col("temperature_moyenne"))
    return scenarios.scenario_columns(made, ["PERIODE"], ["normal", "hot_dry", "rainy"])


@query("J15", "DRS d:PERIODE r:prediction r:observe",
       """SELECT f.DRS, f.PERIODE, f.prediction, p.cas AS observe
          FROM (SELECT DRS, CAST(PERIODE + INTERVAL 6 MONTH AS DATE) AS PERIODE, prediction FROM fitted) f
          LEFT JOIN panel p USING (DRS, PERIODE)""", ctes=FITTED)
def observed_overlay(spark, d):
    panel = t.panel_once(spark, d)
    made = fitted_rows(panel).select("DRS", F.add_months("PERIODE", 6).alias("PERIODE"), "prediction")
    return joins.join_observed(made, panel, REGION, "left")


# -------------------------------------------------------------- set operations


@query("U1", "DRS d:PERIODE r:cas r:precipitation",
       "SELECT DRS, PERIODE, cas, precipitation FROM panel UNION ALL SELECT a.DRS, a.PERIODE, NULL, c.precipitation "
       "FROM ahead a JOIN clim c ON c.DRS = a.DRS AND c.month = month(a.PERIODE)", ctes=AHEAD + ",\n" + CLIMATOLOGY)
def history_and_future(spark, d):
    panel = t.panel_once(spark, d)
    months = futures.future_months(panel, REGION, futures.after_history(panel, REGION), 12)
    return panel.unionByName(futures.from_climatology(panel, months, REGION), allowMissingColumns=True)


@query("U2", "series d:PERIODE r:cas",
       "SELECT DRS AS series, PERIODE, cas FROM panel UNION ALL SELECT DISTRICT, PERIODE, cas FROM surv")
def tagged_by_series(spark, d):
    regions = t.panel(spark, d).select(F.col("DRS").alias("series"), "PERIODE", "cas")
    return regions.unionByName(t.surveillance(spark, d).select(F.col("DISTRICT").alias("series"), "PERIODE", "cas"))


@query("U3", f"scenario DRS d:PERIODE {WEDGE}",
       f"""SELECT 'Base' AS scenario, DRS, PERIODE, {WCOLS} FROM panel UNION ALL
           SELECT '{DRY.name}', DRS, PERIODE, temperature_moyenne + 1, temperature_max + 1, temperature_min + 1,
             CASE WHEN precipitation IS NOT NULL THEN greatest(0, precipitation * (1 + -30.0 / 100)) END,
             CASE WHEN humidite IS NOT NULL THEN least(greatest(humidite - 5, 0), 100) END,
             vent, rayonnement_solaire FROM panel""")
def tagged_by_scenario(spark, d):
    return scenarios.apply_adjustments(t.panel(spark, d), [scenarios.Adjustment("Base"), DRY])


# ------------------------------------------------------------- sorts and limits


@query("O1", "DRS d:PERIODE r:cas i:position",
       "SELECT DRS, PERIODE, cas, row_number() OVER (ORDER BY DRS, PERIODE) AS position FROM panel")
def sorted_panel(spark, d):
    return windows.with_positions(t.panel(spark, d), "DRS", F.col("PERIODE").asc_nulls_last())


@query("O4", "DRS DISTRICT d:PERIODE r:cas",
       "SELECT DRS, DISTRICT, PERIODE, cas FROM surv ORDER BY PERIODE, DRS, DISTRICT LIMIT 5")
def first_rows(spark, d):
    return clean.preview(t.surveillance(spark, d), ["PERIODE", "DRS", "DISTRICT"], 5)
