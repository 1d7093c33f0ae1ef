"""Checks of filters, projections, validation and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthloom.functions import calendar as cal
from monthloom.functions import fixed, maths, text
from monthloom.operators import clean, features, scenarios, validate, windows
from monthloom.operators.aggregate import build_panel
from monthloom.operators.joins import left_by_keys
from monthloom.plans import tables as t
from monthloom.plans.registry import query
from monthloom.sources.readers import trim_headers
from monthloom.plans.sql import FEATURES, MONTHS_EN, MONTHS_FR, MONTHS_SHORT, W, WCOLS, WEDGE
from monthloom.session import written
from monthloom.spec import REGION

DAY = "CAST(date_trunc('month', o_orderdate) AS DATE)"


def _french(spark, d):
    return t.surveillance(spark, d).withColumn("PERIODE", cal.french_month_text("PERIODE"))


@query("P1", "DRS DISTRICT PERIODE english",
       f"SELECT DRS, DISTRICT, ({MONTHS_FR})[month(PERIODE)] || ' ' || year(PERIODE) AS PERIODE, "
       f"({MONTHS_EN})[month(PERIODE)] || ' ' || year(PERIODE) AS english FROM surv")
def french_to_english(spark, d):
    return _french(spark, d).withColumn("english", cal.english_month_text("PERIODE"))


def _english(text):
    return cal.or_fail(cal.parse_english_month(text), text, "month")


@query("P2", "DRS DISTRICT d:PERIODE d:from_english",
       "SELECT DRS, DISTRICT, PERIODE, PERIODE AS from_english FROM surv")
def parse_months(spark, d):
    df = _french(spark, d).withColumn("from_english", _english(cal.english_month_text("PERIODE")))
    return clean.with_parsed_french_months(df)


@query("P3", "PERIODE r:cas i:position",
       f"SELECT ({MONTHS_FR})[month(PERIODE)] || ' ' || year(PERIODE) AS PERIODE, sum(cas) AS cas, "
       "row_number() OVER (ORDER BY surv.PERIODE) AS position FROM surv GROUP BY surv.PERIODE")
def sort_by_month_text(spark, d):
    monthly = _french(spark, d).groupBy("PERIODE").agg(F.sum("cas").alias("cas"))
    return windows.with_positions(monthly, cal.parse_french_month("PERIODE"))


@query("P4", "i:o_orderkey d:PERIODE", f"SELECT o_orderkey, {DAY} AS PERIODE FROM orders", base=False)
def normalise_month(spark, d):
    return t.table(spark, d, "orders").select("o_orderkey", cal.month_start("o_orderdate").alias("PERIODE"))


@query("P5", "i:o_orderkey o_orderpriority d:day",
       "SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM orders "
       "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1996-02-01' "
       "AND o_orderdate <= TIMESTAMP '2001-06-01' AND o_orderdate < TIMESTAMP '2001-05-01'", base=False)
def key_and_date_filters(spark, d):
    orders = t.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    kept = clean.keep_keys(orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])
    bounds = [F.lit(x).cast("timestamp_ntz") for x in ("1996-02-01", "2001-06-01", "2001-05-01")]
    kept = clean.keep_months(kept, "o_orderdate", *bounds)
    return kept.withColumn("day", F.col("o_orderdate").cast("date"))


@query("P6", f"DRS DISTRICT d:PERIODE r:cas {WEDGE} r:tpi2 header",
       f"SELECT *, 'DRS,PERIODE,DISTRICT,cas,{','.join(W)},tpi2' AS header FROM merged")
def insert_columns(spark, d):
    df = clean.insert_before(t.merged(spark, d), list(W), "tpi2")
    return df.withColumn("header", F.lit(",".join(df.columns)))


@query("P7", f"DRS {WEDGE} r:target_lag_12 i:month", f"SELECT DRS, {WCOLS}, target_lag_12, month FROM features",
       ctes=FEATURES)
def keep_present_features(spark, d):
    frame = features.create_features(t.panel(spark, d), REGION)
    wanted = ["DRS", *W, "target_lag_12", "target_roll_mean_99", "month"]
    return frame.select(*features.present_features(frame, wanted))


@query("P8", f"{WEDGE} r:target_lag_1 i:month r:cas", f"SELECT {WCOLS}, target_lag_1, month, cas FROM features",
       ctes=FEATURES)
def inputs_and_target(spark, d):
    frame = features.create_features(t.panel(spark, d), REGION)
    inputs, _ = features.split_inputs(frame, REGION, ["DRS"])
    assert "cas" not in inputs.columns and "DRS" not in inputs.columns
    return frame.select(*inputs.columns, "cas")


@query("P9", "DRS d:PERIODE r:cas r:target_lag_12",
       f"SELECT * FROM features WHERE target_lag_12 IS NOT NULL AND {' AND '.join(f'{w} IS NOT NULL' for w in W)}",
       ctes=FEATURES)
def complete_feature_rows(spark, d):
    frame = features.create_features(t.panel(spark, d), REGION)
    return features.complete_rows(frame, features.feature_names(REGION))


@query("P10", "DRS i:n_rows problem",
       "SELECT DRS, count(*) AS n_rows, 'merged: missing columns: absent_1, absent_2' AS problem FROM merged GROUP BY DRS")
def required_columns(spark, d):
    """Schema check on the merged table: names the absent columns, no job."""
    df = t.merged(spark, d)
    try:
        validate.require_columns(df, ["DRS", "cas", "absent_1", "absent_2"], "merged")
        found = ""
    except validate.InvalidInput as error:
        found = str(error)
    return df.groupBy("DRS").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("problem", F.lit(found))


_P11 = [*W, "target_lag_1", "target_lag_12", "target_roll_mean_6"]


@query("P11", "column_name i:missing",
       " UNION ALL ".join(
           f"SELECT * FROM (SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM features) "
           "WHERE missing > 0" for c in _P11),
       ctes=FEATURES)
def missing_feature_counts(spark, d):
    return validate.missing_values(features.create_features(t.panel(spark, d), REGION), _P11)


@query("P12", "DRS DISTRICT d:PERIODE r:value",
       "SELECT DRS, DISTRICT, PERIODE, greatest(0.0, cas - 2.5) AS value FROM surv")
def clamp_at_zero(spark, d):
    return t.surveillance(spark, d).withColumn("value", maths.at_least_zero(F.col("cas") - 2.5))


@query("P13", "DRS DISTRICT d:PERIODE r:value",
       "SELECT DRS, DISTRICT, PERIODE, least(greatest(humidite * 2 - 20, 0.0), 100.0) AS value FROM weather")
def clip_to_range(spark, d):
    return t.weather(spark, d).withColumn("value", maths.between(F.col("humidite") * 2 - 20, 0.0, 100.0))


@query("P14", "DRS DISTRICT d:PERIODE r:percent",
       "SELECT DRS, DISTRICT, PERIODE, (cas - tpi2) / nullif(tpi2, 0) * 100 AS percent FROM surv")
def guarded_percent(spark, d):
    return t.surveillance(spark, d).withColumn("percent", maths.change_percent(F.col("cas"), F.col("tpi2")))


@query("P15", "DRS d:PERIODE r:cas i:absent r:vent", "SELECT DRS, PERIODE, cas, 0 AS absent, vent FROM panel")
def align_to_list(spark, d):
    return clean.align_columns(t.panel(spark, d), ["DRS", "PERIODE", "cas", "absent", "vent"])


_LABELS = fixed.WEATHER_LABELS | {"cas": fixed.TARGET_LABEL}


@query("P16", "DRS|d:PERIODE|" + "|".join(f"r:{v}" for v in _LABELS.values()),
       "SELECT DRS, PERIODE, " + ", ".join(f'{k} AS "{v}"' for k, v in _LABELS.items()) + " FROM panel")
def display_labels(spark, d):
    return clean.with_labels(t.panel(spark, d), _LABELS)


@query("P17", "DRS d:PERIODE r:precipitation r:vent",
       """SELECT p.DRS, p.PERIODE, coalesce(o.precipitation, p.precipitation) AS precipitation, p.vent AS vent
          FROM panel p LEFT JOIN (SELECT DRS, PERIODE, max(precipitation) AS precipitation
            FROM weather WHERE month(PERIODE) IN (1, 7) GROUP BY ALL) o
          ON o.DRS = p.DRS AND o.PERIODE = p.PERIODE""")
def override_measures(spark, d):
    weather = t.weather_once(spark, d)
    given = (
        weather.filter(F.month("PERIODE").isin(1, 7)).groupBy("DRS", "PERIODE")
        .agg(F.max("precipitation").alias("precipitation")).withColumn("vent", F.lit(None).cast("double"))
    )
    panel = build_panel(left_by_keys(t.surveillance(spark, d), weather, t.MERGE_KEYS), REGION)
    return clean.override_values(panel, given, ["DRS", "PERIODE"], ["precipitation", "vent"])


@query("P18", "DRS d:start d:stop problem",
       """SELECT q.DRS, q.start, q.stop,
            CASE WHEN s.first_month IS NULL THEN 'unknown series'
                 WHEN q.start > q.stop THEN 'start is after stop'
                 WHEN n.n = 0 THEN 'no history before start'
                 WHEN n.n < 12 THEN 'at least 12 months of history are required, found ' || n.n END AS problem
          FROM asked q LEFT JOIN seen s ON s.DRS = q.DRS
          LEFT JOIN LATERAL (SELECT count(*) AS n FROM panel p WHERE p.DRS = q.DRS AND p.PERIODE < q.start) n ON true""",
       ctes="""
seen AS (SELECT DRS, min(PERIODE) AS first_month, max(PERIODE) AS last_month FROM panel GROUP BY DRS),
asked AS (
  SELECT DRS, first_month AS start, last_month AS stop FROM seen
  UNION ALL SELECT DRS, CAST(first_month + INTERVAL 5 MONTH AS DATE), last_month FROM seen
  UNION ALL SELECT DRS, CAST(last_month + INTERVAL 1 MONTH AS DATE), CAST(last_month + INTERVAL 12 MONTH AS DATE) FROM seen
  UNION ALL SELECT DRS, last_month, first_month FROM seen
  UNION ALL SELECT 'DRS ' || r_name, (SELECT min(first_month) FROM seen), (SELECT max(last_month) FROM seen) FROM region)""")
def request_problems(spark, d):
    panel = t.panel_once(spark, d)
    seen = panel.groupBy("DRS").agg(F.min("PERIODE").alias("a"), F.max("PERIODE").alias("b"))
    a, b = F.col("a"), F.col("b")
    pairs = F.array(*[
        F.struct(x.alias("start"), y.alias("stop"))
        for x, y in ((a, b), (F.add_months(a, 5), b), (F.add_months(b, 1), F.add_months(b, 12)), (b, a))
    ])
    known = seen.select("DRS", F.inline(pairs))
    unknown = t.table(spark, d, "region").select(
        F.concat(F.lit("DRS "), "r_name").alias("DRS"),
        panel.agg(F.min("PERIODE").alias("x")).scalar().alias("start"),
        panel.agg(F.max("PERIODE").alias("x")).scalar().alias("stop"),
    )
    return validate.check_requests(known.unionByName(unknown), panel, REGION)


_P19 = [("DRS", "string"), ("PERIODE", "date"), ("DISTRICT", "string"), ("cas", "double"), ("tpi2", "double"),
        *[(w, "double") for w in W]]


@query("P19", "column_name column_type i:row_count i:non_null i:distinct_keys",
       " UNION ALL ".join(
           f"SELECT '{c}' AS column_name, '{k}' AS column_type, count(*) AS row_count, count({c}) AS non_null, "
           f"{f'count(DISTINCT {c})' if c in ('DRS', 'DISTRICT', 'PERIODE') else 'NULL'} AS distinct_keys FROM merged"
           for c, k in _P19))
def profile_columns(spark, d):
    return clean.profile(t.merged(spark, d), ["DRS", "DISTRICT", "PERIODE"])


@query("P20", "DRS DISTRICT d:PERIODE r:cas", "SELECT DRS, DISTRICT, PERIODE, cas FROM surv")
def drop_duplicates(spark, d):
    once = t.surveillance_once(spark, d)
    return clean.drop_repeats(once.unionByName(once), ["DRS", "DISTRICT", "PERIODE"])


# ---------------------------------------------------------------- functions


@query("F1", "i:o_orderkey i:month i:quarter i:year",
       "SELECT o_orderkey, month(o_orderdate) AS month, quarter(o_orderdate) AS quarter, year(o_orderdate) AS year "
       "FROM orders", base=False)
def month_quarter_year(spark, d):
    c = F.col("o_orderdate")
    return t.table(spark, d, "orders").select(
        "o_orderkey", F.month(c).alias("month"), F.quarter(c).alias("quarter"), F.year(c).alias("year"))


@query("F2", "i:o_orderkey d:year_before d:next_month",
       f"SELECT o_orderkey, CAST({DAY} - INTERVAL 12 MONTH AS DATE) AS year_before, "
       f"CAST({DAY} + INTERVAL 1 MONTH AS DATE) AS next_month FROM orders", base=False)
def shifted_months(spark, d):
    m = cal.month_start("o_orderdate")
    return t.table(spark, d, "orders").select(
        "o_orderkey", cal.add_months(m, -12).alias("year_before"), cal.add_months(m, 1).alias("next_month"))


@query("F3", "i:l_orderkey i:l_linenumber i:months",
       "SELECT l_orderkey, l_linenumber, (year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) "
       "- month(o_orderdate) AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey", base=False)
def months_between(spark, d):
    lines = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = t.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn(
        "months", cal.months_apart("l_shipdate", "o_orderdate"))


@query("F4", "DISTRICT d:PERIODE d:ahead",
       """SELECT DISTRICT, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS PERIODE, NULL::DATE AS ahead
          FROM ends
          UNION ALL
          SELECT DISTRICT, NULL::DATE,
                 CAST(unnest(generate_series(b, CAST(b + INTERVAL 5 MONTH AS DATE), INTERVAL 1 MONTH)) AS DATE) FROM ends""",
       ctes="ends AS (SELECT DISTRICT, min(PERIODE) AS a, max(PERIODE) AS b FROM surv GROUP BY DISTRICT)")
def month_sequences(spark, d):
    ends = t.surveillance(spark, d).groupBy("DISTRICT").agg(F.min("PERIODE").alias("a"), F.max("PERIODE").alias("b"))
    none = F.lit(None).cast("date")
    between = ends.select("DISTRICT", F.explode(cal.month_list(F.col("a"), F.col("b"))).alias("PERIODE"), none.alias("ahead"))
    onward = ends.select("DISTRICT", none.alias("PERIODE"), F.explode(cal.months_from(F.col("b"), 6)).alias("ahead"))
    return between.unionByName(onward)


@query("F5", "i:o_orderkey month_key day_key",
       "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month_key, strftime(o_orderdate, '%Y-%m-%d') AS day_key "
       "FROM orders", base=False)
def date_texts(spark, d):
    return t.table(spark, d, "orders").select(
        "o_orderkey", cal.month_key("o_orderdate").alias("month_key"), cal.day_key("o_orderdate").alias("day_key"))


@query("F6", "DRS label r:cas",
       f"SELECT DRS, ({MONTHS_SHORT})[month(PERIODE)] || ' ' || year(PERIODE) AS label, cas FROM panel")
def short_month_label(spark, d):
    return t.panel(spark, d).withColumn("label", cal.month_label("PERIODE"))


@query("F7", "DISTRICT month_name i:year",
       f"SELECT DISTRICT, ({MONTHS_FR})[month(PERIODE)] AS month_name, year(PERIODE) AS year FROM surv")
def split_month_text(spark, d):
    name, year = cal.split_month_year("PERIODE")
    return _french(spark, d).select("DISTRICT", name.alias("month_name"), year.alias("year"))


@query("F8", "i:c_custkey short", "SELECT c_custkey, replace(DRS, 'DRS ', '') AS short FROM places")
def short_region_name(spark, d):
    return t.places(spark, d).withColumn("short", text.short_name("DRS"))


@query("F9", "DRS DISTRICT d:PERIODE r:cas", "SELECT DRS, DISTRICT, PERIODE, cas FROM surv")
def trimmed_headers(spark, d):
    df = t.surveillance(spark, d)
    return trim_headers(df.toDF(*[f"  {c} " for c in df.columns]))


@query("F10", "i:c_custkey safe",
       "SELECT c_custkey, replace(replace(replace(DISTRICT, '/', '_'), '\\', '_'), ' ', '_') AS safe FROM places")
def safe_names(spark, d):
    return t.places(spark, d).withColumn("safe", text.safe_name("DISTRICT"))


_NAMES = [*W, "target_lag_1", "target_roll_mean_6", "month", "month_sin"]


@query("F11", "feature family label i:non_null",
       f"""SELECT 'num__' || name AS feature, name AS label, non_null,
             CASE WHEN name LIKE 'target_lag%' OR name LIKE 'target_roll%' THEN '{fixed.FAMILY_HISTORY}'
                  WHEN name IN ({', '.join(f"'{w}'" for w in W)}) THEN '{fixed.FAMILY_WEATHER}'
                  ELSE '{fixed.FAMILY_CALENDAR}' END AS family
           FROM ({' UNION ALL '.join(f"SELECT '{c}' AS name, count({c}) AS non_null FROM features" for c in _NAMES)})
           UNION ALL
           SELECT 'cat__DRS_' || DRS, '{fixed.KEY_LABEL_PREFIX}' || replace(DRS, 'DRS ', ''), count(*),
                  '{fixed.FAMILY_KEY}' FROM features GROUP BY DRS""",
       ctes=FEATURES)
def feature_families(spark, d):
    frame = written(features.create_features(t.panel(spark, d), REGION), "features")
    numeric = clean.profile(frame.select(*_NAMES), []).select(
        F.concat(F.lit("num__"), "column_name").alias("feature"), "non_null")
    keys = frame.groupBy("DRS").agg(F.count(F.lit(1)).alias("non_null")).select(
        F.concat(F.lit("cat__DRS_"), "DRS").alias("feature"), "non_null")
    return numeric.unionByName(keys).withColumns(
        {"family": text.feature_family("feature"), "label": text.feature_label("feature")})


@query("F12", "scenario short i:n",
       "SELECT name AS scenario, split_part(name, ' (', 1) AS short, count(*) AS n FROM panel, (VALUES "
       + ", ".join(f"('{s[0]}')" for s in fixed.RELATIVE_SCENARIOS) + ") v(name) GROUP BY ALL")
def scenario_short_names(spark, d):
    every = scenarios.apply_adjustments(t.panel(spark, d), scenarios.relative_presets())
    return every.groupBy("scenario").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "short", text.before_parenthesis("scenario"))


@query("F13", "DRS d:PERIODE total missing",
       f"SELECT DRS, PERIODE, replace(format('{{:,}}', CAST(round_even(sum(cents) / 100.0, 0) AS BIGINT)), ',', chr(8239)) "
       f"AS total, '{fixed.NO_VALUE}' AS missing FROM (SELECT DRS, {DAY} AS PERIODE, "
       "CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN places ON o_custkey = c_custkey) GROUP BY ALL")
def grouped_integers(spark, d):
    orders = t.table(spark, d, "orders").select(
        "o_custkey", cal.month_start("o_orderdate").alias("PERIODE"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    per_customer = orders.groupBy("o_custkey", "PERIODE").agg(F.sum("cents").alias("cents"))
    joined = per_customer.join(t.places(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    totals = joined.groupBy("DRS", "PERIODE").agg((F.sum("cents").cast("double") / 100.0).alias("v"))
    return totals.withColumns({
        "total": text.grouped_integer("v"),
        "missing": text.grouped_integer(F.concat("DRS", F.lit("?"))),
    })


@query("F14", "i:o_orderkey r:month_sin r:month_cos",
       "SELECT o_orderkey, sin(2 * pi() * month(o_orderdate) / 12) AS month_sin, "
       "cos(2 * pi() * month(o_orderdate) / 12) AS month_cos FROM orders", base=False)
def cyclic_month(spark, d):
    m = F.month("o_orderdate")
    return t.table(spark, d, "orders").select(
        "o_orderkey", cal.cyclic_sin(m).alias("month_sin"), cal.cyclic_cos(m).alias("month_cos"))


@query("F15", "DRS d:PERIODE r:absolute r:root r:squared r:even",
       "SELECT DRS, PERIODE, abs(cas - 8) AS absolute, sqrt(cas) AS root, pow(cas - 8, 2) AS squared, "
       "round_even(cas / 2, 0) AS even FROM panel")
def elementary_functions(spark, d):
    y = F.col("cas")
    return t.panel(spark, d).withColumns({
        "absolute": F.abs(y - 8), "root": F.sqrt(y), "squared": F.pow(y - 8, F.lit(2)), "even": F.bround(y / 2, 0)})


@query("F16", "DISTRICT month_name i:number",
       f"SELECT DISTRICT, ({MONTHS_FR})[month(PERIODE)] AS month_name, month(PERIODE) AS number FROM surv")
def month_name_map(spark, d):
    name, _ = cal.split_month_year("PERIODE")
    return _french(spark, d).select("DISTRICT", name.alias("month_name"), cal.month_of_french_name(name).alias("number"))


@query("F17", "DRS i:step r:value",
       "SELECT DRS, k AS step, vals[(k - 1) % len(vals) + 1] AS value FROM "
       "(SELECT DRS, list(cas ORDER BY PERIODE) AS vals FROM panel GROUP BY DRS), range(1, 101) r(k)")
def cyclic_tiles(spark, d):
    rows = t.panel(spark, d).groupBy("DRS").agg(F.array_sort(F.collect_list(F.struct("PERIODE", "cas"))).alias("v"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.struct(
        k.alias("step"), maths.cyclic_pick(F.col("v"), k)["cas"].alias("value")))
    return rows.select("DRS", F.inline(steps))


@query("F18", "DRS json",
       "SELECT DRS, '{\"DRS\":\"' || DRS || '\",\"year\":2000,\"months\":' || count(*) || '}' AS json "
       "FROM panel WHERE year(PERIODE) = 2000 GROUP BY DRS")
def json_texts(spark, d):
    rows = t.panel(spark, d).filter(F.year("PERIODE") == 2000).groupBy("DRS").agg(F.count(F.lit(1)).alias("months"))
    return rows.withColumn("json", F.to_json(F.struct("DRS", F.lit(2000).alias("year"), "months")))
