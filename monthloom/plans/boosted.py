"""The library's own learners run on calendar columns and lags, next to SQL that grows the same trees and finds the same line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions import fixed
from monthloom.operators import features, forecast, futures, learn, trees
from monthloom.operators.aggregate import build_panel
from monthloom.plans import tables as t
from monthloom.plans.forecasting import _PERSIST
from monthloom.plans.learned import _COMPLETE, _M, _METRICS, _PARTS, CALENDAR, LAGS, _parts
from monthloom.plans.learning import NUMERIC, WHOLE_BOOSTING
from monthloom.plans.registry import query
from monthloom.plans.sql import FEATURES, W, recursion
from monthloom.session import written
from monthloom.spec import NATION, REGION

# ----------------------------------------------------------------------- trees


def _soft(g: str, l1: float) -> str:
    return f"sign({g}) * greatest(abs({g}) - {l1}, 0)"


def _worth(g: str, n: str, how: dict) -> str:
    return f"coalesce(power({_soft(g, how['l1'])}, 2) / nullif({n} + {how['l2']}, 0), 0)"


def _cuts(rows: str, how: dict) -> str:
    """Every cut of every node of ``rows`` (node, month, year, g) with its gain, as a select."""
    sides = " UNION ALL ".join(
        f"SELECT r.node, {k} AS slot, '{c}' AS feature, c.{c} AS cut, "
        f"coalesce(sum(r.g) FILTER (r.{c} <= c.{c}), 0) AS gl, count(*) FILTER (r.{c} <= c.{c}) AS nl, sum(r.g) AS gt, count(*) AS nt "
        f"FROM {rows} r, (SELECT DISTINCT {c} FROM {rows}) c GROUP BY r.node, c.{c}" for k, c in enumerate(CALENDAR))
    gain = (f"{_worth('gl', 'nl', how)} + {_worth('(gt - gl)', '(nt - nl)', how)} - {_worth('gt', 'nt', how)}")
    return f"SELECT *, {gain} AS gain FROM ({sides})"


def _moved(rows: str, splits: str, new: str) -> str:
    """``rows`` with the node after the splits; ``new`` names it from the old one and the side."""
    right = "CASE s.feature " + " ".join(f"WHEN '{c}' THEN r.{c}" for c in CALENDAR) + " END > s.cut"
    return f"SELECT {', '.join('r.' + c for c in CALENDAR)}, r.g, {new.format(right=f'({right})')} AS node FROM {rows} r {splits}"


def _grown(steps: list[str], last: str, how: dict) -> str:
    """CTEs of one tree from the mean, with the prediction for every cell of ``train``."""
    return _PARTS + f""",
base AS (SELECT avg(cas) AS b FROM train),
rows0 AS (SELECT {', '.join(CALENDAR)}, b - cas AS g, 0 AS node FROM train, base),
""" + ",\n".join(steps) + f""",
grown AS (SELECT {', '.join(CALENDAR)}, node, sum(g) OVER (PARTITION BY node) AS gt, count(*) OVER (PARTITION BY node) AS nt FROM {last}),
cells AS (SELECT DISTINCT {', '.join(CALENDAR)}, b + {how['stepSize']} * -({_soft('gt', how['l1'])}) / (nt + {how['l2']}) AS prediction
  FROM grown, base)"""


def _levels_sql(how: dict) -> str:
    steps = []
    for k in range(how["maxDepth"]):
        steps.append(f"cuts{k} AS ({_cuts(f'rows{k}', how)})")
        steps.append(f"""best{k} AS (SELECT node, arg_min({{'f': feature, 'c': cut}}, {{'a': -gain, 'b': slot, 'c': cut}}) AS s
  FROM cuts{k} WHERE nl >= 1 AND nt - nl >= 1 AND gain > 0 GROUP BY node)""")
        joined = f"LEFT JOIN (SELECT node, s.f AS feature, s.c AS cut FROM best{k}) s ON s.node = r.node"
        steps.append(f"rows{k + 1} AS ({_moved(f'rows{k}', joined, 'CASE WHEN s.node IS NULL THEN r.node ELSE 2 * r.node + 1 + CAST({right} AS INTEGER) END')})")
    return _grown(steps, f"rows{how['maxDepth']}", how)


def _leafwise_sql(how: dict) -> str:
    steps = []
    for k in range(how["leaves"] - 1):
        steps.append(f"cuts{k} AS ({_cuts(f'rows{k}', how)})")
        steps.append(f"""best{k} AS (SELECT node, feature, cut FROM cuts{k} WHERE nl >= 1 AND nt - nl >= 1 AND gain > 0
  ORDER BY gain DESC, slot, cut LIMIT 1)""")
        joined = f"LEFT JOIN best{k} s ON s.node = r.node"
        steps.append(f"rows{k + 1} AS ({_moved(f'rows{k}', joined, f'CASE WHEN s.node IS NOT NULL AND {{right}} THEN {k + 1} ELSE r.node END')})")
    return _grown(steps, f"rows{how['leaves'] - 1}", how)


def _symmetric_sql(how: dict) -> str:
    steps = []
    for k in range(how["maxDepth"]):
        steps.append(f"cuts{k} AS ({_cuts(f'rows{k}', how)})")
        steps.append(f"""best{k} AS (SELECT feature, cut FROM cuts{k} GROUP BY slot, feature, cut HAVING sum(gain) > 0
  ORDER BY sum(gain) DESC, slot, cut LIMIT 1)""")
        steps.append(f"rows{k + 1} AS ({_moved(f'rows{k}', f', best{k} s', '2 * r.node + 1 + CAST({right} AS INTEGER)')})")
    return _grown(steps, f"rows{how['maxDepth']}", how)


def _cells(spark, d, how: dict) -> DataFrame:
    train, _ = _parts(spark, d)
    model = learn.fit(train, REGION, CALENDAR, learn.BOOSTING, {**how, "maxIter": 1}, key=None)
    return model.transform(train.select(*CALENDAR).distinct()).select(*CALENDAR, "prediction")


_EDGE = "i:month i:year r:prediction"
_LEVELS = {"maxDepth": 2, "stepSize": 0.3, "l1": 5.0, "l2": 1.0, "maxBins": 256}
_LEAFWISE = {"maxDepth": 0, "leaves": 7, "stepSize": 0.5, "l1": 1.0, "l2": 2.0, "maxBins": 256}
_SYMMETRIC = {"maxDepth": 2, "symmetric": True, "stepSize": 0.4, "l1": 2.0, "l2": 3.0, "maxBins": 256}


@query("M6_levels", _EDGE, "SELECT * FROM cells", ctes=_levels_sql(_LEVELS))
def tree_by_levels(spark, d):
    """One round of two levels, with L1 and L2 on the leaves."""
    return _cells(spark, d, _LEVELS)


@query("M6_leafwise", _EDGE, "SELECT * FROM cells", ctes=_leafwise_sql(_LEAFWISE))
def tree_by_leaves(spark, d):
    """One tree of seven leaves, the best leaf split first."""
    return _cells(spark, d, _LEAFWISE)


@query("M6_symmetric", _EDGE, "SELECT * FROM cells", ctes=_symmetric_sql(_SYMMETRIC))
def symmetric_tree(spark, d):
    """One tree of two levels with one cut each."""
    return _cells(spark, d, _SYMMETRIC)


def _spark_cells(spark, d, how: dict) -> DataFrame:
    """The same tree grown by one aggregate per level over the whole table."""
    train, _ = _parts(spark, d)
    rows = train.select(F.array(*[F.col(c).cast("double") for c in CALENDAR]).alias("x"), F.col("cas").cast("double").alias("label"))
    made = trees.boost_spark(written(rows, "training"), learn.estimators.growth_of({**how, "maxIter": 1}, len(CALENDAR)))
    cells = train.select(*CALENDAR).distinct()
    return cells.withColumn("prediction", trees.predicted(F.array(*[F.col(c).cast("double") for c in CALENDAR]), made))


@query("M6_levels_spark", _EDGE, "SELECT * FROM cells", ctes=_levels_sql(_LEVELS))
def tree_by_levels_of_aggregates(spark, d):
    return _spark_cells(spark, d, _LEVELS)


@query("M6_leafwise_spark", _EDGE, "SELECT * FROM cells", ctes=_leafwise_sql(_LEAFWISE))
def tree_by_leaves_of_aggregates(spark, d):
    return _spark_cells(spark, d, _LEAFWISE)


@query("M6_symmetric_spark", _EDGE, "SELECT * FROM cells", ctes=_symmetric_sql(_SYMMETRIC))
def symmetric_tree_of_aggregates(spark, d):
    return _spark_cells(spark, d, _SYMMETRIC)


# ----------------------------------------------------------------- robust line

_EPSILON, _COST = 2.0, 1.0
# with a large cost the best line goes through two points moved by epsilon
_BEST_LINE = f"""
nation AS (SELECT PERIODE, sum(cas) AS cas FROM panel GROUP BY PERIODE),
points AS (SELECT * FROM (SELECT PERIODE, cas AS y, lag(cas) OVER (ORDER BY PERIODE) AS x FROM nation) WHERE x IS NOT NULL),
corners AS (SELECT x, y + s * {_EPSILON} AS y FROM points, (VALUES (-1), (1)) v(s)),
lines AS (SELECT DISTINCT (b.y - a.y) / (b.x - a.x) AS w, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS c FROM corners a JOIN corners b ON a.x < b.x),
tried AS (SELECT w, c, w * w / 2 + {_COST} * sum(greatest(abs(y - w * x - c) - {_EPSILON}, 0)) AS loss FROM lines, points GROUP BY w, c),
best AS (SELECT w, c FROM tried ORDER BY loss LIMIT 1),
shifts AS (SELECT * FROM (VALUES (0.0, 0.0), (0.05, 0.0), (-0.05, 0.0), (0.0, 3.0), (0.0, -3.0)) v(dw, dc))"""


@query("M7_epsilon", "r:dw r:dc r:slope r:intercept r:loss",
       f"""SELECT dw, dc, w AS slope, c AS intercept, (w + dw) * (w + dw) / 2
             + {_COST} * sum(greatest(abs(y - (w + dw) * x - (c + dc)) - {_EPSILON}, 0)) AS loss
           FROM best, shifts, points GROUP BY dw, dc, w, c""", ctes=_BEST_LINE)
def epsilon_line(spark, d):
    """The best line of the national series on its last month, and the real loss there and beside it."""
    rows = _national(spark, d)
    learner = learn.Learner("epsilon", learn.EPSILON.build)
    model = learn.fit(rows, REGION, LAGS[:1], learner, {"epsilon": _EPSILON, "cost": _COST}, key=None).stages[-1]
    slope, intercept = model.getOrDefault("coefficients")[0], model.getOrDefault("intercept")
    shifts = spark.createDataFrame([(0.0, 0.0), (0.05, 0.0), (-0.05, 0.0), (0.0, 3.0), (0.0, -3.0)], "dw double, dc double")
    held = shifts.select(F.collect_list(F.struct("dw", "dc")).alias("all"))
    losses = rows.select("cas", LAGS[0]).withColumn("shift", F.explode(held.scalar()))
    w, c = F.lit(slope) + F.col("shift.dw"), F.lit(intercept) + F.col("shift.dc")
    excess = F.greatest(F.abs(F.col("cas") - w * F.col(LAGS[0]) - c) - _EPSILON, F.lit(0.0))
    return losses.withColumns({"excess": excess, "w": w}).groupBy("shift", "w").agg(F.sum("excess").alias("total")).select(
        "shift.dw", "shift.dc", F.lit(slope).alias("slope"), F.lit(intercept).alias("intercept"),
        (F.col("w") * F.col("w") / 2 + _COST * F.col("total")).alias("loss"))


def _national(spark, d) -> DataFrame:
    """The national series as one more series, with its lags."""
    spec = REGION.having(exog_agg=NATION.exog_agg)
    nation = build_panel(t.merged(spark, d).withColumn("DRS", F.lit("national")), spec)
    return written(features.create_features(nation, spec).filter("target_lag_1 IS NOT NULL"), "national")


# ------------------------------------------------------------ trees that recur

_STUMP_CUT = """,
complete AS (SELECT * FROM features WHERE """ + _COMPLETE + f"""),
base AS (SELECT avg(cas) AS b FROM complete),
cuts AS (SELECT c.cut, sum(b - cas) FILTER (target_lag_1 <= cut) AS gl, count(*) FILTER (target_lag_1 <= cut) AS nl,
    sum(b - cas) AS gt, count(*) AS nt
  FROM complete, base, (SELECT DISTINCT target_lag_1 AS cut FROM complete) c GROUP BY c.cut),
stump AS (SELECT cut, b - gl / nl AS low, b - (gt - gl) / (nt - nl) AS high FROM cuts, base WHERE nl < nt
  ORDER BY gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) DESC, cut LIMIT 1),
"""


@query("T14_trees", "DRS d:PERIODE r:prediction problem", "SELECT * FROM answered",
       ctes=FEATURES + _STUMP_CUT + _PERSIST.format(n=13) + "," + recursion(
           "future", line="stump").replace("stump.a + stump.b * r.hist[-1]", "CASE WHEN r.hist[-1] <= stump.cut THEN stump.low ELSE stump.high END"))
def recursion_with_trees(spark, d):
    """A boosted ensemble as one array fold: here of one cut, which SQL can follow."""
    panel = t.panel_once(spark, d)
    frame = features.complete_rows(features.create_features(panel, REGION), features.feature_names(REGION))
    how = {"maxIter": 1, "maxDepth": 1, "stepSize": 1.0, "l2": 0.0, "maxBins": 8192}
    rule = learn.as_tree_rule(learn.fit(frame, REGION, LAGS[:1], learn.BOOSTING, how, key=None), frame)
    weather = futures.by_persistence(panel, REGION, futures.after_history(panel, REGION), 12)
    return forecast.forecast_by_rule(panel, weather, rule, REGION, on_problem="mark")


@query("T14_boosting", "DRS d:PERIODE r:prediction problem")
def recursion_with_boosting(spark, d):
    """The whole ensemble, key indicators included, inside one plan."""
    panel = t.panel_once(spark, d)
    frame = features.complete_rows(features.create_features(panel, REGION), features.feature_names(REGION))
    rule = learn.as_tree_rule(learn.fit(frame, REGION, NUMERIC, *WHOLE_BOOSTING), frame)
    weather = futures.by_persistence(panel, REGION, futures.after_history(panel, REGION), 12)
    return forecast.forecast_by_rule(panel, weather, rule, REGION, on_problem="mark")


# --------------------------------------------- a tree over all columns and keys

_WIDE = {"maxDepth": 3, "stepSize": 0.5, "l1": 1.0, "l2": 1.0, "maxBins": 8192}


def _wide_sql(how: dict) -> str:
    """CTEs of one tree over every encoded column: ``predicted`` rows and ``importance`` of every column."""
    numeric = " UNION ALL ".join(
        f"SELECT DRS, PERIODE, {1000 + k} AS slot, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM rows" for k, c in enumerate(NUMERIC))
    steps = []
    for k in range(how["maxDepth"]):
        gain = f"{_worth('gl', 'nl', how)} + {_worth('(gt - gl)', '(nt - nl)', how)} - {_worth('gt', 'nt', how)}"
        steps.append(f"""hist{k} AS (SELECT node, slot, feature, v, sum(g) AS g, count(*) AS n FROM place{k} JOIN longs USING (DRS, PERIODE)
  WHERE part = 'train' GROUP BY ALL),
cum{k} AS (SELECT node, slot, feature, v, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER whole AS gt, sum(n) OVER whole AS nt
  FROM hist{k} WINDOW w AS (PARTITION BY node, slot ORDER BY v), whole AS (PARTITION BY node, slot)),
best{k} AS (SELECT node, arg_min({{'s': slot, 'f': feature, 'c': v}}, {{'a': -round(gain, 6), 'b': slot, 'c': v}}) AS s
  FROM (SELECT *, {gain} AS gain FROM cum{k}) WHERE nl < nt AND gain > 0 GROUP BY node),
place{k + 1} AS (SELECT p.* REPLACE (CASE WHEN b.node IS NULL THEN p.node ELSE 2 * p.node + 1 + CAST(l.v > b.s.c AS INTEGER) END AS node)
  FROM place{k} p LEFT JOIN best{k} b ON b.node = p.node
  LEFT JOIN longs l ON l.DRS = p.DRS AND l.PERIODE = p.PERIODE AND l.slot = b.s.s)""")
    last = f"place{how['maxDepth']}"
    splits = " UNION ALL ".join(f"SELECT s.f AS feature, s.s AS slot FROM best{k}" for k in range(how["maxDepth"]))
    return _PARTS + f""",
rows AS (SELECT *, 'train' AS part FROM train UNION ALL SELECT *, 'test' AS part FROM test),
longs AS ({numeric}
  UNION ALL SELECT r.DRS, r.PERIODE, k.slot, k.feature, CAST(r.DRS = k.DRS AS DOUBLE) FROM rows r, (
    SELECT DRS, dense_rank() OVER (ORDER BY DRS) AS slot, '{fixed.KEY_LABEL_PREFIX}' || replace(DRS, 'DRS ', '') AS feature
    FROM (SELECT DISTINCT DRS FROM train)) k),
base AS (SELECT avg(cas) AS b FROM train),
place0 AS (SELECT DRS, PERIODE, cas, part, b - cas AS g, 0 AS node FROM rows, base),
""" + ",\n".join(steps) + f""",
leaves AS (SELECT node, -({_soft('sum(g)', how['l1'])}) / (count(*) + {how['l2']}) AS value FROM {last} WHERE part = 'train' GROUP BY node),
predicted AS (SELECT part, cas, greatest(0, b + {how['stepSize']} * value) AS p FROM {last} JOIN leaves USING (node), base),
splits AS ({splits}),
importance AS (SELECT f.feature, CAST(coalesce(n, 0) AS DOUBLE) AS importance,
    CASE WHEN f.slot < 1000 THEN '{fixed.FAMILY_KEY}'
      WHEN f.feature LIKE 'target_lag%' OR f.feature LIKE 'target_roll%' THEN '{fixed.FAMILY_HISTORY}'
      WHEN f.feature IN ({', '.join(f"'{w}'" for w in W)}) THEN '{fixed.FAMILY_WEATHER}' ELSE '{fixed.FAMILY_CALENDAR}' END AS famille
  FROM (SELECT DISTINCT slot, feature FROM longs) f LEFT JOIN (SELECT slot, count(*) AS n FROM splits GROUP BY slot) s ON s.slot = f.slot)"""


def _wide(spark, d):
    train, test = _parts(spark, d)
    return learn.fit(train, REGION, NUMERIC, learn.BOOSTING, {**_WIDE, "maxIter": 1}), train, test


@query("M10_trees", _M, f"SELECT {_METRICS} FROM predicted WHERE part = 'test'", ctes=_wide_sql(_WIDE))
def evaluated_tree(spark, d):
    """Held-out metrics of a boosted tree over every column and key."""
    model, _, test = _wide(spark, d)
    row = learn.evaluate_model(model, test, REGION)
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))


def _wide_importance(spark, d) -> DataFrame:
    model, train, _ = _wide(spark, d)
    return learn.importance_table(spark, model, train)


@query("M13_trees", "feature|r:importance|famille", "SELECT * FROM importance", ctes=_wide_sql(_WIDE))
def importance_of_every_column(spark, d):
    return _wide_importance(spark, d)


@query("O2_trees", "feature|r:importance", "SELECT feature, importance FROM importance ORDER BY importance DESC, feature LIMIT 20",
       ctes=_wide_sql(_WIDE))
def twenty_most_important(spark, d):
    return learn.top_features(_wide_importance(spark, d))


@query("A24_trees", "famille|r:importance", "SELECT famille, sum(importance) AS importance FROM importance GROUP BY famille",
       ctes=_wide_sql(_WIDE))
def importance_by_family_of_columns(spark, d):
    return learn.family_importance(_wide_importance(spark, d))
