"""SQL text shared by the checks."""

from __future__ import annotations

from monthloom.functions import fixed

W = fixed.WEATHER_COLUMNS
WCOLS = ", ".join(W)
WEDGE = " ".join(f"r:{w}" for w in W)
MONTHS_FR = "[" + ", ".join(f"'{m}'" for m in fixed.MONTHS_FR) + "]"
MONTHS_EN = "[" + ", ".join(f"'{m}'" for m in fixed.MONTHS_EN) + "]"
MONTHS_SHORT = "[" + ", ".join(f"'{m}'" for m in fixed.MONTHS_SHORT_FR) + "]"


def avg_all(names=W) -> str:
    return ", ".join(f"avg({n}) AS {n}" for n in names)


def cols(alias: str, names=W) -> str:
    return ", ".join(f"{alias}.{n} AS {n}" for n in names)


BASE = f"""
places AS (
  SELECT c_custkey, 'DRS ' || n_name AS DRS, n_name || ' / ' || c_mktsegment AS DISTRICT
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
surv AS (
  SELECT DRS, DISTRICT, CAST(date_trunc('month', o_orderdate) AS DATE) AS PERIODE,
         CAST(count(*) AS DOUBLE) AS cas,
         CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) AS tpi2
  FROM orders JOIN places ON o_custkey = c_custkey GROUP BY ALL),
weather AS (
  SELECT DRS, DISTRICT, CAST(date_trunc('month', l_shipdate) AS DATE) AS PERIODE,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100000 AS temperature_moyenne,
         max(round(l_extendedprice * 100)) / 100000 AS temperature_max,
         min(round(l_extendedprice * 100)) / 100000 AS temperature_min,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS precipitation,
         CAST(sum(CAST(round(l_discount * 1000) AS BIGINT)) AS DOUBLE) / count(*) AS humidite,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS vent,
         CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS rayonnement_solaire
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN places ON o_custkey = c_custkey GROUP BY ALL),
merged AS (
  SELECT s.DRS, s.DISTRICT, s.PERIODE, s.cas, {cols("w")}, s.tpi2
  FROM surv s LEFT JOIN weather w ON s.DRS = w.DRS AND s.DISTRICT = w.DISTRICT AND s.PERIODE = w.PERIODE),
panel AS (SELECT DRS, PERIODE, sum(cas) AS cas, {avg_all()} FROM merged GROUP BY DRS, PERIODE)"""

# lags and full-window rolling means of the panel
FEATURES = f"""
features AS (
  SELECT DRS, PERIODE, cas, {WCOLS},
    lag(cas, 1) OVER w AS target_lag_1, lag(cas, 2) OVER w AS target_lag_2, lag(cas, 3) OVER w AS target_lag_3,
    lag(cas, 6) OVER w AS target_lag_6, lag(cas, 12) OVER w AS target_lag_12,
    CASE WHEN count(cas) OVER w3 = 3 THEN avg(cas) OVER w3 END AS target_roll_mean_3,
    CASE WHEN count(cas) OVER w6 = 6 THEN avg(cas) OVER w6 END AS target_roll_mean_6,
    month(PERIODE) AS month, year(PERIODE) AS year,
    sin(2.0 * pi() * month(PERIODE) / 12.0) AS month_sin, cos(2.0 * pi() * month(PERIODE) / 12.0) AS month_cos
  FROM panel
  WINDOW w AS (PARTITION BY DRS ORDER BY PERIODE),
         w3 AS (PARTITION BY DRS ORDER BY PERIODE ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
         w6 AS (PARTITION BY DRS ORDER BY PERIODE ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))"""

_D_LAGS = ", ".join(f"lag(cas, {k}) OVER w AS lag_{k}" for k in range(1, 13))

# district features: calendar with quarter, twelve lags, rolling means, difference
DISTRICT_FEATURES = f"""
district_features AS (
  SELECT DISTRICT, PERIODE, cas, {WCOLS}, month(PERIODE) AS month, quarter(PERIODE) AS quarter,
    year(PERIODE) AS year, {_D_LAGS},
    CASE WHEN count(cas) OVER w3 = 3 THEN avg(cas) OVER w3 END AS rolling_mean_3,
    CASE WHEN count(cas) OVER w6 = 6 THEN avg(cas) OVER w6 END AS rolling_mean_6,
    cas - lag(cas, 1) OVER w AS diff_1
  FROM merged
  WINDOW w AS (PARTITION BY DISTRICT ORDER BY PERIODE),
         w3 AS (PARTITION BY DISTRICT ORDER BY PERIODE ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
         w6 AS (PARTITION BY DISTRICT ORDER BY PERIODE ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))"""

CLIMATOLOGY = f"clim AS (SELECT DRS, month(PERIODE) AS month, {avg_all()} FROM panel GROUP BY ALL)"

# twelve months after the last month on record, for every region
AHEAD = """
bounds AS (SELECT min(PERIODE) AS first_month, max(PERIODE) AS last_month FROM panel),
ahead AS (
  SELECT DRS, CAST(last_month + to_months(CAST(k AS INTEGER)) AS DATE) AS PERIODE, k AS h
  FROM (SELECT DISTINCT DRS FROM panel), bounds, range(1, 13) r(k))"""

# one rule for every recursive check
RULE_TERMS = (
    ("target_lag_1", 0.4),
    ("target_roll_mean_3", 0.3),
    ("target_lag_12", 0.2),
    ("precipitation", 0.05),
    ("humidite", -0.02),
    ("month_cos", 0.5),
)
RULE_INTERCEPT = 0.25


def rule_sql(terms: dict[str, str]) -> str:
    """The rule with each feature name replaced by SQL text."""
    return " + ".join([str(RULE_INTERCEPT)] + [f"({w}) * ({terms[n]})" for n, w in RULE_TERMS])


def rule_on_columns() -> str:
    return f"greatest(0.0, {rule_sql({n: n for n, _ in RULE_TERMS})})"


FULL_MEAN_3 = "(r.hist[-3] + r.hist[-2] + r.hist[-1]) / 3"
PARTIAL_MEAN_3 = "list_sum(list_slice(r.hist, -3, -1)) / least(3, len(r.hist))"


NO_WEATHER = " OR ".join(f"f.{w} IS NULL" for w in W)


def recursion(future: str, tag: str = "", mean: str = FULL_MEAN_3, partial: bool = False, expect: str = "",
              line: str = "") -> str:
    """CTEs from ``start`` to ``answered`` from ``future`` (DRS, [tag], PERIODE, h, measures).

    ``checked`` names what is wrong with a request, ``made`` recurses over the
    fine ones, ``answered`` has every month asked for: (DRS, [tag], PERIODE, h,
    prediction, problem).  State is the list of targets before the first month.
    ``partial`` needs no year of history, but the rule's longest lag does.
    ``expect`` is a column of ``future``: how many months there should be.
    ``line`` is a CTE with one row (a, b); the step is then a + b * last value.
    """
    t = f", {tag}" if tag else ""
    ft = f", f.{tag}" if tag else ""
    rt = f", r.{tag}" if tag else ""
    match = f" AND f.{tag} = r.{tag}" if tag else ""
    terms = {
        "target_lag_1": "r.hist[-1]", "target_lag_12": "r.hist[-12]", "target_roll_mean_3": mean,
        "precipitation": "f.precipitation", "humidite": "f.humidite",
        "month_cos": "cos(2.0 * pi() * month(f.PERIODE) / 12.0)",
    }
    short = ("WHEN k.n < 12 THEN 'missing feature values'" if partial else
             "WHEN k.n < 12 THEN 'at least 12 months of history are required, found ' || k.n")
    value, beside = (f"{line}.a + {line}.b * r.hist[-1]", f", {line}") if line else (rule_sql(terms), "")
    wanted = f" WHEN r.n <> r.{expect} THEN 'missing months'" if expect else ""
    return f"""
requested AS (
  SELECT DRS{t}, min(PERIODE) AS first_month, max(PERIODE) AS last_month, count(*) AS n,
         count(DISTINCT PERIODE) AS months, bool_or({NO_WEATHER}) AS empty{f", any_value({expect}) AS {expect}" if expect else ""}
  FROM {future} f GROUP BY ALL),
known AS (
  SELECT r.DRS{rt}, count(p.PERIODE) AS n, list(p.cas ORDER BY p.PERIODE) AS hist
  FROM requested r LEFT JOIN panel p ON p.DRS = r.DRS AND p.PERIODE < r.first_month GROUP BY ALL),
checked AS (
  SELECT r.DRS{rt}, CASE WHEN r.DRS NOT IN (SELECT DRS FROM panel) THEN 'unknown series'
    WHEN r.months < r.n THEN 'repeated months'
    WHEN r.n < date_diff('month', r.first_month, r.last_month) + 1 THEN 'missing months'
    {short} WHEN r.empty THEN 'missing feature values'{wanted} END AS problem
  FROM requested r JOIN known k ON k.DRS = r.DRS{f" AND k.{tag} = r.{tag}" if tag else ""}),
start AS (
  SELECT r.DRS{rt}, r.hist FROM known r JOIN checked f ON f.DRS = r.DRS{match} WHERE f.problem IS NULL),
rec AS (
  SELECT DRS{t}, CAST(0 AS BIGINT) AS h, CAST(NULL AS DATE) AS PERIODE, hist FROM start
  UNION ALL
  SELECT r.DRS{rt}, r.h + 1, f.PERIODE, list_append(r.hist, greatest(0.0, {value}))
  FROM rec r JOIN {future} f ON f.DRS = r.DRS{match} AND f.h = r.h + 1{beside}),
made AS (SELECT DRS{t}, PERIODE, h, hist[-1] AS prediction FROM rec WHERE h > 0),
answered AS (
  SELECT f.DRS{ft}, f.PERIODE, f.h, m.prediction, r.problem
  FROM {future} f JOIN checked r ON f.DRS = r.DRS{match}
  LEFT JOIN made m ON m.DRS = f.DRS{f" AND m.{tag} = f.{tag}" if tag else ""} AND m.h = f.h)"""
