"""Random panels with gaps, and plain pandas answers to compare with."""

import datetime as dt

import numpy as np
import pandas as pd

from monthloom.functions.fixed import WEATHER_COLUMNS
from monthloom.spec import PanelSpec

SPEC = PanelSpec()
W = list(WEATHER_COLUMNS)


def months(start, n):
    return [d.date() for d in pd.date_range(start, periods=n, freq="MS")]


def random_panel(seed=0, series=6, n=40, gap=0.1, null_target=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(series):
        for m in months("2015-01-01", n):
            if rng.random() < gap:
                continue
            y = None if rng.random() < null_target else float(rng.integers(0, 60))
            rows.append((f"DRS {chr(65 + i)}", m, y, *[float(v) for v in rng.uniform(0, 100, 7).round(2)]))
    # one series with a single row
    rows.append(("DRS Z", dt.date(2015, 3, 1), 5.0, *[1.0] * 7))
    return pd.DataFrame(rows, columns=["DRS", "PERIODE", "cas", *W])


SCHEMA = "DRS string, PERIODE date, cas double, " + ", ".join(f"{w} double" for w in W)


def to_spark(spark, pdf):
    data = [tuple(None if pd.isna(v) else v for v in row) for row in pdf.itertuples(index=False)]
    return spark.createDataFrame(data, SCHEMA)


def pandas_features(pdf):
    out = []
    for _, g in pdf.sort_values(["DRS", "PERIODE"]).groupby("DRS", sort=True):
        g = g.copy()
        y = g["cas"].astype(float)
        for k in SPEC.lags:
            g[f"target_lag_{k}"] = y.shift(k)
        for n in SPEC.rolls:
            g[f"target_roll_mean_{n}"] = y.shift(1).rolling(n).mean()
        out.append(g)
    return pd.concat(out, ignore_index=True)


def rule_value(past, row, month, weights, intercept):
    """The rule on a list of past targets and one row of measures."""
    values = dict(row)
    for k in SPEC.lags:
        values[f"target_lag_{k}"] = past[-k]
    for n in SPEC.rolls:
        values[f"target_roll_mean_{n}"] = sum(past[-n:]) / n
    values["month"] = month
    return intercept + sum(w * values[f] for f, w in weights.items())


def brute_forecast(history, future, weights, intercept):
    """Month by month, series by series."""
    out = []
    for key, rows in future.sort_values("PERIODE").groupby("DRS"):
        start = rows["PERIODE"].min()
        known = history[(history["DRS"] == key) & (history["PERIODE"] < start)].sort_values("PERIODE")
        past = known["cas"].tolist()
        for _, row in rows.iterrows():
            value = max(0.0, rule_value(past, row, row["PERIODE"].month, weights, intercept))
            past.append(value)
            out.append((key, row["PERIODE"], value))
    return {(k, p): v for k, p, v in out}


# Region centroid (latitude, longitude).
REGION_CENTROIDS = {
    "DRS Dakar": (14.72, -17.45),
    "DRS Diourbel": (14.66, -16.23),
    "DRS Fatick": (14.34, -16.41),
    "DRS Kaffrine": (14.11, -15.55),
    "DRS Kaolack": (14.15, -16.07),
    "DRS Kedougou": (12.55, -12.18),
    "DRS Kolda": (12.89, -14.94),
    "DRS Louga": (15.62, -16.22),
    "DRS Matam": (15.66, -13.26),
    "DRS Saint-Louis": (16.03, -16.49),
    "DRS Sedhiou": (12.71, -15.56),
    "DRS Tambacounda": (13.77, -13.67),
    "DRS Thies": (14.79, -16.93),
    "DRS Ziguinchor": (12.58, -16.27),
}

# Marker colour of each region, and the one for any other.
REGION_COLOURS = {
    "Dakar": "red",
    "Diourbel": "blue",
    "Fatick": "green",
    "Kaffrine": "purple",
    "Kaolack": "orange",
    "Kedougou": "darkred",
    "Kolda": "darkblue",
    "Louga": "cadetblue",
    "Matam": "pink",
    "Saint-Louis": "gray",
    "Sedhiou": "lightgreen",
    "Tambacounda": "beige",
    "Thies": "darkgreen",
    "Ziguinchor": "darkpurple",
}
OTHER_COLOUR = "blue"
