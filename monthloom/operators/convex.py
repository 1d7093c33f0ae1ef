"""Epsilon-insensitive linear regression by Newton steps on a smoothed loss.

Minimises ``|w|^2 / 2 + C * sum(max(0, |y - x w - b| - epsilon))``.  The corner of
the loss is rounded over a width that shrinks from the spread of the target to
``LAST_WIDTH`` of it; each width starts from the optimum of the one before.  A
step takes two passes over the rows: the gradient and the curvature, to which
only rows on the rounded part add, and then the loss at all lengths of the step
that are tried.  What reaches the driver is one number per pair of columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions import maths

LAST_WIDTH = 1e-8
SHRINK = 6.0
MOST_COLUMNS = 1500  # the curvature has a number for each pair
MOST_STEPS = 100     # for one width
LENGTHS = np.append(0.0, 2.0 ** -np.arange(-1, 32))

CORNER = 1e-4        # rows with an error so near to epsilon, against the spread, lie on the corner at the optimum

# gradient and curvature of the summed loss at a point (of a square loss on the corner rows, for the last step);
# its values at ``LENGTHS`` along a step
Slopes = Callable[[np.ndarray, float, bool], tuple[np.ndarray, np.ndarray]]
Values = Callable[[np.ndarray, np.ndarray, float], np.ndarray]


def smoothed(excess, width):
    """Value, slope and curvature of the rounded corner max(0, excess), for arrays."""
    inside = (excess > 0) & (excess < width)
    value = np.where(inside, excess * excess / (2 * width), np.maximum(excess - width / 2, 0))
    return value, np.clip(excess / width, 0, 1), inside / width


def local_sums(x: np.ndarray, y: np.ndarray, epsilon: float) -> tuple[Slopes, Values]:
    """Sums over arrays; the last column of ``x`` is the constant."""
    def slopes(w, width, corner=False):
        error = x @ w - y
        excess = np.abs(error) - epsilon
        _, slope, curve = smoothed(excess, width)
        if corner:
            curve = (np.abs(excess) < width).astype(float)
            slope = excess * curve
        rows = np.flatnonzero(curve)
        return x.T @ (slope * np.sign(error)), (x[rows].T * curve[rows]) @ x[rows]

    def values(w, step, width):
        error = (x @ w - y)[:, None] - (x @ step)[:, None] * LENGTHS
        return smoothed(np.abs(error) - epsilon, width)[0].sum(axis=0)

    return slopes, values


def score(weights: np.ndarray) -> Column:
    """The weighted sum of a row's columns."""
    held = maths.constant(weights.tolist(), "array<double>")
    return F.aggregate(F.zip_with("at", "x", lambda i, v: F.get(held, i) * v), F.lit(0.0), lambda a, v: a + v)


def spark_sums(rows: DataFrame, n: int, epsilon: float) -> tuple[Slopes, Values]:
    """Sums over (label, at, x): the places and values of the columns that are not zero in a row."""
    def slopes(w, width, corner=False):
        shaped = rows.withColumn("error", score(w) - F.col("label")).withColumn("excess", F.abs("error") - epsilon)
        if corner:
            shaped, slope, curve = shaped.filter(F.abs("excess") < width), F.col("excess"), F.lit(1.0)
        else:
            shaped, slope = shaped.filter("excess > 0"), F.least(F.lit(1.0), F.col("excess") / width)
            curve = F.when(F.col("excess") < width, F.lit(1.0 / width))
        shaped = shaped.select("at", "x", (F.signum("error") * slope).alias("slope"), curve.alias("curve"))
        pairs = F.flatten(F.zip_with("at", "x", lambda i, v: F.zip_with(
            "at", "x", lambda j, u: _sum(i, j, F.col("curve") * v * u))))
        parts = F.concat(F.zip_with("at", "x", lambda i, v: _sum(i, F.lit(-1), F.col("slope") * v)),
                         F.when(F.col("curve").isNotNull(), pairs).otherwise(F.array()))
        gradient, curvature = np.zeros(n), np.zeros((n, n))
        for r in shaped.select(F.inline(parts)).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            if r["j"] < 0:
                gradient[r["i"]] = r["v"]
            else:
                curvature[r["i"], r["j"]] = r["v"]
        return gradient, curvature

    def values(w, step, width):
        moves = rows.select((score(w) - F.col("label")).alias("error"), score(step).alias("move"))
        tried = F.array(*[F.lit(float(t)) for t in LENGTHS])
        excess = F.transform(tried, lambda t: F.abs(F.col("error") - F.col("move") * t) - epsilon)
        losses = F.transform(excess, lambda e: F.when(e >= width, e - width / 2).when(e > 0, e * e / (2 * width)).otherwise(0.0))
        found = moves.select(F.posexplode(losses).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
        return np.array([v for _, v in sorted((r["k"], r["v"]) for r in found)])

    return slopes, values


def _sum(i: Column, j: Column, v: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), v.cast("double").alias("v"))


def minimise(sums: tuple[Slopes, Values], n: int, cost: float, spread: float, intercept: bool = True) -> np.ndarray:
    """The best weights; the last is that of the constant and, with ``intercept``, costs nothing."""
    slopes, values = sums
    pull = np.ones(n)
    if intercept:
        pull[-1] = 0.0
    w, spread = np.zeros(n), spread or 1.0
    width = spread
    while True:
        for _ in range(MOST_STEPS):
            gradient, curvature = slopes(w, width)
            gradient = pull * w + cost * gradient
            # a constant without rows on the rounded part has no curvature of its own: it moves by the spread at most
            step = np.linalg.solve(np.diag(pull + np.abs(gradient) * (1 - pull) / spread + 1e-12) + cost * curvature, gradient)
            points = w - LENGTHS[:, None] * step
            found = (pull * points * points).sum(axis=1) / 2 + cost * values(w, step, width)
            best = int(found.argmin())
            if found[0] - found[best] <= 1e-16 * abs(found[0]):
                break
            w = points[best]
        if width <= LAST_WIDTH * spread:
            break
        width = max(width / SHRINK, LAST_WIDTH * spread)
    # the rows on the corner determine the optimum: put them there exactly, if that is no worse
    gradient, curvature = slopes(w, CORNER * spread, True)
    step = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
    points = w - LENGTHS[:, None] * step
    found = (pull * points * points).sum(axis=1) / 2 + cost * values(w, step, 1e-15 * spread)
    full = int(np.flatnonzero(LENGTHS == 1.0)[0])
    return points[full] if found[full] <= found[0] else w
