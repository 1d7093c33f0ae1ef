"""The epsilon-insensitive line against its own loss all around, in both versions, and the kernel's features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.operators import convex, estimators
from monthloom.operators.estimators import EpsilonRegression
from tests.expressions import expression_size


def points(seed, n, d):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d))
    return x, x @ draw.normal(size=d) + 3 + draw.standard_t(2, size=n)


def loss(w, x, y, cost, epsilon):
    return (w[:-1] ** 2).sum() / 2 + cost * np.maximum(np.abs(x @ w[:-1] + w[-1] - y) - epsilon, 0).sum()


@pytest.mark.parametrize("n, d, cost, epsilon", [(200, 3, 1.0, 0.1), (300, 6, 0.1, 0.5), (60, 1, 10.0, 0.0), (400, 20, 5.0, 0.2), (40, 2, 1.0, 50.0)])
def test_no_point_nearby_is_better(n, d, cost, epsilon):
    x, y = points(n, n, d)
    whole = np.c_[x, np.ones(n)]
    w = convex.minimise(convex.local_sums(whole, y, epsilon), d + 1, cost, y.std())
    best, draw = loss(w, x, y, cost, epsilon), np.random.default_rng(1)
    for size in 10.0 ** -np.arange(1, 7):
        for _ in range(200):
            assert loss(w + size * draw.normal(size=d + 1), x, y, cost, epsilon) >= best - 1e-9 * (1 + best)


def test_best_line_goes_through_two_corners():
    """Brute force over all lines through two points moved by epsilon."""
    x, y = points(7, 25, 1)
    w = convex.minimise(convex.local_sums(np.c_[x, np.ones(25)], y, 0.3), 2, 50.0, y.std())
    corners = [(a, b + s) for a, b in zip(x[:, 0], y) for s in (-0.3, 0.3)]
    lines = [((q - b) / (p - a), b - (q - b) / (p - a) * a) for k, (a, b) in enumerate(corners) for p, q in corners[:k] if p != a]
    brute = min(lines, key=lambda v: loss(np.array(v), x, y, 50.0, 0.3))
    assert w == pytest.approx(brute, abs=1e-6)


def frame(spark, x, y):
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, label double").repartition(3)
    return rows.select(array_to_vector("x").alias("features"), "label", "x")


def test_sums_by_spark_give_the_same_line(spark, monkeypatch):
    x, y = points(5, 60, 2)
    x[:, 1] = x[:, 1] > 0  # zeros are left out of the sums
    local = EpsilonRegression(epsilon=0.2, cost=2.0).fit(frame(spark, x, y))
    monkeypatch.setattr(estimators.trees, "SMALL_CELLS", 0)
    shared = EpsilonRegression(epsilon=0.2, cost=2.0).fit(frame(spark, x, y))
    assert shared.getOrDefault("coefficients") == pytest.approx(local.getOrDefault("coefficients"), abs=1e-6)
    assert shared.getOrDefault("intercept") == pytest.approx(local.getOrDefault("intercept"), abs=1e-6)
    made = shared.transform(frame(spark, x, y)).select("x", "prediction").collect()
    w = np.array(shared.getOrDefault("coefficients"))
    assert all(r.prediction == pytest.approx(np.dot(w, r.x) + shared.getOrDefault("intercept")) for r in made)


def test_random_features_approach_the_kernel(spark):
    x, _ = points(6, 30, 4)
    frequencies, phases = estimators.kernel_map(4, 4000, 0.2, 42)
    z = estimators._with_kernel(x, frequencies, phases)[:, :-1]
    exact = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.1 and np.abs(z @ z.T - exact).mean() < 0.02
    few = estimators.kernel_map(4, 16, 0.2, 42)
    rows = frame(spark, x, x[:, 0]).select("x", estimators.kernel_features(F.col("x"), *few).alias("z")).collect()
    for r in rows:
        assert r.z == pytest.approx(estimators._with_kernel(np.array([r.x]), *few)[0, :-1])


def test_expression_of_the_kernel_does_not_grow_with_its_features(spark):
    x, _ = points(6, 10, 4)
    rows, sizes = frame(spark, x, x[:, 0]), []
    for m in (3, 150):
        expression = rows.select(estimators.kernel_features(F.col("x"), *estimators.kernel_map(4, m, 0.2, 42)))
        sizes.append(expression_size(expression))
    assert sizes[0] == sizes[1] < 100


def test_kernel_fits_what_no_line_can(spark):
    draw = np.random.default_rng(8)
    x = draw.uniform(-2, 2, size=(300, 2))
    y = np.sin(2 * x[:, 0]) * x[:, 1]
    rows = frame(spark, x, y)
    errors = {}
    for gamma in (0.0, 1.0):
        model = EpsilonRegression(epsilon=0.02, cost=10.0, gamma=gamma, kernelSize=120).fit(rows)
        errors[gamma] = model.transform(rows).agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    assert errors[1.0] < errors[0.0] / 4


def test_too_many_columns_and_no_rows(spark, monkeypatch):
    x, y = points(9, 20, 3)
    with pytest.raises(ValueError, match="no rows"):
        EpsilonRegression().fit(frame(spark, x, y).limit(0))
    monkeypatch.setattr(estimators.trees, "SMALL_CELLS", 0)
    monkeypatch.setattr(convex, "MOST_COLUMNS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        EpsilonRegression().fit(frame(spark, x, y))
