"""Histogram trees: both versions against each other and against plain search."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.functions import maths
from monthloom.operators import trees
from monthloom.operators.trees import Growth
from tests.expressions import expression_size


def some_rows(seed=1, n=400):
    draw = np.random.default_rng(seed)
    x = np.stack([draw.integers(1, 13, n), draw.integers(0, 6, n), draw.integers(0, 2, n)], axis=1).astype(float)
    y = np.round(10 * np.sin(x[:, 0]) + 3 * x[:, 1] * x[:, 2] + draw.normal(size=n), 3)
    return x, y


def table(spark, x, y):
    return spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, label double").repartition(3)


GROWTHS = [
    Growth(rounds=3, depth=2, l1=0.0, l2=1.0, step=0.3),
    Growth(rounds=2, depth=3, l1=25.0, l2=0.5, step=1.0),
    Growth(rounds=2, depth=0, leaves=7, l1=2.0, step=0.5, least_rows=5),
    Growth(rounds=2, depth=3, leaves=6, l2=0.0),
    Growth(rounds=3, depth=2, symmetric=True, l2=3.0, step=0.4),
    Growth(rounds=2, depth=3, least_gain=400.0),
    Growth(rounds=0), Growth(rounds=1, depth=4, l1=1e9),
]


@pytest.mark.parametrize("how", GROWTHS)
def test_both_versions_grow_the_same_trees(spark, how):
    x, y = some_rows()
    a, b = trees.boost_arrays(x, y, how), trees.boost_spark(table(spark, x, y), how)
    whole = b.base + trees.predict_arrays(x, b).sum(axis=0)
    assert np.allclose(a.base + trees.predict_arrays(x, a).sum(axis=0), whole)
    rows = table(spark, x, y).select("x", trees.predicted(F.col("x"), b).alias("p")).collect()
    known = {tuple(r): p for r, p in zip(x.tolist(), whole)}
    assert all(abs(r.p - known[tuple(r.x)]) < 1e-9 for r in rows)


def soft(g, l1):
    return np.sign(g) * max(abs(g) - l1, 0)


def worth(r, how):
    return soft(-r.sum(), how.l1) ** 2 / (len(r) + how.l2)


def plain_tree(x, r, how, level=0):
    """Residuals to predictions by trying every cut."""
    found = []
    for k in range(x.shape[1]) if level < how.depth else ():
        for c in np.unique(x[:, k])[:-1]:
            low = x[:, k] <= c
            found.append((worth(r[low], how) + worth(r[~low], how) - worth(r, how), -k, -c))
    if not found or max(found)[0] <= how.least_gain:
        return np.full(len(r), -soft(-r.sum(), how.l1) / (len(r) + how.l2))
    _, k, c = max(found)
    low, out = x[:, -k] <= -c, np.zeros(len(r))
    for side in (low, ~low):
        out[side] = plain_tree(x[side], r[side], how, level + 1)
    return out


@pytest.mark.parametrize("how", GROWTHS[:2])
def test_trees_by_level_are_those_of_a_plain_search(how):
    x, y = some_rows(2)
    score = np.full(len(y), y.mean())
    for _ in range(how.rounds):
        score += how.step * plain_tree(x, y - score, how)
    found = trees.boost_arrays(x, y, how)
    assert np.allclose(found.base + trees.predict_arrays(x, found).sum(axis=0), score)


def test_symmetric_trees_have_one_cut_for_a_level():
    x, y = some_rows(3)
    how = Growth(rounds=1, depth=2, symmetric=True, l2=0.0, step=1.0)
    cuts = [(k, c) for k in range(3) for c in np.unique(x[:, k])[:-1]]

    def total(chosen):
        cells = {}
        for row, r in zip(x, y - y.mean()):
            cells.setdefault(tuple(row[k] > c for k, c in chosen), []).append(r)
        return sum(np.sum(v) ** 2 / len(v) for v in cells.values())

    first = max(cuts, key=lambda c: total([c]))
    second = max(cuts, key=lambda c: total([first, c]))
    found = trees.boost_arrays(x, y, how)
    used = {(found.column[k], found.threshold[k]) for k in range(len(found.value)) if found.column[k] >= 0}
    assert used == {first, second}


def test_best_leaf_first_has_as_many_leaves_as_asked():
    x, y = some_rows(4)
    sizes = [sum(c < 0 for c in trees.boost_arrays(x, y, Growth(rounds=1, depth=0, leaves=n)).column) for n in (1, 2, 7, 31)]
    assert sizes == [1, 2, 7, 31]


def test_shorter_ensembles_are_the_beginning_of_longer_ones():
    x, y = some_rows(5)
    long = trees.boost_arrays(x, y, Growth(rounds=9, row_share=0.7, columns=0.5))
    short = trees.boost_arrays(x, y, Growth(rounds=4, row_share=0.7, columns=0.5))
    assert np.allclose(trees.predict_arrays(x, long.first(4)), trees.predict_arrays(x, short))
    forest, less = (trees.forest_arrays(x, y, Growth(rounds=n, depth=6)) for n in (45, 20))
    assert np.allclose(trees.predict_arrays(x, forest.first(20)), trees.predict_arrays(x, less))
    errors = [np.mean((trees.predict_arrays(x, f).mean(axis=0) - y) ** 2) for f in (forest, less)]
    assert max(errors) < np.var(y) / 4


def test_sampled_rows_and_columns(spark):
    x, y = some_rows(6)
    how = Growth(rounds=12, depth=3, step=0.3, row_share=0.6, columns=0.5)
    for found in (trees.boost_arrays(x, y, how), trees.boost_spark(table(spark, x, y), how)):
        assert np.mean((found.base + trees.predict_arrays(x, found).sum(axis=0) - y) ** 2) < np.var(y) / 3


def test_json_keeps_all():
    x, y = some_rows(7)
    found = trees.boost_arrays(x, y, Growth(rounds=2))
    assert trees.Trees.from_json(found.to_json()) == found
    assert len(trees.node_rows(found)) == len(found.value)


def test_edges_are_values(spark):
    x, y = some_rows(8)
    local = trees.edges_of(x, 64)
    assert [list(e) for e in local] == trees.edges(table(spark, x, y), 3, 64)
    assert all(v in x[:, k] for k, e in enumerate(local) for v in itertools.islice(e, 5))


def test_expression_of_a_prediction_does_not_grow_with_the_trees(spark):
    x, y = some_rows(n=40)
    rows = table(spark, x, y)
    few, many = (trees.boost_arrays(x, y, Growth(rounds=n, depth=3)) for n in (2, 300))
    assert len(few.value) < 100 < 2000 < len(many.value)
    scored = [rows.select("x", trees.predicted(F.col("x"), made).alias("p")) for made in (few, many)]
    assert expression_size(scored[0]) == expression_size(scored[1]) < 100
    known = dict(zip(map(tuple, x.tolist()), (many.base + trees.predict_arrays(x, many).sum(axis=0)).tolist()))
    assert all(r.p == pytest.approx(known[tuple(r.x)], abs=1e-9) for r in scored[1].collect())


def test_a_row_without_values_has_no_prediction(spark):
    x, y = some_rows(n=40)
    made = trees.boost_arrays(x, y, Growth(rounds=2, depth=2))
    rows = spark.createDataFrame([(None,), ([1.0, None, 0.0],), ([1.0, 2.0, 0.0],)], "x array<double>")
    found = [r.p for r in rows.select(trees.predicted(F.col("x"), made).alias("p")).collect()]
    assert found[0] is None and found[2] == pytest.approx(made.base + trees.predict_arrays(np.array([[1.0, 2.0, 0.0]]), made).sum())


def test_constants_are_the_numbers_themselves(spark):
    numbers = [0.1, 1 / 3, -0.0, 5e-324, 1.7976931348623157e308, 123456789.123456789, float("inf"), float("-inf"), 2.0]
    row = spark.range(1).select(
        maths.constant(numbers, "array<double>").alias("a"), maths.constant([numbers, []], "array<array<double>>").alias("b"),
        maths.constant([-1, 0, 2**31 - 1], "array<int>").alias("c"), maths.constant([], "array<int>").alias("d")).first()
    assert list(map(repr, row.a)) == list(map(repr, numbers)) and list(map(repr, row.b[0])) == list(map(repr, numbers))
    assert (row.b[1], row.c, row.d) == ([], [-1, 0, 2**31 - 1], [])
    many = np.random.default_rng(3).normal(scale=1e5, size=5000).tolist()
    assert spark.range(1).select(maths.constant(many, "array<double>").alias("a")).first().a == many
