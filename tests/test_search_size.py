"""Registered searches run whole: every point over five folds, and the training task of all learners."""

import json

import pytest

from monthloom.operators import learn
from monthloom.plans import learning
from monthloom.plans.catalogue import QUERIES
from tests.conftest import SF_DIR


@pytest.mark.parametrize("name, n", [("M8_forest", 192), ("M9_forest", 40)])
def test_searches_try_every_point(spark, quick_tables, name, n):
    rows = QUERIES[name](spark, SF_DIR).collect()
    tried = {r["params"] for r in rows}
    assert len(rows) == len(tried) == n and all(set(json.loads(p)) == set(learn.FOREST.space) for p in tried)
    assert all(r["rmse"] > 0 for r in rows) and [r["rmse"] for r in rows if r["best"]] == [min(r["rmse"] for r in rows)]


def test_single_fits_have_the_sizes_of_the_spaces():
    for learner, params in (learning.WHOLE_FOREST, learning.WHOLE_BOOSTING):
        assert params[learner.size] == max(learner.space[learner.size])


def test_training_draws_as_many_points_as_stated(spark, quick_tables, monkeypatch):
    asked, drawn = [], learn.random_points

    def counted(space, n):
        points = drawn(space, n)
        asked.append((next(l.name for l in learn.LEARNERS if l.space is space), len(points)))
        return points

    monkeypatch.setattr(learn, "random_points", counted)
    rows = QUERIES["M11_training"](spark, SF_DIR).collect()
    assert asked == [("forest", 40), ("boosting", 80), ("leafwise", 80), ("symmetric", 40), ("epsilon", 40)]
    assert {r["model"] for r in rows} == {n for n, _ in asked} and all(r["error"] is None for r in rows)
    assert [r["best"] for r in rows] == [True, False, False, False, False]
