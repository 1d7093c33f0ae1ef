"""Every registered query against its SQL on whole tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from monthloom.plans import catalogue
from tests.conftest import SF_DIR
from tests.oracle import connect, difference, spark_rows, sql_rows

# the queries of the training-data subpackage have tests of their own
QUERIES = {n: q for n, q in queries().items() if n in catalogue.QUERIES}
ORACLES = {n: q for n, q in oracle_sql().items() if n in QUERIES}
# fitted models and checks without data: rows and ranges only
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))
SEARCHES = {"M8_forest", "M9_forest", "M11_training"}  # run whole in test_search_size


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    expected = {
        **{"S": 14, "P": 20, "J": 15, "A": 26, "W": 10, "O": 4, "U": 3, "F": 18, "T": 25, "M": 15},
    }
    missing = [f"{k}{i}" for k, n in expected.items() for i in range(1, n + 1) if f"{k}{i}" not in QUERIES]
    assert missing == []


@pytest.mark.parametrize("name", ["J1", "A1", "S2"])
def test_from_raw_tables(spark, duck, name):
    assert difference(spark_rows(QUERIES[name](spark, SF_DIR)), sql_rows(duck, ORACLES[name])) == ""


@pytest.mark.parametrize("name", ["J11", "T7", "T9", "T14", "T17", "T18", "T21", "A18", "M12"])
def test_small_tables_with_gaps(spark, name):
    """Series with missing months and short histories, in the smallest tables."""
    small = os.path.join(os.path.dirname(SF_DIR), "sf0.001")
    assert difference(spark_rows(QUERIES[name](spark, small)), sql_rows(connect(small), ORACLES[name])) == ""


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"J1", "A1", "S2"}))
def test_matches_sql(spark, duck, quick_tables, name):
    assert difference(spark_rows(QUERIES[name](spark, SF_DIR)), sql_rows(duck, ORACLES[name])) == ""


def test_every_id_has_sql():
    assert [n for n in ROWS_ONLY if "_" not in n] == []


@pytest.mark.parametrize("name", [n for n in ROWS_ONLY if n not in SEARCHES])
def test_has_rows(spark, quick_tables, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_boosting_beats_the_seasonal_naive_forecast(spark, quick_tables):
    row = QUERIES["M6_boosting"](spark, SF_DIR).first()
    assert row["rmse"] < row["naive_rmse"]
