"""The partial-mean forecast over the whole panel, with gaps, and with short series."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql
from monthloom.plans import tables
from monthloom.plans.catalogue import QUERIES
from tests.conftest import SF_DIR
from tests.oracle import connect, difference, spark_rows, sql_rows

SMALL = "/root/testdata/sf0.001"
SHORT = """
short_panel AS (SELECT * FROM panel WHERE NOT regexp_matches(DRS, '[02468]$')
  OR PERIODE > (SELECT max(PERIODE) FROM panel) - INTERVAL 8 MONTH),"""


@pytest.fixture
def short_series(spark, monkeypatch):
    """A panel in which half the series are known for the last eight months only."""
    panel = tables.panel_once(spark, SF_DIR)
    short = panel.filter((F.col("PERIODE") > F.add_months(panel.agg(F.max("PERIODE")).scalar(), -8)) | ~F.col("DRS").rlike("[02468]$"))
    assert short.count() < panel.count()
    monkeypatch.setattr(tables, "panel_once", lambda spark, d: short)


def short_sql(sql: str) -> str:
    """The SQL over the shortened panel."""
    at = sql.index("panel AS (") + sql[sql.index("panel AS ("):].index("GROUP BY DRS, PERIODE)") + len("GROUP BY DRS, PERIODE),")
    rest = sql[at:].replace("FROM panel", "FROM short_panel").replace("JOIN panel", "JOIN short_panel")
    return sql[:at] + SHORT + rest


def test_whole_panel(spark, duck):
    found = spark_rows(QUERIES["T17"](spark, SF_DIR))
    assert difference(found, sql_rows(duck, oracle_sql()["T17"])) == ""
    panel = tables.panel_once(spark, SF_DIR)
    assert len(found[1]) == 12 * panel.select("DRS").distinct().count()


def test_whole_panel_with_gaps(spark):
    assert difference(spark_rows(QUERIES["T17"](spark, SMALL)), sql_rows(connect(SMALL), oracle_sql()["T17"])) == ""


def test_short_series(spark, duck, short_series):
    assert difference(spark_rows(QUERIES["T17"](spark, SF_DIR)), sql_rows(duck, short_sql(oracle_sql()["T17"]))) == ""
