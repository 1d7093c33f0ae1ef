"""The given order tables read as surveillance and weather tables.

An order is a case, its customer's nation a region (``DRS``), nation and
market segment together a ``DISTRICT``; line items carry the seven measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.functions import calendar as cal
from monthloom.operators.aggregate import build_panel
from monthloom.operators.joins import left_by_keys
from monthloom.session import written
from monthloom.spec import REGION, PanelSpec

MERGE_KEYS = ["DRS", "PERIODE", "DISTRICT"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer key with its region and district."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.concat(F.lit("DRS "), "n_name").alias("DRS"),
        F.concat("n_name", F.lit(" / "), "c_mktsegment").alias("DISTRICT"),
    )


def surveillance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases per (region, district, month).

    Orders shrink to one row per customer and month before they meet the
    customers, so a customer with very many orders cannot make the join hot.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        cal.month_start("o_orderdate").alias("PERIODE"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0).alias("_urgent"),
    )
    per_customer = orders.groupBy("o_custkey", "PERIODE").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_urgent").alias("_u")
    )
    return (
        per_customer.join(places(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("DRS", "DISTRICT", "PERIODE")
        .agg(F.sum("_n").cast("double").alias("cas"), F.sum("_u").alias("tpi2"))
    )


def _mean(value: Column) -> Column:
    # whole numbers add up exactly in any order, so the mean does not depend on it
    return F.sum(value.cast("long")).cast("double") / F.count(value)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven measures per (region, district, month) of shipping.

    Orders find their place first; the line items then join once, and the
    aggregate combines on the map side.  Both sides of that join grow with the
    data, so it is a merge join whatever the size of a file suggests.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    placed = orders.join(places(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "DRS", "DISTRICT"
    )
    # these products are whole numbers up to representation noise
    cents = F.rint(F.col("l_extendedprice") * 100)
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        cal.month_start("l_shipdate").alias("PERIODE"),
        cents.alias("cents"),
        F.col("l_quantity").alias("quantity"),
        F.rint(F.col("l_discount") * 1000).alias("discount"),
        F.rint(F.col("l_tax") * 100).alias("tax"),
        F.col("l_linenumber").alias("line"),
    )
    return (
        lines.join(placed.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("DRS", "DISTRICT", "PERIODE")
        .agg(
            (_mean(F.col("cents")) / 100000).alias("temperature_moyenne"),
            (F.max("cents") / 100000).alias("temperature_max"),
            (F.min("cents") / 100000).alias("temperature_min"),
            _mean(F.col("quantity")).alias("precipitation"),
            _mean(F.col("discount")).alias("humidite"),
            _mean(F.col("tax")).alias("vent"),
            _mean(F.col("line")).alias("rayonnement_solaire"),
        )
    )


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surveillance with the weather of its district and month."""
    return left_by_keys(surveillance(spark, sf_dir), weather(spark, sf_dir), MERGE_KEYS)


def panel(spark: SparkSession, sf_dir: str, spec: PanelSpec = REGION) -> DataFrame:
    return build_panel(merged(spark, sf_dir), spec)


def panel_once(spark: SparkSession, sf_dir: str, spec: PanelSpec = REGION) -> DataFrame:
    """The panel as a written table, for queries that read it more than once.

    The panel is small next to the line items it comes from; writing it keeps
    a query at a single pass over them.
    """
    return written(panel(spark, sf_dir, spec), "panel")


def surveillance_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(surveillance(spark, sf_dir), "surveillance")


def weather_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(weather(spark, sf_dir), "weather")
