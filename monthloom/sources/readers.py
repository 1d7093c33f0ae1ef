"""Readers for weather, surveillance, geo-point and history tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthloom.functions import calendar as cal
from monthloom.operators.validate import require_columns
from monthloom.spec import PanelSpec

# Delimiters an imported file may use.
DELIMITERS = (",", ";", "\t", "|")


def weather_schema(spec: PanelSpec, keys: tuple[str, ...] = ("DRS", "DISTRICT"), month_type: T.DataType | None = None) -> T.StructType:
    fields = [T.StructField(k, T.StringType()) for k in keys]
    fields.append(T.StructField(spec.time, month_type or T.StringType()))
    fields += [T.StructField(m, T.DoubleType()) for m in spec.exog]
    return T.StructType(fields)


GEO_POINTS = T.StructType([
    T.StructField("region", T.StringType()),
    T.StructField("departement", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("adresse", T.StringType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """CSV with a header and a stated schema: no inference pass over the data."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_geo_points(spark: SparkSession, path: str) -> DataFrame:
    """Point table: quoted commas, possibly line breaks in an address, byte-order mark."""
    return (
        spark.read.schema(GEO_POINTS).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    )


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter that splits the header line into most parts; reads one line."""
    first = spark.read.text(path).limit(1).collect()
    header = first[0][0] if first else ""
    return max(DELIMITERS, key=header.count)


def read_number(c: str) -> Column:
    """A number with a decimal point or comma; empty is null, anything else fails the job and is named."""
    text = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    plain = F.when(text.rlike(r"^[^.,]*,[^.,]*$"), F.replace(text, F.lit(","), F.lit("."))).otherwise(text)
    return cal.or_fail(plain.try_cast("double"), text, f"number in {c}")


def read_weather_import(
    spark: SparkSession, path: str, spec: PanelSpec, only: str | None = None
) -> DataFrame:
    """Weather file of unknown delimiter with padded headers.

    A key column is optional; with ``only`` its other values are left out.
    Months are set to their first day.  Cells that hold no number or month
    fail the job.
    """
    sep = sniff_delimiter(spark, path)
    raw = trim_headers(spark.read.option("header", True).option("sep", sep).csv(path))
    require_columns(raw, [spec.time], "weather file")
    require_columns(raw, spec.exog, "weather file")
    key = spec.series[0]
    keyed = key in raw.columns
    if keyed and only is not None:
        raw = raw.filter(F.trim(F.col(key)) == only)
    order = ([F.trim(F.col(key)).alias(key)] if keyed else [])
    return raw.select(
        *order,
        cal.month_start(F.trim(F.col(spec.time)).cast("timestamp")).alias(spec.time),
        *[read_number(m).alias(m) for m in spec.exog],
    ).orderBy(*([key] if keyed else []), spec.time)


def load_history(spark: SparkSession, path: str, spec: PanelSpec) -> DataFrame:
    """Panel with month dates, clustered by series and sorted inside a partition.

    Windows by series find their rows in place and need no exchange.
    """
    df = spark.read.parquet(path)
    require_columns(df, [*spec.keys, spec.target], "history")
    return (
        df.withColumn(spec.time, cal.month_start(spec.time))
        .repartition(*spec.series)
        .sortWithinPartitions(*spec.keys)
    )
