"""Model folders and the append-only table of training runs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_SCHEMA = T.StructType([
    T.StructField("district", T.StringType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("trained_at", T.StringType()),
    T.StructField("training_rows", T.LongType()),
    T.StructField("version", T.StringType()),
    T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("features", T.ArrayType(T.StringType())),
])


@dataclass
class StoredModel:
    model: PipelineModel
    features: list[str]
    history: DataFrame


def save_model(spark: SparkSession, path: str, model: PipelineModel, features: Sequence[str], history: DataFrame) -> str:
    """Fitted pipeline, its feature names and the history it forecasts from."""
    model.write().overwrite().save(f"{path}/model")
    rows = [(i, f) for i, f in enumerate(features)]
    spark.createDataFrame(rows, "position int, feature string").write.mode("overwrite").parquet(f"{path}/features")
    history.write.mode("overwrite").parquet(f"{path}/history")
    return path


def load_model(spark: SparkSession, path: str) -> StoredModel:
    """Parts of a stored model; a missing part is named in the error."""
    def part(name, read):
        try:
            return read(f"{path}/{name}")
        except Exception as error:
            raise FileNotFoundError(f"no usable {name} under {path}") from error

    names = part("features", spark.read.parquet).orderBy("position").select("feature")
    return StoredModel(
        part("model", PipelineModel.load),
        [r[0] for r in names.collect()],
        part("history", spark.read.parquet),
    )


def run_row(
    district: str, algorithm: str, rmse: float, training_rows: int, version: str,
    best_params: Mapping[str, object], features: Sequence[str], accuracy: float | None = None,
) -> tuple:
    return (
        district, algorithm, round(float(rmse), 4), accuracy, dt.date.today().isoformat(), int(training_rows),
        version, {k: str(v) for k, v in best_params.items()}, list(features),
    )


def append_run(spark: SparkSession, path: str, *args, **kwargs) -> DataFrame:
    """Append one run; earlier runs stay as they are."""
    df = spark.createDataFrame([run_row(*args, **kwargs)], RUN_SCHEMA)
    df.coalesce(1).write.mode("append").json(path)
    return df


def append_runs(runs: DataFrame, path: str) -> None:
    """Append many runs held in a DataFrame (one per series, say)."""
    have = set(runs.columns)
    filled = runs.withColumns({
        f.name: F.lit(None).cast(f.dataType) for f in RUN_SCHEMA.fields if f.name not in have
    })
    stamped = filled.withColumn("trained_at", F.coalesce("trained_at", F.date_format(F.current_date(), "yyyy-MM-dd")))
    stamped.select(*RUN_SCHEMA.fieldNames()).withColumn("rmse", F.bround("rmse", 4)).write.mode("append").json(path)


def write_batch(spark: SparkSession, path: str, runs: Sequence[tuple]) -> DataFrame:
    """Write the runs of one batch as a folder of their own."""
    df = spark.createDataFrame(list(runs), RUN_SCHEMA)
    df.write.mode("errorifexists").json(path)
    return df


def read_run_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Runs from documents that hold one object or an array of objects each.

    The schema is stated, so parameter names that differ between algorithms
    stay keys of a map instead of becoming columns.
    """
    return spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(list(paths))


def read_runs(spark: SparkSession, *paths: str) -> DataFrame:
    """Runs appended by this module: one object per line."""
    return spark.read.schema(RUN_SCHEMA).json(list(paths))


def best_runs(runs: DataFrame, by: str = "district") -> DataFrame:
    """Run with the smallest error per scope (largest accuracy where no error is recorded).

    An ordered minimum instead of a ranking: it combines before the shuffle,
    so a scope with very many runs needs no sort.
    """
    order = F.struct(
        F.col("rmse").isNull(), "rmse", F.col("accuracy").isNull(), -F.col("accuracy"), "algorithm",
        "version", "trained_at",
    )
    row = F.struct(*[c for c in runs.columns if c != by])
    return runs.groupBy(by).agg(F.min_by(row, order).alias("_best")).select(by, "_best.*")
