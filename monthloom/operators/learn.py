"""Regression models on feature frames: encoding, search, comparison, importance.

The data of every fit stays on the executors.  A search over a table of checked,
small size broadcasts it and runs the fits of all points and folds side by side,
one in each task; points that differ in the size of an ensemble share a fit.
Over larger tables the points are iterated on the driver, a few distributed fits
at a time from a thread pool.  Either way what comes back is one score per point
and fold.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthloom.functions import text
from monthloom.operators import estimators, evaluate, trees
from monthloom.operators.forecast import Rule
from monthloom.operators.split import expanding_folds, fold_parts
from monthloom.session import scratch_dir
from monthloom.shipping import ship
from monthloom.spec import PanelSpec

SEED = 42
KEY_LIMIT = 10_000

# Points tried by a random search, per learner.
RANDOM_POINTS = {"forest": 40, "boosting": 80, "leafwise": 80, "symmetric": 40, "epsilon": 40, "robust": 40}


# ------------------------------------------------------------------- encoding


def require_few_keys(df: DataFrame, key: str, limit: int = KEY_LIMIT) -> None:
    """One indicator per key needs a bounded number of keys."""
    found = df.agg(F.approx_count_distinct(key)).first()[0]
    if found > limit:
        raise ValueError(f"about {found} values of {key}: more than {limit} indicators; leave the key out")


def key_stages(key: str) -> list:
    """Indicator vector of a key; an unknown key becomes all zeros.

    ``keep`` sends unknown keys to one extra last index and ``dropLast`` turns
    exactly that index into zeros.
    """
    return [
        StringIndexer(inputCol=key, outputCol=f"{key}_index", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCol=f"{key}_index", outputCol=f"{key}_flags", dropLast=True),
    ]


def encoder(key: str | None, numeric: Sequence[str], scaled: bool = False) -> Pipeline:
    """Key indicators followed by the numeric columns, standardised if asked."""
    stages = key_stages(key) if key else []
    parts = [f"{key}_flags"] if key else []
    if scaled:
        stages.append(VectorAssembler(inputCols=list(numeric), outputCol="numbers", handleInvalid="error"))
        stages.append(StandardScaler(inputCol="numbers", outputCol="scaled_numbers", withMean=True, withStd=True))
        parts.append("scaled_numbers")
    else:
        parts += list(numeric)
    stages.append(VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="error"))
    return Pipeline(stages=stages)


def dummy_columns(df: DataFrame, column: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    """One 0/1 column per value in place of the column."""
    prefix = f"{column}_" if prefix is None else prefix
    return df.withColumns({
        f"{prefix}{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values
    }).drop(column)


def set_indicators(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """Dummy columns in long form: the name of the one that is set, for any number of values; none for null."""
    prefix = f"{column}_" if prefix is None else prefix
    return df.filter(F.col(column).isNotNull()).withColumn("indicator", F.concat(F.lit(prefix), column)).withColumn(
        "value", F.lit(1)).drop(column)


# ------------------------------------------------------------------- learners


@dataclass(frozen=True)
class Learner:
    """A way to build an estimator from parameters, and what to search.

    ``predictions`` fits arrays and predicts others, for all values of the
    parameter ``size`` at once; without it every point is a distributed fit.
    """

    name: str
    build: Callable[[Mapping], Estimator]
    space: Mapping[str, Sequence] = field(default_factory=dict, hash=False)
    scaled: bool = False
    predictions: Callable | None = None
    size: str | None = None


def _forest(params: Mapping) -> Estimator:
    return RandomForestRegressor(featuresCol="features", labelCol="label", seed=SEED, **params)


def _staged(params: Mapping) -> Estimator:
    return GBTRegressor(featuresCol="features", labelCol="label", seed=SEED, **params)


def _boosting(params: Mapping) -> Estimator:
    return estimators.HistogramBoosting(featuresCol="features", labelCol="label", seed=SEED, **params)


def _epsilon(params: Mapping) -> Estimator:
    return estimators.EpsilonRegression(featuresCol="features", labelCol="label", **params)


def _robust(params: Mapping) -> Estimator:
    return LinearRegression(featuresCol="features", labelCol="label", loss="huber", maxIter=50, tol=1e-4, **params)


def _line(params: Mapping) -> Estimator:
    """Least squares on one slot of the feature vector, solved exactly."""
    rest = {k: v for k, v in params.items() if k != "slot"}
    return Pipeline(stages=[
        VectorSlicer(inputCol="features", outputCol="chosen", indices=[params.get("slot", 0)]),
        LinearRegression(featuresCol="chosen", labelCol="label", solver="normal", **rest),
    ])


LINE = Learner("line", _line, {"slot": [0], "fitIntercept": [True, False]})
STAGED = Learner("staged", _staged)
FOREST = Learner("forest", _forest, {
    "numTrees": [20, 50, 100, 200],
    "maxDepth": [5, 10, 15],
    "minInstancesPerNode": [1, 2, 4, 8],
    "featureSubsetStrategy": ["sqrt", "log2", "0.5", "all"],
}, predictions=estimators.forest_predictions, size="numTrees")
_SHARED = {
    "maxIter": [50, 100, 200, 400],
    "stepSize": [0.01, 0.03, 0.05, 0.1],
    "subsamplingRate": [0.6, 0.8, 1.0],
    "featureSubsetStrategy": ["0.5", "0.8", "all"],
    "minInstancesPerNode": [1, 5, 10, 20],
    "l1": [0.0, 0.1, 1.0, 10.0],
    "l2": [0.0, 1.0, 5.0, 20.0],
}
_BOOSTED = {"predictions": estimators.boosting_predictions, "size": "maxIter"}
BOOSTING = Learner("boosting", _boosting, {**_SHARED, "maxDepth": [2, 3, 5, 7], "minGain": [0.0, 1.0]}, **_BOOSTED)
LEAFWISE = Learner("leafwise", _boosting, {**_SHARED, "maxIter": [25, 50, 100, 200], "leaves": [7, 15, 31, 63], "maxDepth": [0, 4, 8]}, **_BOOSTED)
SYMMETRIC = Learner("symmetric", _boosting, {**_SHARED, "symmetric": [True], "maxDepth": [2, 4, 6]}, **_BOOSTED)
EPSILON = Learner("epsilon", _epsilon, {
    "epsilon": [0.01, 0.05, 0.1, 0.3, 1.0, 3.0],
    "cost": [0.01, 0.1, 1.0, 10.0, 100.0],
    "gamma": [0.0, 0.003, 0.03],
}, scaled=True, predictions=estimators.epsilon_predictions)
ROBUST = Learner("robust", _robust, {
    "epsilon": [1.1, 1.35, 1.8, 2.5],
    "regParam": [0.0, 0.001, 0.01, 0.1, 1.0],
}, scaled=True)
LEARNERS = (FOREST, BOOSTING, LEAFWISE, SYMMETRIC, EPSILON)


# --------------------------------------------------------------------- search


def grid_points(space: Mapping[str, Sequence]) -> list[dict]:
    """Every combination."""
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def random_points(space: Mapping[str, Sequence], n: int, seed: int = SEED) -> list[dict]:
    """Distinct combinations drawn by number, without listing them all."""
    sizes = [len(v) for v in space.values()]
    total = math.prod(sizes)
    points = []
    for number in random.Random(seed).sample(range(total), min(n, total)):
        point = {}
        for (name, values), size in zip(space.items(), sizes):
            number, at = divmod(number, size)
            point[name] = values[at]
        points.append(point)
    return points


def _rmse(scored: DataFrame) -> float:
    error = F.col("prediction") - F.col("label")
    return scored.agg(F.sqrt(F.avg(error * error))).first()[0]


def labelled(frame: DataFrame, spec: PanelSpec) -> DataFrame:
    return frame.withColumn("label", F.col(spec.target).cast("double"))


def search(
    frame: DataFrame, spec: PanelSpec, numeric: Sequence[str], learner: Learner, points: Sequence[Mapping],
    n_splits: int = 5, parallelism: int = 4, key: str | None = "DRS",
) -> list[dict]:
    """Mean validation error of every point over time-ordered folds.

    Encoding is fitted on the training part of each fold and applied once;
    all points of the fold then share its cached rows.
    """
    if key:
        require_few_keys(frame, key)
    if learner.predictions is not None and _is_small(frame, numeric, key):
        return _search_at_once(frame, spec, numeric, learner, points, n_splits, key)
    marked = expanding_folds(labelled(frame, spec), spec, n_splits).persist(StorageLevel.MEMORY_AND_DISK)
    scores: list[list[float]] = [[] for _ in points]
    try:
        for i in range(n_splits):
            train, valid = fold_parts(marked, i)
            fitted = encoder(key, numeric, learner.scaled).fit(train)
            columns = ["features", "label"]
            seen = fitted.transform(train).select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
            held = fitted.transform(valid).select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                def score(point, seen=seen, held=held):
                    return _rmse(learner.build(point).fit(seen).transform(held))

                with ThreadPool(parallelism) as pool:
                    for at, value in enumerate(pool.map(score, points)):
                        scores[at].append(value)
            finally:
                seen.unpersist()
                held.unpersist()
    finally:
        marked.unpersist()
    return [
        {"model": learner.name, "params": dict(p), "rmse": sum(s) / len(s)} for p, s in zip(points, scores)
    ]


def _is_small(frame: DataFrame, numeric: Sequence[str], key: str | None) -> bool:
    """Whether the coded rows are few enough to be broadcast."""
    counts = frame.agg(F.count(F.lit(1)), F.approx_count_distinct(key) if key else F.lit(0)).first()
    return counts[0] * (len(numeric) + counts[1]) <= trees.SMALL_CELLS


def _search_at_once(frame, spec, numeric, learner: Learner, points, n_splits: int, key: str | None) -> list[dict]:
    """All points and folds as tasks of one job over a broadcast table of checked size."""
    spark = frame.sparkSession
    ship(spark)
    rows = expanding_folds(labelled(frame, spec), spec, n_splits).select(
        (F.col(key) if key else F.lit("")).cast("string").alias("key"), F.col(spec.time).cast("string").alias("time"),
        F.coalesce("fold", F.lit(-1)).alias("fold"), "label", F.array(*[F.col(c).cast("double") for c in numeric]).alias("x"))
    table = rows.orderBy("key", "time").toArrow()
    keys = np.array(table.column("key").to_pylist(), dtype=object)
    shared = spark.sparkContext.broadcast((
        keys, table.column("fold").to_numpy(), table.column("label").to_numpy().astype(float),
        np.array(table.column("x").to_pylist(), dtype=float).reshape(len(keys), len(numeric))))
    alike: dict[str, list[int]] = {}
    for k, p in enumerate(points):
        alike.setdefault(str(sorted((n, str(v)) for n, v in p.items() if n != learner.size)), []).append(k)
    units = [(group, fold) for group in alike.values() for fold in range(n_splits)]
    size, scaled, predictions, tried = learner.size, learner.scaled, learner.predictions, [dict(p) for p in points]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, folds, label, x = shared.value
        for batch in batches:
            for unit in batch.column("id").to_pylist():
                group, fold = units[unit]
                train, valid = folds < fold, folds == fold
                parts = _coded(keys, x, train, valid, bool(key), scaled)
                params = {n: v for n, v in tried[group[0]].items() if n != size}
                found = predictions(*parts[:1], label[train], *parts[1:], params, [tried[k].get(size) for k in group])
                errors = [float(np.sqrt(np.mean((p - label[valid]) ** 2))) for p in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group, type=pa.int64()), pa.array([fold] * len(group), type=pa.int64()), pa.array(errors)],
                    names=["point", "fold", "rmse"])

    found = spark.range(0, len(units), 1, len(units)).mapInArrow(run, "point long, fold long, rmse double").collect()
    scores = {(r["point"], r["fold"]): r["rmse"] for r in found}
    return [{"model": learner.name, "params": dict(p), "rmse": sum(scores[k, i] for i in range(n_splits)) / n_splits}
            for k, p in enumerate(points)]


def _coded(keys, x, train, valid, flags: bool, scaled: bool) -> list[np.ndarray]:
    """Training and validation rows as ``encoder`` makes them."""
    if scaled:
        spread = x[train].std(axis=0, ddof=1)
        x = np.where(spread > 0, (x - x[train].mean(axis=0)) / np.where(spread > 0, spread, 1), 0)
    known = sorted(set(keys[train])) if flags else []
    return [np.c_[np.array([keys[part] == k for k in known], dtype=float).reshape(len(known), -1).T, x[part]]
            if known else x[part] for part in (train, valid)]


def best_point(results: Sequence[Mapping]) -> Mapping:
    return min(results, key=lambda r: (r["rmse"], str(r["params"])))


# ----------------------------------------------------------------- evaluation


def fit(frame: DataFrame, spec: PanelSpec, numeric: Sequence[str], learner: Learner, params: Mapping, key: str | None = "DRS") -> PipelineModel:
    """Encoder and estimator fitted as one pipeline model."""
    if key:
        require_few_keys(frame, key)
    rows = labelled(frame, spec)
    prepared = encoder(key, numeric, learner.scaled).fit(rows)
    coded = prepared.transform(rows).select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = learner.build(params).fit(coded)
    finally:
        coded.unpersist()
    return PipelineModel([*prepared.stages, model])


def evaluate_model(model: PipelineModel, test: DataFrame, spec: PanelSpec) -> dict:
    """Training-flavour metrics of the clamped predictions on the test rows."""
    scored = model.transform(test).withColumns({"observe": F.col(spec.target), "prevu": F.col("prediction")})
    return evaluate.training_metrics(scored).first().asDict()


RESULT_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    *[T.StructField(m, T.DoubleType()) for m in ("mae", "rmse", "smape", "mape", "accuracy", "r2")],
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("error", T.StringType()),
])


def compare(
    train: DataFrame, test: DataFrame, spec: PanelSpec, numeric: Sequence[str],
    candidates: Sequence[tuple[Learner, Mapping]], key: str | None = "DRS",
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Fit and score every candidate; one that fails becomes a row with its error.

    Raises only if none worked.
    """
    rows, models = [], {}
    for learner, params in candidates:
        shown = {k: str(v) for k, v in params.items()}
        try:
            model = fit(train, spec, numeric, learner, params, key)
            m = evaluate_model(model, test, spec)
        except Exception as error:  # noqa: BLE001  any learner may be unusable
            rows.append((learner.name, *[None] * 6, shown, str(error).splitlines()[0]))
            continue
        models[learner.name] = model
        rows.append((learner.name, m["mae"], m["rmse"], m["smape"], m["mape"], m["accuracy"], m["r2"], shown, None))
    if not models:
        raise RuntimeError("no learner worked: " + "; ".join(f"{r[0]}: {r[-1]}" for r in rows))
    return train.sparkSession.createDataFrame(rows, RESULT_SCHEMA), models


def ranked(results: DataFrame) -> DataFrame:
    return results.orderBy(F.col("rmse").asc_nulls_last(), "model")


def best_model(results: DataFrame) -> DataFrame:
    return ranked(results.filter(F.col("rmse").isNotNull())).limit(1)


# ----------------------------------------------------------------- inspection


def encoded_names(model: PipelineModel, sample: DataFrame) -> list[str]:
    """Names of the vector slots: ``cat__...`` for key indicators, ``num__...`` else."""
    attributes = model.transform(sample.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
    flat = [a for group in attributes.values() for a in group]
    names = []
    for a in sorted(flat, key=lambda a: a["idx"]):
        name = a.get("name", str(a["idx"]))
        at = name.find("_flags_")
        names.append(f"cat__{name[:at]}_{name[at + 7:]}" if at >= 0 else f"num__{name}")
    return names


def split_counts(spark: SparkSession, model: Model) -> DataFrame:
    """(slot, n): number of tree nodes that test each vector slot, from the node table of the model."""
    if isinstance(model, estimators.HistogramBoostingModel):
        return model.node_table(spark).filter("slot >= 0").groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_dir(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    split = F.col("nodeData.split" if "nodeData" in nodes.columns else "split")
    return nodes.select(split["featureIndex"].alias("slot")).filter("slot >= 0").groupBy("slot").agg(
        F.count(F.lit(1)).alias("n"))


def importance_table(spark: SparkSession, model: PipelineModel, sample: DataFrame, unit: str = "splits") -> DataFrame:
    """Importance per feature, by split count or by gain, with label and family."""
    names = encoded_names(model, sample)
    last = model.stages[-1]
    if unit == "splits":
        slots = spark.createDataFrame(list(enumerate(names)), "slot int, name string")
        table = slots.join(split_counts(spark, last), "slot", "left").select(
            "name", F.coalesce("n", F.lit(0)).cast("double").alias("importance"))
    else:
        values = [float(v) for v in last.featureImportances.toArray()]
        table = spark.createDataFrame(list(zip(names, values)), "name string, importance double")
    return table.select(
        text.feature_label("name").alias("feature"), "importance", text.feature_family("name").alias("famille")
    )


def top_features(table: DataFrame, n: int = 20) -> DataFrame:
    return table.orderBy(F.col("importance").desc(), "feature").limit(n)


def family_importance(table: DataFrame) -> DataFrame:
    return table.groupBy("famille").agg(F.sum("importance").alias("importance"))


def parameter_sheet(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Parameters of the fitted estimator as rows."""
    last = model.stages[-1]
    rows = [(p.name, str(v)) for p, v in sorted(last.extractParamMap().items(), key=lambda e: e[0].name) if p.name != "nodes"]
    return spark.createDataFrame(rows, "parameter string, value string")


def as_rule(model: PipelineModel, sample: DataFrame) -> Rule:
    """A fitted linear pipeline without key or scaling as a column rule."""
    last = model.stages[-1]
    names = [n.removeprefix("num__") for n in encoded_names(model, sample)]
    if any(n.startswith("cat__") for n in names):
        raise ValueError("a rule has no key indicators; fit without the key")
    return Rule(dict(zip(names, [float(c) for c in last.coefficients])), float(last.intercept))


def as_tree_rule(model: PipelineModel, sample: DataFrame) -> Callable[[dict[str, Column]], Column]:
    """A fitted boosting pipeline without scaling as a rule over features: its node table, walked by an expression."""
    made = model.stages[-1].trees

    def value(name: str, found: dict[str, Column]) -> Column:
        if not name.startswith("cat__"):
            return found[name.removeprefix("num__")].cast("double")
        key, _, level = name.removeprefix("cat__").partition("_")
        return (F.col(key) == level).cast("double")

    names = encoded_names(model, sample)
    return lambda found: trees.predicted(F.array(*[value(n, found) for n in names]), made)
