"""Learners of this library as pipeline stages: histogram boosting and epsilon-insensitive lines."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions import maths
from monthloom.operators import convex, trees
from monthloom.operators.trees import Growth, Trees
from monthloom.session import written
from monthloom.shipping import ship


class _Columns(HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    def _values(self):
        return vector_to_array(self.getFeaturesCol())


def _number(name: str, doc: str, kind=TypeConverters.toFloat) -> Param:
    return Param(Params._dummy(), name, doc, kind)


# -------------------------------------------------------------------- boosting


def column_share(strategy: str | float, n: int) -> float:
    """Share of the columns that a node may use: all, sqrt, log2 or a number."""
    named = {"all": 1.0, "sqrt": math.ceil(math.sqrt(n)) / n, "log2": max(1, math.ceil(math.log2(n))) / n}
    return named[strategy] if strategy in named else float(strategy)


def growth_of(params: Mapping, n: int) -> Growth:
    """Settings by their names in pipelines, for n columns."""
    return Growth(
        rounds=int(params.get("maxIter", params.get("numTrees", 100))), depth=int(params.get("maxDepth", 3)),
        step=float(params.get("stepSize", 0.1)), l1=float(params.get("l1", 0.0)), l2=float(params.get("l2", 1.0)),
        leaves=int(params.get("leaves", 0)), symmetric=bool(params.get("symmetric", False)),
        least_rows=float(params.get("minInstancesPerNode", 1)), least_gain=float(params.get("minGain", 0.0)),
        row_share=float(params.get("subsamplingRate", 1.0)),
        columns=column_share(params.get("featureSubsetStrategy", "all"), n), bins=int(params.get("maxBins", 64)),
        seed=int(params.get("seed", 42)))


class HistogramBoosting(Estimator, _Columns):
    """Gradient boosting on squared loss with L1 and L2 on leaves, grown by level, by best leaf or symmetrically."""

    maxIter = _number("maxIter", "trees", TypeConverters.toInt)
    maxDepth = _number("maxDepth", "levels of a tree; 0 for no bound with leaves", TypeConverters.toInt)
    stepSize = _number("stepSize", "what a tree counts")
    l1 = _number("l1", "absolute penalty on leaves")
    l2 = _number("l2", "squared penalty on leaves")
    leaves = _number("leaves", "most leaves of a tree grown by best leaf first; 0 to grow by level", TypeConverters.toInt)
    symmetric = _number("symmetric", "one cut for a whole level", TypeConverters.toBoolean)
    minInstancesPerNode = _number("minInstancesPerNode", "least rows of a leaf", TypeConverters.toInt)
    minGain = _number("minGain", "what a cut has to gain")
    subsamplingRate = _number("subsamplingRate", "share of rows of a tree")
    featureSubsetStrategy = _number("featureSubsetStrategy", "columns of a node", TypeConverters.toString)
    maxBins = _number("maxBins", "bins of a column", TypeConverters.toInt)
    seed = _number("seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, **params):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "HistogramBoostingModel":
        rows, n, small = _training_rows(self, df)
        how = growth_of({p.name: v for p, v in self.extractParamMap().items()}, n)
        if small:
            made = Trees.from_json(_in_one_task(rows, lambda x, y: trees.boost_arrays(x, y, how).to_json()))
        else:
            made = trees.boost_spark(rows, how)
        return self._copyValues(HistogramBoostingModel(nodes=made.to_json()))


def _training_rows(stage, df: DataFrame) -> tuple[DataFrame, int, bool]:
    """Written rows (x, label), the length of x, and whether they are few enough for one task."""
    rows = written(df.select(stage._values().alias("x"), F.col(stage.getLabelCol()).cast("double").alias("label")), "training")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    if not size["n"]:
        raise ValueError("no rows to fit")
    return rows, size["width"], size["n"] * size["width"] <= trees.SMALL_CELLS


def _in_one_task(rows: DataFrame, fit: Callable[[np.ndarray, np.ndarray], str]) -> str:
    """A fit over arrays, for a table whose size was checked."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if table.num_rows:
            x = np.array(table.column("x").to_pylist(), dtype=float)
            y = table.column("label").to_numpy()
            order = np.lexsort([*x.T, y])  # whatever order the rows come in
            yield pa.RecordBatch.from_arrays([pa.array([fit(x[order], y[order])])], names=["made"])

    return rows.repartition(1).mapInArrow(run, "made string").first()["made"]


class HistogramBoostingModel(Model, _Columns):
    nodes = _number("nodes", "node table", TypeConverters.toString)

    @keyword_only
    def __init__(self, nodes: str = ""):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def trees(self) -> Trees:
        return Trees.from_json(self.getOrDefault(self.nodes))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getPredictionCol(), trees.predicted(self._values(), self.trees))

    def node_table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            trees.node_rows(self.trees), "tree int, node int, slot int, threshold double, low int, high int, value double")


# ----------------------------------------------------------------- robust line


class EpsilonRegression(Estimator, _Columns):
    """Line with the epsilon-insensitive loss; with ``gamma`` on random features of a Gaussian kernel."""

    epsilon = _number("epsilon", "errors up to it cost nothing")
    cost = _number("cost", "what the errors count against the size of the weights")
    gamma = _number("gamma", "width of the kernel exp(-gamma |a - b|^2); 0 for a line")
    kernelSize = _number("kernelSize", "random features of the kernel", TypeConverters.toInt)
    seed = _number("seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, **params):
        super().__init__()
        self._setDefault(epsilon=0.1, cost=1.0, gamma=0.0, kernelSize=200, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "EpsilonRegressionModel":
        rows, n, small = _training_rows(self, df)
        get = self.getOrDefault
        epsilon, cost = get(self.epsilon), get(self.cost)
        frequencies, phases = kernel_map(n, get(self.kernelSize), get(self.gamma), get(self.seed))
        if small:
            w = json.loads(_in_one_task(rows, lambda x, y: json.dumps(_line(x, y, epsilon, cost, frequencies, phases).tolist())))
        else:
            w = _line_by_spark(rows, n, epsilon, cost, frequencies, phases)
        model = EpsilonRegressionModel(
            coefficients=[float(v) for v in w[:-1]], intercept=float(w[-1]),
            frequencies=[] if frequencies is None else [float(v) for v in frequencies.ravel()],
            phases=[] if phases is None else [float(v) for v in phases])
        return self._copyValues(model)


def _with_kernel(x: np.ndarray, frequencies, phases) -> np.ndarray:
    """The columns, or their random features, and the constant."""
    if frequencies is not None:
        x = math.sqrt(2 / len(phases)) * np.cos(x @ frequencies.T + phases)
    return np.c_[x, np.ones(len(x))]


def _line(x, y, epsilon: float, cost: float, frequencies, phases) -> np.ndarray:
    x = _with_kernel(x, frequencies, phases)
    return convex.minimise(convex.local_sums(x, y, epsilon), x.shape[1], cost, float(y.std()))


def _line_by_spark(rows: DataFrame, n: int, epsilon: float, cost: float, frequencies, phases) -> np.ndarray:
    n = n if frequencies is None else len(phases)
    if n > convex.MOST_COLUMNS:
        raise ValueError(f"{n} columns: more than {convex.MOST_COLUMNS}")
    x = F.col("x") if frequencies is None else kernel_features(F.col("x"), frequencies, phases)
    rows = rows.select("label", F.concat(x, F.array(F.lit(1.0))).alias("x"))
    at = F.filter(F.sequence(F.lit(0), F.lit(n)), lambda i: F.get("x", i) != 0)
    rows = written(rows.select("label", at.alias("at"), F.filter("x", lambda v: v != 0).alias("x")), "sparse")
    spread = rows.agg(F.stddev_pop("label")).first()[0]
    return convex.minimise(convex.spark_sums(rows, n + 1, epsilon), n + 1, cost, spread)


def kernel_map(n: int, m: int, gamma: float, seed: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    """(m, n) frequencies and m phases whose cosines have inner products near the Gaussian kernel; none for gamma 0."""
    if not gamma:
        return None, None
    draw = np.random.default_rng(seed)
    return draw.normal(scale=math.sqrt(2 * gamma), size=(m, n)), draw.uniform(0, 2 * math.pi, size=m)


def kernel_features(x, frequencies: np.ndarray, phases: np.ndarray):
    """The random features of a row as an expression."""
    held = maths.constant(np.asarray(frequencies).tolist(), "array<array<double>>")
    shift = maths.constant(np.asarray(phases).tolist(), "array<double>")
    return maths.once(x, lambda x: F.zip_with(held, shift, lambda row, p: F.lit(math.sqrt(2 / len(phases))) * F.cos(
        p + F.aggregate(F.zip_with(row, x, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v))))


class EpsilonRegressionModel(Model, _Columns):
    coefficients = _number("coefficients", "weights", TypeConverters.toListFloat)
    intercept = _number("intercept", "constant")
    frequencies = _number("frequencies", "of the kernel's features, row by row", TypeConverters.toListFloat)
    phases = _number("phases", "of the kernel's features", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, coefficients=None, intercept=0.0, frequencies=None, phases=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        x, phases = self._values(), np.array(self.getOrDefault(self.phases))
        if len(phases):
            x = kernel_features(x, np.array(self.getOrDefault(self.frequencies)).reshape(len(phases), -1), phases)
        weights = maths.constant(self.getOrDefault(self.coefficients), "array<double>")
        total = F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(float(self.getOrDefault(self.intercept))), lambda a, v: a + v)
        return df.withColumn(self.getPredictionCol(), total)


# ------------------------------------------------- fits of many settings at once


def forest_predictions(x, y, held, params: Mapping, sizes: Sequence[int]) -> list[np.ndarray]:
    """Predictions of forests of several sizes, each the beginning of the largest."""
    how = growth_of({**params, "numTrees": max(sizes), "maxBins": 32}, x.shape[1])
    each = trees.predict_arrays(held, trees.forest_arrays(x, y, how))
    return [each[:n].mean(axis=0) for n in sizes]


def boosting_predictions(x, y, held, params: Mapping, sizes: Sequence[int]) -> list[np.ndarray]:
    made = trees.boost_arrays(x, y, growth_of({**params, "maxIter": max(sizes)}, x.shape[1]))
    each = trees.predict_arrays(held, made)
    return [made.base + each[:n].sum(axis=0) for n in sizes]


def epsilon_predictions(x, y, held, params: Mapping, sizes: Sequence) -> list[np.ndarray]:
    kernel = kernel_map(x.shape[1], int(params.get("kernelSize", 200)), float(params.get("gamma", 0.0)), int(params.get("seed", 42)))
    w = _line(x, y, float(params.get("epsilon", 0.1)), float(params.get("cost", 1.0)), *kernel)
    return [_with_kernel(held, *kernel) @ w for _ in sizes]
