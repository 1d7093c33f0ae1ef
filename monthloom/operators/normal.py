"""Least squares for any number of groups or cut-offs inside the plan, from sums of products.

The normal equations of a group are a few sums that combine on the map side; they
are solved by elimination as an expression over a small matrix, so no group is
looped over and none is gathered.  Sums of consecutive months add up, so one
window gives the equations of every cut-off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SINGULAR = 1e-10  # of a column's own sum of squares: what is left of a column that others determine


def _products(columns: Sequence[str], target: str) -> dict[str, Column]:
    """The upper half of all products of the columns, the constant and the target."""
    values = [*[F.col(c).cast("double") for c in columns], F.lit(1.0), F.col(target).cast("double")]
    return {f"s{i}_{j}": values[i] * values[j] for i in range(len(values)) for j in range(i, len(values))}


def _names(columns: Sequence[str]) -> list[str]:
    n = len(columns) + 2
    return [f"s{i}_{j}" for i in range(n) for j in range(i, n)]


def sums(frame: DataFrame, groups: Sequence[str], columns: Sequence[str], target: str) -> DataFrame:
    """One row per group with the sums of all products; rows with a null in any of the columns don't count."""
    whole = frame.dropna(subset=[*columns, target])
    return whole.groupBy(*groups).agg(*[F.sum(v).alias(k) for k, v in _products(columns, target).items()])


def _matrix(n: int) -> Column:
    """n equations: products of every column with all columns and with the target."""
    return F.array(*[F.array(*[F.col(f"s{min(i, j)}_{max(i, j)}") for j in range(n + 1)]) for i in range(n)])


def _eliminated(matrix: Column, n: int) -> Column:
    """Gauss-Jordan elimination; a column that others determine makes every solution null."""
    scale = F.transform(matrix, lambda row, i: F.get(row, i))

    def step(state: Column, k: Column) -> Column:
        pivot = F.get(F.get(state, k), k)
        sound = F.when(F.abs(pivot) > F.lit(SINGULAR) * F.get(scale, k), pivot)
        own = F.transform(F.get(state, k), lambda v: v / sound)
        return F.transform(state, lambda row, i: F.when(i == k, own).otherwise(
            F.zip_with(row, own, lambda a, b: a - F.get(row, k) * b)))

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, step)
    return F.transform(solved, lambda row: F.get(row, F.lit(n)))


def solved(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table of sums with ``n``, ``coefficients`` (the constant last; null if not determined) and ``rmse``."""
    p = len(columns)
    rows = table.withColumn("coefficients", _eliminated(_matrix(p + 1), p + 1))
    sound = F.forall("coefficients", lambda c: c.isNotNull())
    rows = rows.withColumn("coefficients", F.when(sound, F.col("coefficients")))
    explained = sum((F.get("coefficients", F.lit(i)) * F.col(f"s{i}_{p + 1}") for i in range(p + 1)), F.lit(0.0))
    n = F.col(f"s{p}_{p}")
    return rows.withColumns({
        "n": n.cast("long"), "rmse": F.sqrt(F.greatest(F.col(f"s{p + 1}_{p + 1}") - explained, F.lit(0.0)) / n),
    }).drop(*_names(columns))


def fit_by_group(frame: DataFrame, groups: Sequence[str], columns: Sequence[str], target: str) -> DataFrame:
    """(groups, coefficients, n, rmse): one least-squares fit per group."""
    return solved(sums(frame, groups, columns, target), columns)


def fit_by_cutoff(
    frame: DataFrame, time: str, cutoffs: Sequence, columns: Sequence[str], target: str, groups: Sequence[str] = (),
) -> DataFrame:
    """(groups, cutoff, coefficients, n, rmse): for every cut-off the fit of all rows up to it.

    Rows shrink to sums per month first; the window runs over months.
    """
    monthly = sums(frame, [*groups, time], columns, target)
    upto = Window.partitionBy(*groups).orderBy(time)
    running = monthly.select(*groups, F.col(time).alias("_from"), F.lead(time).over(upto).alias("_to"),
                             *[F.sum(k).over(upto).alias(k) for k in _names(columns)])
    given = F.explode(F.array(*[F.lit(c).cast("date") for c in cutoffs]))
    held = running.withColumn("cutoff", given).filter(
        (F.col("_from") <= F.col("cutoff")) & (F.col("_to").isNull() | (F.col("cutoff") < F.col("_to"))))
    return solved(held.drop("_from", "_to"), columns)


def line_rule(columns: Sequence[str], coefficients: str = "coefficients"):
    """A rule over features whose weights are a column of the same row."""
    def rule(found: dict[str, Column]) -> Column:
        terms = [F.get(F.col(coefficients), F.lit(i)) * found[c] for i, c in enumerate(columns)]
        return sum(terms, F.get(F.col(coefficients), F.lit(len(columns))))
    return rule
