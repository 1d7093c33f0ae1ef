"""Time-ordered splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.session import written
from monthloom.spec import PanelSpec


def sorted_months(df: DataFrame, time: str) -> DataFrame:
    """One row with the sorted distinct months; bounded by the calendar."""
    return df.select(time).distinct().agg(F.array_sort(F.collect_list(time)).alias("months"))


def period_split(df: DataFrame, spec: PanelSpec, share: float = 0.2, name: str = "part") -> DataFrame:
    """Mark the last ``max(1, int(months * share))`` months as test, for all series."""
    months = F.col("months")
    held = F.greatest(F.lit(1), (F.size(months) * F.lit(share)).cast("int"))
    cut = sorted_months(df, spec.time).select(F.element_at(months, -held).alias("cut")).scalar()
    return df.withColumn(name, F.when(F.col(spec.time) >= cut, "test").otherwise("train"))


def _tie_order(spec: PanelSpec) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in spec.series]))


def row_split(df: DataFrame, spec: PanelSpec, share: float = 0.8, name: str = "part") -> DataFrame:
    """Mark the first ``int(share * rows)`` rows as train, in month order.

    Rows of one month are ordered by the digest of their series, then by the
    series.  Rows are counted per month and digest bucket, a small table whose
    running sum gives the place of each bucket; ranks are needed only inside
    the one bucket that the cut falls into, and stay within it.
    """
    ordered = written(df.withColumn("_tie", _tie_order(spec)), "ordered").withColumn("_bucket", F.substring("_tie", 1, 4))
    keys = [spec.time, "_bucket"]
    counts = ordered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(*keys))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.floor(F.sum("_n").over(everything) * F.lit(share)).cast("long")
    counts = counts.select(*keys, upto.alias("_upto"), (F.col("_n")).alias("_n"), wanted.alias("_wanted"))
    taken = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_wanted") - F.col("_upto") + F.col("_n"))).alias("_taken")
    rows = ordered.join(counts.select(*keys, "_n", taken), keys)
    split_bucket = (F.col("_taken") > 0) & (F.col("_taken") < F.col("_n"))
    window = Window.partitionBy(*keys).orderBy("_tie", *spec.series)
    cut = rows.filter(split_bucket).withColumn("_train", F.row_number().over(window) <= F.col("_taken"))
    whole = rows.filter(~split_bucket).withColumn("_train", F.col("_taken") > 0)
    part = F.when(F.col("_train"), "train").otherwise("test")
    return whole.unionByName(cut).withColumn(name, part).drop("_tie", "_bucket", "_n", "_taken", "_train")


def expanding_folds(df: DataFrame, spec: PanelSpec, n_splits: int = 5, name: str = "fold") -> DataFrame:
    """Validation fold of each row, by distinct months; null before the first.

    A fold spans ``months // (n_splits + 1)`` months; fold ``i`` trains on
    every row before it (null or smaller fold).
    """
    # a table of months, ranked once; rows of these windows are months of the calendar
    months = df.select(spec.time).distinct()
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    index = F.row_number().over(Window.orderBy(F.col(spec.time).asc_nulls_last())) - 1
    n = F.count(F.lit(1)).over(everything)
    width = F.floor(F.col("_n") / F.lit(n_splits + 1)).cast("int")
    first = F.col("_n") - width * n_splits
    fold = F.when(F.col("_i") >= first, F.floor((F.col("_i") - first) / F.nullif(width, F.lit(0))).cast("int"))
    folds = months.withColumns({"_i": index, "_n": n}).select(F.col(spec.time).alias("_month"), fold.alias(name))
    return df.join(folds, F.col(spec.time).eqNullSafe(F.col("_month")), "left").drop("_month")


def fold_parts(df: DataFrame, i: int, name: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of fold ``i``."""
    fold = F.col(name)
    return df.filter(fold.isNull() | (fold < i)), df.filter(fold == i)
