"""Recursive multi-step forecasts for all series, scenarios and cut-offs at once.

Time is sequential, series are not.  A forecast therefore works on one row per
(series, tags): the targets known before the start as an array, the months to
forecast with their measures as a second array.  Each step reads its lags from
the end of the first array and appends the clamped prediction to it.

* ``Rule`` predictions (fixed or fitted linear forms) run as one array fold.
* Fitted pipelines run as ``horizon`` narrow projections over the same rows,
  without a shuffle between the steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions import calendar as cal
from monthloom.functions import maths
from monthloom.operators import features as feat
from monthloom.operators.clean import override_values
from monthloom.operators.joins import asof_before
from monthloom.operators.windows import next_period
from monthloom.session import checkpoint_root
from monthloom.spec import PanelSpec

STEPS_PER_CHECKPOINT = 6


@dataclass(frozen=True)
class Rule:
    """Linear form over named features, usable as a column expression."""

    weights: dict[str, float]
    intercept: float = 0.0

    def __call__(self, features: dict[str, Column]) -> Column:
        total = F.lit(float(self.intercept))
        for name, weight in self.weights.items():
            total = total + F.lit(float(weight)) * features[name]
        return total

    def on(self, df: DataFrame, name: str = "prediction", clamp: bool = True) -> DataFrame:
        """Apply the rule to feature columns of a frame."""
        value = self({f: F.col(f) for f in self.weights})
        return df.withColumn(name, maths.at_least_zero(value) if clamp else value)


def prepare(
    history: DataFrame,
    future: DataFrame,
    spec: PanelSpec,
    tags: tuple[str, ...] = (),
    depth: int | None = None,
    least: int = 12,
    expect: Column | None = None,
) -> DataFrame:
    """One row per (series, tags) with ``past``, ``ahead`` and ``problem``.

    ``future`` holds the months to forecast with their measures; history at or
    after the first of them is ignored.  ``depth`` limits ``past`` to the rows
    a step can look back at (None keeps all known months).  ``expect`` is the
    number of months each request should have.
    """
    ahead = F.array_sort(F.collect_list(F.struct(spec.time, *spec.exog)))
    requests = future.groupBy(*spec.series, *tags).agg(ahead.alias("ahead"))
    known = history.groupBy(*spec.series).agg(
        F.array_sort(F.collect_list(F.struct(F.col(spec.time).alias("t"), F.col(spec.target).alias("y")))).alias("_known")
    )
    start = F.element_at("ahead", 1)[spec.time]
    joined = requests.join(known, list(spec.series), "left").withColumn(
        "past", F.transform(F.filter("_known", lambda r: r["t"] < start), lambda r: r["y"])
    )
    months = F.transform("_known", lambda r: r["t"])
    again = F.when(F.size(F.array_distinct(months)) < F.size(months), F.lit("repeated months of history"))
    out = with_problem(joined, spec, least, expect, F.col("_known").isNull())
    out = out.withColumn("problem", F.coalesce("problem", again)).drop("_known")
    if depth is not None:
        out = out.withColumn(
            "past", F.slice("past", -F.least(F.lit(depth), F.greatest(F.size("past"), F.lit(1))), depth))
    return out


def with_problem(
    state: DataFrame, spec: PanelSpec, least: int, expect: Column | None = None, unknown: Column | None = None
) -> DataFrame:
    """Name what is wrong with each row of ``past`` and ``ahead``; null when fine."""
    rows = F.coalesce(F.size("past"), F.lit(0))
    months = F.transform("ahead", lambda r: r[spec.time])
    first, last = F.try_element_at(months, F.lit(1)), F.try_element_at(months, F.lit(-1))
    problem = (
        F.when(F.lit(False) if unknown is None else unknown, F.lit("unknown series"))
        .when(F.size(F.array_distinct(months)) < F.size("ahead"), F.lit("repeated months"))
        .when(F.size("ahead") < cal.months_apart(last, first) + 1, F.lit("missing months"))
        .when(rows < least, F.concat(F.lit(f"at least {least} months of history are required, found "), rows.cast("string")))
    )
    if least:
        empty = F.exists("ahead", lambda r: F.coalesce(*[F.when(r[m].isNull(), True) for m in spec.exog], F.lit(False)))
        problem = F.coalesce(problem, F.when(empty, F.lit("missing feature values")))
    if expect is not None:
        problem = F.coalesce(problem, F.when(F.size("ahead") != expect, F.lit("missing months")))
    return state.withColumn("problem", problem)


def settle(state: DataFrame, on_problem: str = "raise") -> DataFrame:
    """Stop at the first bad request (``raise``), or keep all with what is wrong with each (``mark``)."""
    if on_problem == "mark":
        return state
    if on_problem != "raise":
        raise ValueError(f"on_problem is 'raise' or 'mark', not {on_problem!r}")
    fine = F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("problem")).cast("boolean"))
    return state.filter(fine).drop("problem")


def problems(state: DataFrame, spec: PanelSpec, tags: tuple[str, ...] = ()) -> DataFrame:
    return state.filter(F.col("problem").isNotNull()).select(*spec.series, *tags, "problem")


def _lag(past: Column, k: int) -> Column:
    return F.try_element_at(past, F.lit(-k))


def _full_mean(past: Column, n: int) -> Column:
    total = _lag(past, n)
    for k in range(n - 1, 0, -1):
        total = total + _lag(past, k)
    return total / n


def _partial_mean(past: Column, n: int) -> Column:
    """Mean of the last ``n`` known values, of fewer if fewer, 0 if none."""
    known = F.filter(past, lambda v: v.isNotNull())
    size = F.size(known)
    tail = F.slice(known, -F.least(F.lit(n), F.greatest(size, F.lit(1))), n)
    mean = F.aggregate(tail, F.lit(0.0), lambda a, v: a + v) / F.least(F.lit(n), size)
    return F.when(size == 0, F.lit(0.0)).otherwise(mean)


def step_features(past: Column, ahead: Column, spec: PanelSpec, fallback: str) -> dict[str, Column]:
    """Features of one future month from the arrays of its row."""
    mean = _full_mean if fallback == "full" else _partial_mean
    out: dict[str, Column] = {m: ahead[m] for m in spec.exog}
    out |= {f"target_lag_{k}": _lag(past, k) for k in spec.lags}
    out |= {f"target_roll_mean_{n}": mean(past, n) for n in spec.rolls}
    out |= feat.calendar_columns(ahead[spec.time])
    return out


def _depth(spec: PanelSpec, fallback: str) -> int | None:
    # means over known values only may have to look further back than any lag
    return spec.depth if fallback == "full" else None


def _made(state: DataFrame) -> Column:
    """The predictions: appended to the known values one by one, they are the last ones; nulls for marked requests."""
    made = F.slice("filled", -F.size("ahead"), F.size("ahead"))
    if "problem" not in state.columns:
        return made
    return F.when(F.col("problem").isNull(), made).otherwise(F.transform("ahead", lambda r: F.lit(None).cast("double")))


def _unfold(state: DataFrame, spec: PanelSpec, tags: tuple[str, ...]) -> DataFrame:
    marked = ["problem"] if "problem" in state.columns else []
    months = F.transform("ahead", lambda r: r[spec.time])
    return state.select(
        *spec.series, *tags, *marked,
        F.inline(F.arrays_zip(months.alias(spec.time), _made(state).alias("prediction"))),
    ).select(*spec.series, *tags, spec.time, "prediction", *marked)


def fill_by_rule(state: DataFrame, rule: Callable, spec: PanelSpec, fallback: str, on_problem: str) -> DataFrame:
    """Fold the rule over ``ahead``, starting from ``past``, into ``filled``."""
    def step(past: Column, ahead: Column) -> Column:
        value = rule(step_features(past, ahead, spec, fallback))
        missing = F.raise_error(
            F.concat(F.lit("missing feature values for "), ahead[spec.time].cast("string"))
        ).cast("double")
        if on_problem == "mark":
            missing = F.lit(None).cast("double")
        # through a one-element array, so that the rule is written out once
        clamped = F.transform(F.array(value), lambda v: F.when(v.isNull(), missing).otherwise(F.greatest(F.lit(0.0), v)))
        return F.concat(past, clamped)

    known = F.coalesce(F.col("past"), F.array().cast("array<double>"))
    state = state.withColumn("filled", F.aggregate("ahead", known, step))
    if on_problem == "mark":
        made = F.slice("filled", -F.size("ahead"), F.size("ahead"))
        gap = F.when(F.exists(made, lambda v: v.isNull()), F.lit("missing feature values"))
        state = state.withColumn("problem", F.coalesce("problem", gap))
    return state


def forecast_by_rule(
    history: DataFrame,
    future: DataFrame,
    rule: Callable[[dict[str, Column]], Column],
    spec: PanelSpec,
    tags: tuple[str, ...] = (),
    fallback: str = "full",
    on_problem: str = "raise",
    expect: Column | None = None,
) -> DataFrame:
    """Fold the rule over the future months of every row; any horizon.

    With ``on_problem="mark"`` every request is answered: those with a
    ``problem`` have null predictions, the others a null problem.
    """
    least = 12 if fallback == "full" else 0
    state = settle(prepare(history, future, spec, tags, _depth(spec, fallback), least, expect), on_problem)
    return _unfold(fill_by_rule(state, rule, spec, fallback, on_problem), spec, tags)


def used_positions(spec: PanelSpec, horizon: int) -> list[int]:
    """Positions from the end of the known targets that some step looks at."""
    reach = set(spec.lags) | {k for n in spec.rolls for k in range(1, n + 1)}
    return sorted({k - j for k in reach for j in range(horizon) if k > j})


def _split_stages(model: PipelineModel, spec: PanelSpec) -> tuple[list, list]:
    """Stages that depend on the series only, and stages to run at every step."""
    fixed_columns, once, each = set(spec.series), [], []
    for stage in model.stages:
        inputs = {stage.getInputCol()} if stage.hasParam("inputCol") and stage.isSet("inputCol") else None
        if inputs is not None and inputs <= fixed_columns:
            once.append(stage)
            fixed_columns.add(stage.getOutputCol())
        else:
            each.append(stage)
    return once, each


def fill_by_model(
    state: DataFrame, model: PipelineModel, spec: PanelSpec, horizon: int | None, fallback: str, on_problem: str
) -> DataFrame:
    """Run the pipeline step by step over ``ahead``, starting from ``past``, into ``filled``.

    Without a ``horizon`` it is the longest request's.

    Stages that see only the series key run once, before the steps.  Requests
    with fewer months finish early: their spare steps see zeros and append
    nothing.  A reliable checkpoint every few steps keeps the plan short; it
    holds one compact row per request.
    """
    if horizon is None:
        horizon = state.agg(F.max(F.size("ahead"))).first()[0] or 0
    late = F.when(F.size("ahead") > horizon, F.lit(f"more than {horizon} months requested"))
    if fallback == "full":
        gaps = [_lag(F.col("past"), k).isNull() for k in used_positions(spec, horizon)]
        late = late.when(reduce(or_, gaps), F.lit("missing feature values"))
    state = settle(state.withColumn("problem", F.coalesce("problem", late)), on_problem)
    state = state.withColumn("filled", F.coalesce(F.col("past"), F.array().cast("array<double>"))).drop("past")
    once, each = _split_stages(model, spec)
    for stage in once:
        state = stage.transform(state)
    kept = state.columns
    for h in range(1, horizon + 1):
        values = step_features(F.col("filled"), F.get("ahead", F.lit(h - 1)), spec, fallback)
        state = state.withColumns({name: F.coalesce(v, F.lit(0.0)) for name, v in values.items()})
        for stage in each:
            state = stage.transform(state)
        grown = F.concat("filled", F.array(F.greatest(F.lit(0.0), F.col("prediction"))))
        state = state.withColumn("filled", F.when(F.size("ahead") >= h, grown).otherwise(F.col("filled"))).select(*kept)
        if h % STEPS_PER_CHECKPOINT == 0 and h < horizon:
            checkpoint_root(state.sparkSession)
            state = state.checkpoint()
    return state


def forecast_by_model(
    history: DataFrame,
    future: DataFrame,
    model: PipelineModel,
    spec: PanelSpec,
    horizon: int | None = None,
    tags: tuple[str, ...] = (),
    fallback: str = "full",
    on_problem: str = "raise",
    expect: Column | None = None,
) -> DataFrame:
    """Run a fitted pipeline over the future months of every row; ``horizon`` bounds them if given."""
    least = 12 if fallback == "full" else 0
    state = prepare(history, future, spec, tags, _depth(spec, fallback), least, expect)
    return _unfold(fill_by_model(state, model, spec, horizon, fallback, on_problem), spec, tags)


def latest_rows(
    requests: DataFrame, frame: DataFrame, spec: PanelSpec, values: list[str], unique: bool = False
) -> DataFrame:
    """Latest feature row strictly before each request, calendar set to the request."""
    carried = [v for v in values if v not in ("month", "quarter", "year")]
    found = asof_before(requests, frame, list(spec.series), spec.time, carried, unique=unique)
    time = F.col(spec.time)
    return found.withColumns({"month": F.month(time), "quarter": F.quarter(time), "year": F.year(time)})


def one_shot(
    requests: DataFrame,
    frame: DataFrame,
    spec: PanelSpec,
    predict: Callable[[DataFrame], DataFrame],
    values: list[str],
    overrides: DataFrame | None = None,
    on_problem: str = "raise",
    unique: bool = False,
) -> DataFrame:
    """Forecast each (series, month) from the latest feature row before it.

    The lags are those of that row: they are not recomputed for the requested
    month.  Measures given in ``overrides`` replace the carried ones.
    """
    rows = latest_rows(requests, frame, spec, values, unique)
    if overrides is not None:
        given = [m for m in spec.exog if m in overrides.columns]
        rows = override_values(rows, overrides, spec.keys, given)
    none = F.lit("no history before the requested month")
    present = F.col("observed_at").isNotNull()
    if on_problem == "mark":
        made = predict(rows.filter(present)).withColumn("problem", F.lit(None).cast("string"))
        return made.unionByName(rows.filter(~present).withColumn("problem", none), allowMissingColumns=True)
    return predict(rows.filter(F.when(present, F.lit(True)).otherwise(F.raise_error(none).cast("boolean"))))


def next_month_requests(history: DataFrame, spec: PanelSpec) -> DataFrame:
    return next_period(history, spec, spec.time)


def month_range_requests(history: DataFrame, spec: PanelSpec, start: Column, stop: Column) -> DataFrame:
    return history.select(*spec.series).distinct().withColumn(spec.time, F.explode(cal.month_list(start, stop)))


def _unfold_backtest(state: DataFrame, spec: PanelSpec) -> DataFrame:
    marked = ["problem"] if "problem" in state.columns else []
    months = F.transform("ahead", lambda r: r[spec.time])
    return state.select(
        *spec.series, "cutoff", *marked,
        F.inline(F.arrays_zip(months.alias(spec.time), F.col("seen").alias("observe"), _made(state).alias("prevu"))),
    ).select(*spec.series, "cutoff", spec.time, "observe", "prevu", *marked)


def prepare_backtest(history: DataFrame, spec: PanelSpec, cutoffs: list, horizon: int, last: Column | None = None) -> DataFrame:
    """One row per (series, cut-off) cut out of the whole history of the series.

    History and future are slices of the same array, so a series is grouped
    once whatever the number of cut-offs.  Months past ``last``, the last one
    on record over all series, are not asked for.
    """
    row = F.struct(spec.time, spec.target, *spec.exog)
    whole = history.groupBy(*spec.series).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    given = F.array(*[F.lit(c).cast("date") for c in cutoffs])
    cut = F.col("cutoff")
    rows = whole.withColumn("cutoff", F.explode(given))
    before = F.filter("_all", lambda r: r[spec.time] <= cut)
    after = F.filter("_all", lambda r: (r[spec.time] > cut) & (r[spec.time] <= F.add_months(cut, horizon)))
    rows = rows.withColumns({
        "past": F.transform(before, lambda r: r[spec.target]),
        "ahead": F.transform(after, lambda r: F.struct(r[spec.time], *[r[m] for m in spec.exog])),
        "seen": F.transform(after, lambda r: r[spec.target]),
        "_again": F.size(F.array_distinct(F.transform("_all", lambda r: r[spec.time]))) < F.size("_all"),
    }).drop("_all")
    if last is None:
        last = history.agg(F.max(spec.time).alias("m")).scalar()
    expect = F.greatest(F.lit(0), F.least(F.lit(horizon), cal.months_apart(last, cut)))
    # a cut-off at or after the last month has nothing to compare with
    checked = with_problem(rows, spec, 12, expect).withColumn("_expect", expect).filter("_expect > 0")
    again = F.when(F.col("_again"), F.lit("repeated months of history"))
    checked = checked.withColumn("problem", F.coalesce("problem", again)).drop("_again")
    # every month asked for, with nulls where the series has none
    asked = F.transform(F.sequence(F.lit(1), F.col("_expect")), lambda k: F.add_months(cut, k))
    found = F.transform(asked, lambda m: F.try_element_at(F.filter(
        F.arrays_zip(F.col("ahead").alias("a"), F.col("seen").alias("s")), lambda r: r["a"][spec.time] == m), F.lit(1)))
    full = F.zip_with(asked, found, lambda m, r: F.struct(
        m.alias(spec.time), *[r["a"][x].alias(x) for x in spec.exog], r["s"].alias("_seen")))
    return checked.withColumn("_full", full).withColumns({
        "ahead": F.transform("_full", lambda r: F.struct(r[spec.time], *[r[x] for x in spec.exog])),
        "seen": F.transform("_full", lambda r: r["_seen"]),
    }).drop("_full", "_expect")


def backtest(
    history: DataFrame,
    spec: PanelSpec,
    cutoffs: list,
    horizon: int,
    rule: Callable | None = None,
    model: PipelineModel | None = None,
    on_problem: str = "raise",
    last: Column | None = None,
    fits: DataFrame | None = None,
) -> DataFrame:
    """Forecast after every cut-off from the history up to it, next to what was observed.

    ``fits`` is what was fitted up to each ``cutoff`` (and for each series, if it
    has their columns); the rule reads its columns.
    """
    state = prepare_backtest(history, spec, cutoffs, horizon, last)
    if fits is not None:
        state = state.join(fits, [c for c in (*spec.series, "cutoff") if c in fits.columns], "left")
    if rule is not None:
        filled = fill_by_rule(settle(state, on_problem), rule, spec, "full", on_problem)
    else:
        filled = fill_by_model(state, model, spec, horizon, "full", on_problem)
    return _unfold_backtest(filled, spec)


def national(forecast: DataFrame, time: str = "PERIODE") -> DataFrame:
    """Sum over the series, and how many of them have no prediction."""
    return forecast.groupBy(time).agg(
        F.sum("prediction").alias("National_Prediction"),
        F.sum(F.col("prediction").isNull().cast("long")).alias("unanswered"))
