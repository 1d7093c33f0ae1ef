"""Whole tasks composed from the operators: train, forecast, compare, evaluate.

Each call covers any number of series; nothing here loops over them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions import fixed
from monthloom.operators import features, forecast, futures, learn, scenarios, split
from monthloom.operators.forecast import Rule
from monthloom.operators.validate import InvalidInput, require_columns
from monthloom.session import written
from monthloom.sources import registry, writers
from monthloom.spec import PanelSpec

Month = str | dt.date


def _first_day(month: Month) -> dt.date:
    day = dt.date.fromisoformat(f"{month}-01" if isinstance(month, str) and len(month) == 7 else str(month)[:10])
    return day.replace(day=1)


def _length(start: dt.date, stop: dt.date) -> int:
    return (stop.year - start.year) * 12 + stop.month - start.month + 1


def requested_months(
    history: DataFrame, spec: PanelSpec, start: Month, stop: Month, keys: Sequence[str] | None = None
) -> tuple[DataFrame, int]:
    """(series, month) pairs from ``start`` to ``stop`` and the number of months."""
    first, last = _first_day(start), _first_day(stop)
    if first > last:
        raise InvalidInput("start must not be after stop")
    known = history.select(*spec.series).distinct()
    if keys is not None:
        known = history.sparkSession.createDataFrame([(k,) for k in keys], f"`{spec.series[0]}` string")
    pairs = known.withColumn(
        spec.time, F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 month"))))
    return pairs, _length(first, last)


def _run(history, future, model, spec, horizon, tags=(), **options) -> DataFrame:
    if isinstance(model, PipelineModel):
        return forecast.forecast_by_model(history, future, model, spec, horizon, tags, **options)
    return forecast.forecast_by_rule(history, future, model, spec, tags, **options)


def predict_range(
    history: DataFrame, model: PipelineModel | Rule, spec: PanelSpec, start: Month, stop: Month,
    weather: DataFrame, keys: Sequence[str] | None = None, on_problem: str = "raise",
) -> DataFrame:
    """Recursive forecast from ``start`` to ``stop`` under the given measures.

    ``weather`` holds (series, month, measures), or (month, measures) shared
    by every series.  A requested month without measures is a problem.
    """
    require_columns(weather, [spec.time, *spec.exog], "weather")
    asked, horizon = requested_months(history, spec, start, stop, keys)
    on = [c for c in spec.keys if c in weather.columns]
    future = asked.join(weather.select(*on, *spec.exog), on, "left")
    return _run(history, future, model, spec, horizon, on_problem=on_problem)


def forecast_many(
    history: DataFrame, model: PipelineModel | Rule, spec: PanelSpec, start: Month, periods: int,
    weather_fn: Callable[[DataFrame], DataFrame], keys: Sequence[str] | None = None, on_problem: str = "raise",
) -> DataFrame:
    """As above with a function that turns (series, month) pairs into measures, once for all series."""
    first = _first_day(start)
    months = first.year * 12 + first.month - 1 + periods - 1
    stop = dt.date(months // 12, months % 12 + 1, 1)
    asked, horizon = requested_months(history, spec, first, stop, keys)
    return _run(history, weather_fn(asked), model, spec, horizon, on_problem=on_problem)


def forecast_next_year(
    history: DataFrame, model: PipelineModel | Rule, spec: PanelSpec, horizon: int = 12, fallback: str = "full",
    on_problem: str = "raise",
) -> DataFrame:
    """Months after the last one on record, measures repeating the last twelve rows."""
    start = futures.after_history(history, spec)
    none = 0.0 if fallback == "partial" else None
    ahead = futures.by_persistence(history, spec, start, horizon, if_none=none)
    return _run(history, ahead, model, spec, horizon, fallback=fallback, on_problem=on_problem)


def predict_national_range(*args, **kwargs) -> DataFrame:
    """``predict_range`` summed over the series."""
    return forecast.national(predict_range(*args, **kwargs))


def compare_scenarios(
    history: DataFrame, model: PipelineModel | Rule, spec: PanelSpec, start: Month, periods: int,
    others: Sequence[scenarios.Adjustment], on_problem: str = "raise",
) -> DataFrame:
    """Forecast under the usual weather and under every adjustment of it."""
    base = scenarios.Adjustment(fixed.BASE_SCENARIO)

    def every(asked: DataFrame) -> DataFrame:
        return scenarios.apply_adjustments(futures.from_climatology(history, asked, spec), [base, *others])

    first = _first_day(start)
    months = first.year * 12 + first.month - 1 + periods - 1
    asked, horizon = requested_months(history, spec, first, dt.date(months // 12, months % 12 + 1, 1))
    return _run(history, every(asked), model, spec, horizon, ("scenario",), on_problem=on_problem)


@dataclass
class Training:
    results: DataFrame
    best: str
    params: Mapping
    model: PipelineModel
    path: str


def train(
    panel: DataFrame, spec: PanelSpec, path: str, scope: str = "DRS", version: str = "1.0.0",
    learners: Sequence[learn.Learner] = learn.LEARNERS, points: Callable[[learn.Learner], Sequence[Mapping]] | None = None,
    n_splits: int = 5, on_problem: str = "raise",
) -> Training:
    """Search every learner, compare on the held-out months, refit the best, store everything.

    Writes the model folder, the comparison, the run record and a forecast of
    the next twelve months below ``path``.
    """
    spark = panel.sparkSession
    names = features.feature_names(spec)
    numeric = [n for n in names if n not in spec.series]
    stored = written(features.create_features(panel, spec), "features")
    frame = features.complete_rows(split.period_split(stored, spec), names)
    seen, held = frame.filter(F.col("part") == "train"), frame.filter(F.col("part") == "test")
    points = points or (lambda l: learn.random_points(l.space, learn.RANDOM_POINTS[l.name]))
    candidates = []
    for learner in learners:
        tried = points(learner)
        if len(tried) > 1:
            tried = [learn.best_point(learn.search(seen, spec, numeric, learner, tried, n_splits, key=spec.series[0]))["params"]]
        candidates.append((learner, tried[0]))
    results, _ = learn.compare(seen, held, spec, numeric, candidates, spec.series[0])
    top = learn.best_model(results).first()
    learner, params = next(c for c in candidates if c[0].name == top["model"])
    model = learn.fit(frame, spec, numeric, learner, params, spec.series[0])
    registry.save_model(spark, f"{path}/{scope}", model, names, panel)
    registry.append_run(spark, f"{path}/runs", scope, learner.name, top["rmse"], seen.count(), version, params, names)
    writers.save_csv(learn.ranked(results).drop("params"), f"{path}/comparison")
    writers.save_forecast(forecast_next_year(panel, model, spec, on_problem=on_problem), f"{path}/next_months")
    return Training(results, learner.name, params, model, path)
