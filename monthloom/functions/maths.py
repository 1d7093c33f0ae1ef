"""Clamps, guarded ratios and array helpers."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at_least_zero(c: Column | str) -> Column:
    """Clamp below at zero; a null stays null (``greatest`` alone would skip it)."""
    value = _col(c)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))


def between(c: Column | str, low: float, high: float) -> Column:
    value = _col(c)
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def percent_of(part: Column, base: Column) -> Column:
    """``part / base * 100``; null when the base is zero."""
    return part / F.nullif(base, F.lit(0.0)) * F.lit(100.0)


def change_percent(new: Column, base: Column) -> Column:
    return percent_of(new - base, base)


def constant(values: Sequence, kind: str) -> Column:
    """Nested lists of numbers as one constant; an expression for each number would make a plan as large as the list."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often it is looked at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cyclic_pick(values: Column, step: Column) -> Column:
    """Element ``step`` (1-based) of an array repeated without end."""
    return F.get(values, F.pmod(step - 1, F.nullif(F.size(values), F.lit(0))))
