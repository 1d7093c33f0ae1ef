"""Column expressions over the words of a text; no Python runs on the rows.

A word is a run of characters other than the space and U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
_GAP = "[ \\t-\\r]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where lambdas read it many times."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _GAP))


def count_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, _GAP))).cast("long")
