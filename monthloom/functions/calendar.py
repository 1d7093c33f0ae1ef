"""Month arithmetic and month texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from monthloom.functions.fixed import MONTHS_EN, MONTHS_FR, MONTHS_SHORT_FR


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(c: Column | str) -> Column:
    """First day of the month of a date, timestamp or ISO text."""
    return F.trunc(_col(c).cast("date"), "month")


def add_months(c: Column | str, n: int | Column) -> Column:
    return F.add_months(_col(c), n)


def months_apart(later: Column | str, earlier: Column | str) -> Column:
    """Whole months from one month start to another."""
    return F.months_between(month_start(later), month_start(earlier)).cast("int")


def month_number(c: Column | str) -> Column:
    """Running month number, comparable across years."""
    return F.year(_col(c)) * 12 + F.month(_col(c)) - 1


def month_list(start: Column, end: Column) -> Column:
    """Array of month starts, both ends included."""
    return F.sequence(month_start(start), month_start(end), F.expr("interval 1 month"))


def months_from(start: Column, periods: int | Column) -> Column:
    """Array of ``periods`` month starts beginning with ``start``."""
    count = periods if isinstance(periods, Column) else F.lit(periods)
    return month_list(start, F.add_months(month_start(start), count - 1))


def _name_map(values) -> Column:
    pairs = [F.lit(v) for item in values for v in item]
    return F.create_map(*pairs)


def month_of_french_name(name: Column) -> Column:
    return _name_map(zip(MONTHS_FR, range(1, 13)))[name]


def french_month_text(c: Column | str) -> Column:
    """``Janvier 2021`` for a date; the inverse of ``parse_french_month``."""
    names = F.array(*[F.lit(m) for m in MONTHS_FR])
    return F.concat_ws(" ", F.element_at(names, F.month(_col(c))), F.year(_col(c)).cast("string"))


def english_month_text(c: Column | str) -> Column:
    """Swap the French month name for the English one, keep the rest."""
    parts = F.split(_col(c), " ", 2)
    known = _name_map(zip(MONTHS_FR, MONTHS_EN))[F.get(parts, 0)]
    return F.concat_ws(" ", F.coalesce(known, F.get(parts, 0)), F.get(parts, 1))


def parse_english_month(c: Column | str) -> Column:
    """``January 2021`` to a month start; null when it does not parse."""
    return F.try_to_timestamp(_col(c), F.lit("MMMM yyyy")).cast("date")


def split_month_year(c: Column | str) -> tuple[Column, Column]:
    parts = F.split(_col(c), " ")
    return F.get(parts, 0), F.get(parts, 1).try_cast("int")


def parse_french_month(c: Column | str) -> Column:
    """``Janvier 2021`` to a month start without any text round trip; null when it does not parse."""
    name, year = split_month_year(c)
    return F.make_date(year, month_of_french_name(name), F.lit(1))


def or_fail(parsed: Column, c: Column | str, what: str) -> Column:
    """The parsed value; a text that is there but did not parse fails the job and is named."""
    text = _col(c)
    unreadable = text.isNotNull() & parsed.isNull()
    failed = F.raise_error(F.concat(F.lit(f"unreadable {what}: "), text.cast("string")))
    return F.when(unreadable, failed.cast("void")).otherwise(parsed)


def month_key(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def day_key(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def month_label(c: Column | str) -> Column:
    """``Jan 2025`` with French short names."""
    names = F.array(*[F.lit(m) for m in MONTHS_SHORT_FR])
    return F.concat_ws(" ", F.element_at(names, F.month(_col(c))), F.year(_col(c)).cast("string"))


def cyclic_sin(month: Column) -> Column:
    return F.sin(F.lit(2.0) * F.pi() * month / F.lit(12.0))


def cyclic_cos(month: Column) -> Column:
    return F.cos(F.lit(2.0) * F.pi() * month / F.lit(12.0))
