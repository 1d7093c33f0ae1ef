"""Label, name and number texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from monthloom.functions import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_name(c: Column | str, prefix: str = "DRS ") -> Column:
    return F.replace(_col(c), F.lit(prefix), F.lit(""))


def safe_name(c: Column | str) -> Column:
    """Slashes, backslashes and blanks become underscores (file-name safe)."""
    return F.translate(_col(c), "/\\ ", "___")


def before_parenthesis(c: Column | str) -> Column:
    return F.substring_index(_col(c), " (", 1)


def grouped_integer(c: Column | str) -> Column:
    """Half-even integer with thin-space thousands; a dash if not a number."""
    value = _col(c).try_cast("double")
    usable = value.isNotNull() & ~F.isnan(value)
    text = F.replace(
        F.format_number(F.bround(value, 0), 0), F.lit(","), F.lit(fixed.THIN_SPACE)
    )
    # a small negative rounds to zero, which carries no sign
    return F.when(usable, F.when(text == "-0", "0").otherwise(text)).otherwise(fixed.NO_VALUE)


def feature_family(name: Column | str, key_prefix: str = "cat__") -> Column:
    """Family of an encoded feature name (``cat__...`` or ``num__...``)."""
    full = _col(name)
    bare = F.replace(full, F.lit("num__"), F.lit(""))
    return (
        F.when(full.startswith(key_prefix), fixed.FAMILY_KEY)
        .when(bare.startswith("target_lag") | bare.startswith("target_roll"), fixed.FAMILY_HISTORY)
        .when(bare.isin(*fixed.WEATHER_COLUMNS), fixed.FAMILY_WEATHER)
        .otherwise(fixed.FAMILY_CALENDAR)
    )


def feature_label(name: Column | str, key_prefix: str = "cat__DRS_DRS ") -> Column:
    """Encoded feature name without its block prefix; ``key_prefix`` is what stands before the key's value."""
    bare = F.replace(_col(name), F.lit("num__"), F.lit(""))
    return F.replace(bare, F.lit(key_prefix), F.lit(fixed.KEY_LABEL_PREFIX))
