"""Rounding and ratio rules shared by all price computations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int = 0) -> Column:
    """Round ties towards plus infinity: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(value * scale + F.lit(0.5)).cast("double") / F.lit(scale)


def currency(value: Column) -> Column:
    return half_up(value, 2)


def one_decimal_percent(part: Column, whole: Column) -> Column:
    """part / whole in percent with one decimal; 0 for an empty whole."""
    return F.when(whole > 0, half_up(part / whole * 100.0, 1)).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """part / whole in percent with two decimals; 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(half_up(part / whole * 100.0, 2))


def positive(value: Column) -> Column:
    """True for a present, finite number above zero; never null."""
    number = value.cast("double")
    return F.coalesce((number > 0) & ~F.isnan(number) & (number != F.lit(float("inf"))), F.lit(False))


def drift_percent(current: Column, live: Column) -> Column:
    """Signed change from current to live, two decimals; null unless both positive."""
    cur, new = current.cast("double"), live.cast("double")
    return F.when(positive(current) & positive(live), half_up((new - cur) / cur * 100.0, 2))


def absolute_delta_percent(current: Column, live: Column) -> Column:
    """Unsigned change, four decimals; null when current is missing or 0, or live is not positive."""
    cur, new = current.cast("double"), live.cast("double")
    return F.when(cur.isNotNull() & (cur != 0) & positive(live), half_up(F.abs(new - cur) / cur * 100.0, 4))


def number_text(text: Column) -> Column:
    """Trimmed text whose first comma became the decimal mark."""
    return F.trim(F.when(F.contains(text, F.lit(",")), F.regexp_replace(text, "^([^,]*),", "$1.")).otherwise(text))


def number_of(cleaned: Column) -> Column:
    """Finite number of a text from ``number_text``; blank counts as 0."""
    number = F.when(cleaned == "", F.lit(0.0)).when(
        cleaned.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), cleaned.try_cast("double")
    )
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def loose_number(text: Column) -> Column:
    """Number from free text: the first comma is the decimal mark, blank counts as 0."""
    return number_of(number_text(text))
