"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero or null (ANSI mode would raise)."""
    return F.try_divide(a, b)


def change(now: Column, base: Column) -> Column:
    return F.try_divide(now, base) - 1


def growth(now: Column, base: Column) -> Column:
    """Growth rate, null when the base is not positive."""
    return F.when(base > 0, now / base - 1)


def clean_number(c: Column) -> Column:
    """NaN and infinities become null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def round_to_tick(c: Column, tick: float) -> Column:
    return F.bround(c / F.lit(tick), 0) * F.lit(tick)


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison: the nudge keeps exact ties from depending on the rounding rule, zero removes -0.0."""
    return F.round(c + F.lit(1e-9), digits) + F.lit(0.0)
