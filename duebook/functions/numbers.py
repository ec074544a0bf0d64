"""Rounding and numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,6)"


def round_even(value: Column, digits: int) -> Column:
    """Round half to even on the scaled double."""
    scale = F.lit(float(10 ** digits))
    return F.rint(value * scale) / scale


def money_sum(value: Column) -> Column:
    """Sum of amounts that does not depend on the order of the rows."""
    return F.sum(value.cast(MONEY)).cast("double")


def money_mean(value: Column) -> Column:
    """Mean from an exact sum: means of whole cents often lie exactly between two cents."""
    return money_sum(value) / F.count(value)


def clip_low(value: Column, low: float) -> Column:
    """Raise to ``low`` but keep null, which ``greatest`` alone would not."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def share(condition: Column) -> Column:
    """Mean of a condition, a null condition counting as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))
