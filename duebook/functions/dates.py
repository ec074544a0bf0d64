"""Date parsing and day arithmetic that never fails on bad input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_yyyymmdd(value: Column) -> Column:
    """20200210, 20200210.0 or their text forms to a date; anything else to null."""
    digits = value.try_cast("double").try_cast("bigint").cast("string")
    dashed = F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 2), F.lit("-"),
                      F.substring(digits, 7, 2))
    return F.when(F.length(digits) == 8, dashed).try_cast("date")


def parse_timestamp(value: Column) -> Column:
    """Free-format timestamp text; unreadable text becomes null."""
    return F.try_to_timestamp(value.cast("string"))


def as_yyyymmdd(day: Column) -> Column:
    """Date to the number YYYYMMDD, the form raw invoices carry."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("double")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def row_date_range(columns: list[Column]) -> tuple[Column, Column, Column]:
    """Earliest date, latest date and the days between them over several columns, skipping nulls."""
    first, last = F.least(*columns), F.greatest(*columns)
    return first, last, F.datediff(last, first)


def any_null(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])
