"""Expressions on a single invoice: money, timing features, label."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from duebook import schema
from duebook.functions.numbers import clip_low


def normalise_category(value: Column) -> Column:
    return F.trim(value.cast("string"))


def to_usd(amount: Column, currency: Column, year: Column) -> Column:
    """CAD amounts at the yearly rate (a default rate for other years); other currencies unchanged."""
    rate = F.coalesce(
        *[F.when(year == y, F.lit(r)) for y, r in schema.CAD_TO_USD.items()],
        F.lit(schema.CAD_TO_USD_DEFAULT),
    )
    return F.when(F.upper(F.trim(currency)) == "CAD", amount * rate).otherwise(amount)


def extract_terms_days(terms: Column) -> Column:
    """All digits of the payment-terms code as a number, 0 without digits."""
    digits = F.regexp_replace(terms, "[^0-9]", "")
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def is_open(paid: Column, at: Column) -> Column:
    return paid.isNull() | (paid > at)


def invoice_age_days(sent: Column, paid: Column, at: Column) -> Column:
    return F.when(is_open(paid, at), F.datediff(at, sent))


def days_until_due(due: Column, paid: Column, at: Column) -> Column:
    return F.when(is_open(paid, at), F.datediff(due, at))


def days_past_due_open(due: Column, paid: Column, at: Column) -> Column:
    """Days past due of an open, overdue invoice, otherwise 0."""
    return F.when(is_open(paid, at) & (at > due), F.datediff(at, due)).otherwise(F.lit(0))


def month_angle(month: Column) -> Column:
    return F.lit(2 * math.pi) * month / F.lit(12)


def amount_log(amount: Column) -> Column:
    return F.log1p(clip_low(amount, 0.0))


def size_category(amount: Column, low: Column, high: Column) -> Column:
    """Right-closed size classes; a null amount has none."""
    small, medium, large = schema.SIZE_LABELS
    return F.when(amount <= low, small).when(amount <= high, medium).when(amount > high, large)


def size_category_fixed(amount: Column) -> Column:
    low, high = schema.SIZE_EDGES
    return size_category(amount, F.lit(low), F.lit(high))


def customer_risk_score(late_ratio: Column, avg_delay: Column) -> Column:
    return (F.lit(0.7) * F.coalesce(late_ratio, F.lit(0.0))
            + F.lit(0.3) * F.coalesce(avg_delay, F.lit(0.0)))


def week_bucket(days: Column, mode: str = "floor0") -> Column:
    """Week of payment: ``floor0`` counts 0..6, ``ceil1`` counts 1..7."""
    if mode == "floor0":
        raw, low, high = F.floor(days / 7), 0, 6
    elif mode == "ceil1":
        raw, low, high = F.ceil(days / 7), 1, 7
    else:
        raise ValueError(f"unknown bucket mode {mode!r}")
    return F.when(days.isNotNull(), F.least(F.greatest(raw, F.lit(low)), F.lit(high))).cast("int")

