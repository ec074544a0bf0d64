"""Expressions of the collections queue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duebook import schema
from duebook.functions.numbers import round_even


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def risk_category(score: Column) -> Column:
    return F.when(score < 0.20, "Low").when(score < 0.50, "Medium").otherwise("High")


def customer_tier(late_ratio: Column) -> Column:
    return F.when(late_ratio < 0.20, "low").when(late_ratio < 0.60, "medium").otherwise("high")


def days_overdue(until_due: Column) -> Column:
    return F.when(until_due < 0, -until_due).otherwise(F.lit(0))


def is_overdue(until_due: Column) -> Column:
    return F.coalesce(until_due < 0, F.lit(False)).cast("int")


def overdue_multiplier(overdue: Column) -> Column:
    return (F.when(overdue == 0, F.lit(1.0)).when(overdue < 7, F.lit(1.2))
            .when(overdue < 30, F.lit(1.5)).otherwise(F.lit(2.0)))


def priority_score(amount: Column, score: Column, multiplier: Column) -> Column:
    return round_even(amount * score * multiplier, 2)


def bucket_label(bucket: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(schema.BUCKET_LABEL), bucket.cast("int")), F.lit("Medium"))


def label_score(label: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(schema.RISK_SCORE), label), F.lit(3))


def bar_percent(label: Column) -> Column:
    return F.floor(label_score(label) / 6 * 100).cast("int")


def reason_badges(label: Column, overdue: Column, late_ratio: Column, amount: Column,
                  rank: Column, score: Column) -> Column:
    """Why an invoice is in the queue; one default reason when no rule applies."""
    reasons = F.array_compact(F.array(
        F.when(label.isin("Critical", "Very High"), F.concat(label, F.lit(" risk"))),
        F.when(overdue > 30, F.concat(F.format_number(overdue, 0), F.lit(" days overdue"))),
        F.when(late_ratio > 0.5, F.concat(percent_text(late_ratio), F.lit(" historical late rate"))),
        F.when(amount > 50000, F.lit("High invoice value")),
        F.when(rank <= 3, F.concat(F.lit("Priority rank #"), rank.cast("string"))),
    ))
    default = F.array(F.concat(label, F.lit(" risk · week "), score.cast("string")))
    return F.when(F.size(reasons) > 0, reasons).otherwise(default)


def percent_text(ratio: Column) -> Column:
    """Ratio as whole percent, half to even."""
    return F.concat(F.rint(ratio * 100).cast("bigint").cast("string"), F.lit("%"))


def detail_kpi(late_ratio: Column, segment: Column) -> Column:
    return F.when(late_ratio > 0, percent_text(late_ratio)).otherwise(segment)


def option_label(rank: Column, doc_id: Column, amount: Column, label: Column) -> Column:
    return F.concat(F.lit("#"), rank.cast("string"), F.lit("  |  "), doc_id, F.lit("  |  $"),
                    F.format_number(F.rint(amount), 0), F.lit("  |  "), label)


def format_id(value: Column) -> Column:
    """Float-like ids as whole numbers, anything else as it is."""
    text = value.cast("string")
    return F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), text)


def format_date(value: Column) -> Column:
    """Eight digits (also with a trailing .0) as YYYY-MM-DD, anything else as it is."""
    text = value.cast("string")
    digits = text.try_cast("double").try_cast("bigint").cast("string")
    dashed = F.regexp_replace(digits, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(F.length(digits) == 8, dashed).otherwise(text)
