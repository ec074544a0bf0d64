"""Expressions on an array of seven class probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from duebook import schema
from duebook.functions.numbers import round_even


def entries(p: Column) -> list[Column]:
    """The seven entries as plain columns, which stay inside generated code, unlike array lambdas."""
    return [p.getItem(c) for c in range(schema.N_CLASSES)]


def added(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)


def sharpen(p: Column, temperature: float = schema.TEMPERATURE) -> Column:
    """Temperature scaling: clip, raise to 1/T, renormalise the row."""
    powered = [F.pow(F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0)), F.lit(1 / temperature)) for x in entries(p)]
    row = added(powered)
    return F.array(*[x / row for x in powered])


def tilt(p: Column, weights: Column) -> Column:
    """Multiply by class weights and renormalise; an all-zero row stays zero."""
    weighted = [x * w for x, w in zip(entries(p), entries(weights))]
    row = added(weighted)
    return F.array(*[x / F.when(row == 0, F.lit(1.0)).otherwise(row) for x in weighted])


def soft_vote(members: list[Column], weights: list[Column]) -> Column:
    """Weighted mean of the members' probabilities."""
    weight_sum = added(weights)
    return F.array(*[
        added([m.getItem(c) * w for m, w in zip(members, weights)]) / weight_sum for c in range(schema.N_CLASSES)])


def expected_cash(amount: Column, p: Column) -> Column:
    """Cash expected in weeks 1..6, rounded per invoice to cents."""
    return F.array(*[round_even(amount * p.getItem(w - 1), 2) for w in schema.FORECAST_WEEKS])


def predicted_class(p: Column) -> Column:
    """0-based class of the first maximum."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def class_probability(p: Column) -> Column:
    return F.array_max(p)


def risk_score(p: Column) -> Column:
    return p.getItem(4) + p.getItem(5) + p.getItem(6)


def paid_soon_score(p: Column) -> Column:
    return p.getItem(0) + p.getItem(1)


def pad_classes(p: Column, classes: Column) -> Column:
    """Spread probabilities given for ``classes`` (0-based) over all seven; absent classes get 0."""
    return F.array(*[
        F.coalesce(F.try_element_at(p, F.nullif(F.array_position(classes, c), F.lit(0)).cast("int")), F.lit(0.0))
        for c in range(schema.N_CLASSES)
    ])


def spread(p: Column, prefix: str = "p_") -> list[Column]:
    """One column per class, named 1..7."""
    return [p.getItem(c).alias(f"{prefix}{c + 1}") for c in range(schema.N_CLASSES)]


def in_top_k(p: Column, label: Column, k: int) -> Column:
    """True when fewer than ``k`` classes rank before the true one (ties: the higher class first)."""
    truth = p[label]
    before = [((x > truth) | ((x == truth) & (F.lit(c) > label))).cast("int") for c, x in enumerate(entries(p))]
    return added(before) < k


def valid(p: Column) -> Column:
    """Seven entries, each within [0, 1], summing to 1 up to 1e-6."""
    return ((F.size(p) == schema.N_CLASSES)
            & F.forall(p, lambda x: (x >= 0) & (x <= 1))
            & (F.abs(total(p) - 1) <= 1e-6))
