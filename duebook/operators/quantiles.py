"""Exact quantiles without gathering a column in one task.

``percentile`` keeps every distinct value of a column in one buffer, which does not hold for amounts at scale. Here the input is read twice. The first
pass makes a KLL sketch of each column, which brackets every wanted rank between two values some half percent of the rows apart. The second counts the rows
below and between the brackets and, inside them, the rows of each value. What it writes is small, and the wanted values are found in it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.session import materialise

#: Bins of one round: what a task sends on for each rank, at most.
BINS = 4096
#: Size of the sketches, whose ranks are off by some 0.1 % of the rows, and what a bracket takes on either side of a rank.
SKETCH, MARGIN = 4096, 0.0025


@dataclass(frozen=True)
class Quantile:
    """One wanted quantile: a name, the column expression and the probability."""

    name: str
    value: Column
    probability: float


def _number(value: Column) -> Column:
    """The value as a double, NaN as null."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def order_statistics(df: DataFrame, values: list[Column], ranks: list[tuple[int, int]], ends: list[tuple], bins: int = BINS,
                     weight: Column | None = None) -> dict[tuple, float]:
    """The value at every wanted (column, rank), ranks from 0; ``ends`` holds the least and greatest value of every column. A row counts ``weight`` times.

    A round counts the rows of every open interval in bins, together with the least and greatest value of a bin, so the interval shrinks to
    values that occur and ends at a single one. Every round is one aggregate that returns at most ``bins`` rows per rank.
    """
    open_, found = {}, {}
    for i, rank in ranks:
        open_[(i, rank)] = (*ends[i], 0)
    while open_:
        for key in [k for k, (low, high, _) in open_.items() if low == high]:
            found[key] = open_.pop(key)[0]
        if not open_:
            break
        spans = sorted({(i, low, high) for (i, _), (low, high, _) in open_.items()})
        entries = []
        for n, (i, low, high) in enumerate(spans):
            v = _number(values[i])
            # Halves keep the width finite for any two doubles.
            width = high / 2 - low / 2
            place = F.floor((v / 2 - F.lit(low / 2)) / F.lit(width) * F.lit(float(bins))) if width > 0 else F.when(v > low, bins - 1).otherwise(0)
            entries.append(F.when(v.between(F.lit(low), F.lit(high)), F.struct(
                F.lit(n).alias("n"), F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"), v.alias("v"))))
        one = F.lit(1) if weight is None else weight
        counted = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e"), one.alias("w")).select("e.*", "w").groupBy("n", "bin").agg(
            F.sum("w").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        of = {}
        for r in sorted(counted, key=lambda r: (r["n"], r["low"])):
            of.setdefault(spans[r["n"]], []).append(r)
        for (i, rank), (low, high, below) in list(open_.items()):
            for r in of[(i, low, high)]:
                if below + r["rows"] > rank:
                    open_[(i, rank)] = (r["low"], r["high"], below)
                    break
                below += r["rows"]
    return found


def _brackets(df: DataFrame, values: list[Column], probabilities: list[list[float]]) -> list[dict]:
    """First pass: rows, extremes and, for each wanted probability, the values around it according to a sketch."""
    facts = [r.asDict() for r in df.agg(*[
        F.struct(F.count(_number(v)).alias("n"), F.min(_number(v)).alias("low"), F.max(_number(v)).alias("high"),
                 F.kll_sketch_agg_double(_number(v), F.lit(SKETCH)).alias("sketch")).alias(f"c{i}") for i, v in enumerate(values)]).first()]
    read = []
    for i, fact in enumerate(facts):
        fact["spans"] = [[fact["low"], fact["high"]] for _ in probabilities[i]]
        for j, p in enumerate(probabilities[i] if fact["n"] else []):
            margin = MARGIN + 2 / fact["n"]
            read += [(i, j, side, at) for side, at in ((0, p - margin), (1, p + margin)) if 0 < at < 1]
    if read:
        asked = df.sparkSession.range(1).select(*[F.kll_sketch_get_quantile_double(F.lit(bytes(facts[i]["sketch"])), F.lit(at)) for i, _, _, at in read])
        for (i, j, side, _), value in zip(read, asked.first()):
            facts[i]["spans"][j][side] = value
    return facts


def _joined(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _counted(df: DataFrame, values: list[Column], spans: list[list[tuple[float, float]]]) -> DataFrame:
    """Second pass: ``column, part, v, rows``. Part 2 * i + 1 of a column is its i-th bracket, in which rows are counted by value; the even ones lie between."""
    entries = []
    for i, v in enumerate(values):
        x, part = _number(v), F.lit(2 * len(spans[i]))
        for j, (low, high) in reversed(list(enumerate(spans[i]))):
            part = F.when(x < F.lit(low), 2 * j).when(x <= F.lit(high), 2 * j + 1).otherwise(part)
        if spans[i]:
            entries.append(F.when(x.isNotNull(), F.struct(F.lit(i).alias("column"), part.alias("part"), F.when(part % 2 == 1, x).alias("v"))))
    rows = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    return rows.groupBy("column", "part", "v").agg(F.count(F.lit(1)).alias("rows"))


def exact_quantile_values(df: DataFrame, wanted: list[Quantile], bins: int = BINS) -> dict[str, float | None]:
    """Every wanted quantile by name, linear interpolation, nulls and NaN skipped; None where a column has no value.

    Reads ``df`` twice. A bracket that the sketch has put beside its rank, which is as good as never, has that rank looked for between the extremes.
    """
    texts, values = [], []
    for q in wanted:  # quantiles of one column share its counts
        if str(q.value) not in texts:
            texts.append(str(q.value))
            values.append(q.value)
    at = {q.name: texts.index(str(q.value)) for q in wanted}
    asked = [sorted({q.probability for q in wanted if at[q.name] == i}) for i in range(len(values))]
    facts = _brackets(df, values, asked)
    place = {q.name: q.probability * (facts[at[q.name]]["n"] - 1) for q in wanted if facts[at[q.name]]["n"]}
    ranks = sorted({(at[name], r) for name, x in place.items() for r in (math.floor(x), math.ceil(x))})
    if not ranks:
        return {q.name: None for q in wanted}
    spans = [_joined([tuple(x) for x in f["spans"]]) if f["n"] else [] for f in facts]
    counted = materialise(_counted(df, values, spans), "quantiles")
    parts = {(r["column"], r["part"]): r for r in counted.groupBy("column", "part").agg(
        F.sum("rows").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    inside, ends, kinds, missed = {}, [], [], []
    for i, rank in ranks:
        below = 0
        for part in range(2 * len(spans[i]) + 1):
            held = parts[i, part]["rows"] if (i, part) in parts else 0
            if below + held > rank:
                break
            below += held
        if part % 2 == 0:
            missed.append((i, rank))
            continue
        if (i, part) not in kinds:
            kinds.append((i, part))
            ends.append((parts[i, part]["low"], parts[i, part]["high"]))
        inside[i, rank] = (kinds.index((i, part)), rank - below)
    columns = [F.when((F.col("column") == i) & (F.col("part") == part), F.col("v")) for i, part in kinds]
    got = order_statistics(counted.where("v IS NOT NULL"), columns, sorted(set(inside.values())), ends, bins, F.col("rows"))
    found = {key: got[x] for key, x in inside.items()}
    if missed:
        found |= order_statistics(df, values, missed, [(f["low"], f["high"]) for f in facts], bins)
    out = {}
    for q in wanted:
        if q.name not in place:
            out[q.name] = None
            continue
        x = place[q.name]
        a, b = found[(at[q.name], math.floor(x))], found[(at[q.name], math.ceil(x))]
        out[q.name] = a + (b - a) * (x - math.floor(x))
    return out


def exact_quantiles(df: DataFrame, wanted: list[Quantile], bins: int = BINS) -> DataFrame:
    """All wanted quantiles as one row with a column per name; null where a column has no value."""
    found = exact_quantile_values(df, wanted, bins)
    return df.sparkSession.range(1).select(*[F.lit(found[q.name]).cast("double").alias(q.name) for q in wanted])


def amount_quantiles(invoices: DataFrame, column: str = "total_open_amount",
                     probabilities: tuple[float, ...] = (0.33, 0.66)) -> DataFrame:
    """Quantiles of the amounts as one row ``q1, q2, ...``."""
    return exact_quantiles(invoices, [Quantile(f"q{i + 1}", F.col(column), p) for i, p in enumerate(probabilities)])


def date_quantile(df: DataFrame, column: str, probability: float) -> DataFrame:
    """Quantile of a date column weighted by rows, as one row with a timestamp ``cutoff``."""
    return date_quantiles(df, column, {"cutoff": probability})


def date_quantiles(df: DataFrame, column: str, probabilities: dict[str, float]) -> DataFrame:
    """Several quantiles of a date column as one row of timestamps.

    Dates are counted per day first, so the exact percentile sees at most one entry per calendar day.
    """
    days = df.where(F.col(column).isNotNull()).groupBy(F.unix_date(F.col(column)).alias("day")).count()
    micros = {n: F.percentile(F.col("day").cast("double"), p, F.col("count")) * F.lit(86_400_000_000.0)
              for n, p in probabilities.items()}
    return days.agg(*[F.timestamp_micros(F.round(m).cast("bigint")).alias(n) for n, m in micros.items()])


def distinct_date_percentiles(df: DataFrame, column: str, probabilities: tuple[float, ...]) -> DataFrame:
    """Percentiles over the distinct dates, one row (percentile, cutoff) each."""
    days = df.where(F.col(column).isNotNull()).select(F.unix_date(F.col(column)).alias("day")).distinct()
    micros = F.percentile(F.col("day").cast("double"), F.array(*[F.lit(p) for p in probabilities]))
    labels = F.array(*[F.lit(round(p * 100)) for p in probabilities])
    return (days.agg(F.arrays_zip(labels.alias("percentile"), micros.alias("day")).alias("rows"))
            .select(F.explode("rows").alias("r"))
            .select(F.col("r.percentile").alias("percentile"),
                    F.timestamp_micros(F.round(F.col("r.day") * F.lit(86_400_000_000.0)).cast("bigint")).alias("cutoff")))
