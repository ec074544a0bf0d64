"""Time-based splits of the snapshot table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duebook import schema
from duebook.operators.numbering import with_positions
from duebook.operators.quantiles import date_quantile, date_quantiles, distinct_date_percentiles


def utc_day(cutoff: Column) -> Column:
    """The UTC calendar day of a cutoff, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(cutoff) / F.lit(86_400_000_000)).cast("int"))


def time_split(snapshots: DataFrame, probability: float = 0.8, column: str = "invoice_sent") -> DataFrame:
    """Mark each row 'train' or 'test' by its reference date against a row-weighted date quantile."""
    cutoff = utc_day(F.lit(date_quantile(snapshots, column, probability).first()["cutoff"]))
    return snapshots.withColumn("part", F.when(F.col("reference_date") <= cutoff, "train").otherwise("test"))


def sort_by_sent(invoices: DataFrame, ties: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Invoices by the date they were sent, those without one first, ties by the given columns; for output only, no operator relies on the order of rows."""
    return invoices.orderBy(F.asc_nulls_first("invoice_sent"), *ties)


def train_valid_test(snapshots: DataFrame, column: str = "reference_date") -> DataFrame:
    """Three parts at the 60 and 80 percent date quantiles and the fold column for a predefined split.

    Training rows have fold -1 and never validate, validation rows fold 0; test rows have none.
    """
    cuts = date_quantiles(snapshots, column, {"q60": 0.6, "q80": 0.8}).first()
    at = F.col("reference_date")
    part = (F.when(at <= utc_day(F.lit(cuts["q60"])), "train")
            .when(at <= utc_day(F.lit(cuts["q80"])), "valid").otherwise("test"))
    fold = F.when(F.col("part") == "train", -1).when(F.col("part") == "valid", 0)
    return snapshots.withColumn("part", part).withColumn("fold", fold.cast("int"))


def backtest_folds(snapshots: DataFrame,
                   percentiles: tuple[float, ...] = schema.BACKTEST_PERCENTILES) -> DataFrame:
    """The walk-forward cutoffs: percentiles over the distinct reference dates."""
    return distinct_date_percentiles(snapshots, "reference_date", percentiles)


def in_fold(cutoff: Column, weeks: int = 6) -> tuple[Column, Column]:
    """Conditions for the training part and the test part of a cutoff.

    Reference dates have no time of day, so the cutoff's date decides, and the plain date comparison reaches the scan.
    """
    at, day = F.col("reference_date"), utc_day(cutoff)
    return at <= day, (at > day) & (at <= F.date_add(day, 7 * weeks))


def backtest_windows(snapshots: DataFrame, weeks: int = 6,
                     percentiles: tuple[float, ...] = schema.BACKTEST_PERCENTILES) -> DataFrame:
    """Each snapshot row once per cutoff whose training or test part it belongs to.

    The handful of cutoffs is fetched and compared as constants, so no join is needed and only the parts that a row belongs to are made.
    """
    parts = []
    for fold in backtest_folds(snapshots, percentiles).collect():
        cutoff = F.lit(fold["cutoff"])
        train, test = in_fold(cutoff, weeks)
        parts.append(F.when(train | test, F.struct(F.lit(fold["percentile"]).alias("percentile"), cutoff.alias("cutoff"),
                                                   F.when(train, "train").otherwise("test").alias("part"))))
    return snapshots.select(*[F.col(f"`{c}`") for c in snapshots.columns], F.explode(F.array_compact(F.array(*parts))).alias("_f")).select(
        *[F.col(f"`{c}`") for c in snapshots.columns], "_f.*")


def time_series_folds(df: DataFrame, column: str = "reference_date", splits: int = 5) -> DataFrame:
    """Expanding windows over rows in date order: row counts and boundary dates of each fold.

    The test parts have ``rows // (splits + 1)`` rows each, the first training part takes the remainder.
    Rows are counted per day first, so the running sum is over calendar days.
    """
    days = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    running = days.withColumn("upto", F.sum("n").over(Window.orderBy("day")))
    total = days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    size = F.lit(total // (splits + 1)).cast("bigint")
    fold = F.explode(F.sequence(F.lit(1), F.lit(splits)))
    marked = running.withColumn("fold", fold).withColumn("test_rows", size) \
        .withColumn("train_rows", F.lit(total).cast("bigint") - (splits + 1 - F.col("fold")) * size)
    start, end = F.col("train_rows"), F.col("train_rows") + F.col("test_rows")
    return marked.groupBy("fold", "train_rows", "test_rows").agg(
        F.min(F.when(F.col("upto") >= start, F.col("day"))).alias("train_end"),
        F.min(F.when(F.col("upto") >= start + 1, F.col("day"))).alias("test_start"),
        F.min(F.when(F.col("upto") >= end, F.col("day"))).alias("test_end"))


def time_series_rows(df: DataFrame, order: list[str], splits: int = 5) -> DataFrame:
    """``df`` with ``test_fold``, the fold whose test part holds the row; a fold trains on all rows of smaller ``test_fold``.

    Rows are in the order of the given columns, inside a day too, so the parts have exactly ``rows // (splits + 1)`` rows each; the first training part, fold 0,
    takes the remainder. The columns should tell rows apart.

    Only these columns are dealt out and numbered; a row's fold follows from the first rows of the folds, which are fetched. Where one of them is equal to a row
    of the fold before, whole rows are numbered. ``df`` is read several times: pass a written table.
    """
    keys = with_positions(df.select(*order), [F.col(c) for c in order], "_position")
    total = keys.count()
    size = total // (splits + 1)
    first = total - splits * size
    key = F.struct(*[F.col(f"`{c}`") for c in order])
    if size:
        starts = [first + i * size for i in range(splits)]
        begin = sorted(keys.where(F.col("_position").isin(starts)).collect(), key=lambda r: r["_position"])
        bounds = [F.struct(*[F.lit(r[c]).cast(df.schema[c].dataType).alias(c) for c in order]) for r in begin]
        before = keys.agg(*[F.count_if(key < b).alias(f"_{i}") for i, b in enumerate(bounds)]).first()
        if list(before) == starts:
            return df.withColumn("test_fold", sum([(key >= b).cast("int") for b in bounds[1:]], (key >= bounds[0]).cast("int")))
    placed = with_positions(df, [F.col(c) for c in order], "_position")
    fold = F.when(F.col("_position") < first, 0).otherwise(F.floor((F.col("_position") - first) / max(size, 1)) + 1)
    return placed.withColumn("test_fold", fold.cast("int")).drop("_position")


def fold_parts(marked: DataFrame, splits: int = 5) -> list[tuple[DataFrame, DataFrame]]:
    """Training and validation rows of each fold of ``time_series_rows``."""
    return [(marked.where(F.col("test_fold") < k).drop("test_fold"), marked.where(F.col("test_fold") == k).drop("test_fold")) for k in range(1, splits + 1)]
