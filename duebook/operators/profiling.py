"""Profiles of a table: nulls, frequencies, distributions, correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook.operators.quantiles import Quantile, exact_quantiles


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _long(row: DataFrame, entries: list[Column]) -> DataFrame:
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and percent of every column in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(q(c).isNull()).alias(c) for c in df.columns])
    return _long(counts, [
        F.struct(F.lit(c).alias("column_name"), q(c).alias("nulls"),
                 F.try_divide(q(c) * 100.0, F.col("_n")).alias("null_percent")) for c in df.columns])


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of numeric columns, one row each."""
    columns = columns or numeric_columns(df)
    basics = df.agg(*[F.struct(F.count(q(c)).alias("count"), F.avg(q(c)).alias("mean"),
                               F.stddev_samp(q(c)).alias("std"), F.min(q(c)).cast("double").alias("min"),
                               F.max(q(c)).cast("double").alias("max")).alias(c) for c in columns])
    quartiles = exact_quantiles(df, [Quantile(f"{c}|{p}", q(c), p / 100) for c in columns for p in (25, 50, 75)])
    found = quartiles.first()
    entries = []
    for c in columns:
        s = q(c)
        entries.append(F.struct(
            F.lit(c).alias("column_name"), s.getField("count").alias("count"), s.getField("mean").alias("mean"),
            s.getField("std").alias("std"), s.getField("min").alias("min"),
            *[F.lit(found[f"{c}|{p}"]).cast("double").alias(f"q{p}") for p in (25, 50, 75)],
            s.getField("max").alias("max")))
    return _long(basics, entries)


def value_counts(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Frequency of every value, null included."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(q(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, quasi: float = 0.99) -> DataFrame:
    """Distinct non-null values of each column, whether it is constant, and whether one value dominates.

    Values are counted as (column, value) pairs, so frequent values shrink before the shuffle.
    """
    columns = columns or df.columns
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), q(c).cast("string").alias("value")) for c in columns])).alias("e"))
    counted = pairs.select("e.*").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    summary = counted.groupBy("column_name").agg(
        F.count("value").alias("distinct_values"), F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n"))
    return summary.select("column_name", "distinct_values", (F.col("distinct_values") <= 1).alias("is_constant"),
                          F.coalesce(F.col("top") >= quasi * F.col("n"), F.lit(True)).alias("is_quasi_constant"))


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return distinct_counts(df, columns).where("is_constant").select("column_name", "distinct_values")


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 50) -> DataFrame:
    """Rows per equal-width bin between the extremes of each numeric column, NaN left out; the last bin is closed."""
    columns = columns or numeric_columns(df)
    def number(c: str) -> Column:
        value = q(c).cast("double")
        return F.when(~F.isnan(value), value)
    ends = df.agg(F.struct(*[F.struct(F.min(number(c)).alias("low"), F.max(number(c)).alias("high"))
                             .alias(c) for c in columns]).alias("s")).first()["s"]
    entries = []
    for c in columns:
        value = number(c)
        low, high = F.lit(ends[c]["low"]).cast("double"), F.lit(ends[c]["high"]).cast("double")
        position = F.when(high > low, F.floor((value - low) * F.lit(float(bins)) / (high - low))).otherwise(0)
        entries.append(F.struct(F.lit(c).alias("column_name"),
                                F.when(value.isNotNull(), F.least(position, F.lit(bins - 1))).cast("int").alias("bin")))
    return (df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("bin").isNotNull())
            .groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("n")))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every ordered pair of numeric columns, pairwise without nulls, in one aggregate."""
    columns = columns or numeric_columns(df)
    pairs = list(combinations(columns, 2))
    names = [f"_c{i}" for i in range(len(pairs))]
    row = df.agg(*[F.corr(q(a).cast("double"), q(b).cast("double")).alias(n) for n, (a, b) in zip(names, pairs)],
                 *[F.stddev_pop(q(c).cast("double")).alias(f"_s{i}") for i, c in enumerate(columns)])
    entries = []
    for n, (a, b) in zip(names, pairs):
        for x, y in ((a, b), (b, a)):
            entries.append(F.struct(F.lit(x).alias("feature_1"), F.lit(y).alias("feature_2"), F.col(n).alias("correlation")))
    for i, c in enumerate(columns):
        entries.append(F.struct(F.lit(c).alias("feature_1"), F.lit(c).alias("feature_2"),
                                F.when(F.col(f"_s{i}") > 0, F.lit(1.0)).alias("correlation")))
    return _long(row, entries)


def top_correlated_pairs(matrix: DataFrame, n: int = 30) -> DataFrame:
    """The pairs with the largest absolute correlation, self pairs left out."""
    return (matrix.where(F.col("feature_1") != F.col("feature_2"))
            .withColumn("absolute_correlation", F.abs("correlation"))
            .orderBy(F.desc_nulls_last("absolute_correlation"), "feature_1", "feature_2").limit(n))


def date_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    days = df.select(*[F.unix_date(q(c)).cast("double").alias(c) for c in columns])
    return correlation_matrix(days, columns)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, and the distinct rows."""
    distinct = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return distinct.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
                        F.count(F.lit(1)).alias("distinct_rows"))


def equal_column_count(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.count_if(q(a) == q(b)).alias("equal_rows"))


def open_closed_counts(df: DataFrame, column: str = "isOpen") -> DataFrame:
    return df.agg(F.count_if(q(column) == 1).alias("open_invoices"), F.count_if(q(column) == 0).alias("closed_invoices"))


def variance_threshold(df: DataFrame, columns: list[str], threshold: float = 0.05) -> DataFrame:
    """Population variance of each feature and whether it exceeds the threshold."""
    row = df.agg(*[F.var_pop(q(c)).alias(c) for c in columns])
    return _long(row, [F.struct(F.lit(c).alias("feature"), q(c).alias("variance"),
                                F.coalesce(q(c) > threshold, F.lit(False)).alias("kept")) for c in columns])


