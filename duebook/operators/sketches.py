"""Profiles that are kept as state: sketches of each batch, which merge instead of reading earlier batches again.

KLL sketches answer quantiles, HyperLogLog sketches distinct counts, both within a stated tolerance; the exact operators stand beside them
(``exact_quantiles``, ``distinct_counts``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a quantile sketch; ranks read from it are off by some 0.2 % of the rows, with probability 0.99.
QUANTILE_SIZE = 2048
#: Binary logarithm of the registers of a distinct count, whose standard error is 1.04 / sqrt(2 ** this) = 0.8 %.
DISTINCT_SIZE = 14


def batch_sketches(rows: DataFrame, numbers: list[str], keys: list[str], batch: Column) -> DataFrame:
    """``batch, column_name, rows, present, low, high, quantiles, distinct``: one row for each batch and column.

    ``numbers`` get quantile sketches, ``numbers`` and ``keys`` distinct counts of their values as text. Nulls and NaN count as absent. One aggregate over
    the batch, whatever the number of columns; its state is bounded, so a large batch sends one row per task.
    """
    def known(c: str) -> Column:
        return F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) if c in numbers else F.col(f"`{c}`")
    columns = [*numbers, *[k for k in keys if k not in numbers]]
    facts = []
    for c in columns:
        v, number = known(c), c in numbers
        facts.append(F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("rows"), F.count(v).alias("present"),
            (F.min(v) if number else F.lit(None)).cast("double").alias("low"), (F.max(v) if number else F.lit(None)).cast("double").alias("high"),
            (F.kll_sketch_agg_double(v, F.lit(QUANTILE_SIZE)) if number else F.lit(None).cast("binary")).alias("quantiles"),
            F.hll_sketch_agg(v.cast("string"), F.lit(DISTINCT_SIZE)).alias("distinct")))
    return rows.groupBy(batch.alias("batch")).agg(F.array(*facts).alias("facts")).select("batch", F.explode("facts").alias("f")).select("batch", "f.*")


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketches of all batches of a column as one row, or of each value of ``by``."""
    return sketches.groupBy(*by, "column_name").agg(
        F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def approximate_quantiles(merged: DataFrame, probabilities: tuple[float, ...]) -> DataFrame:
    """``column_name, probability, value`` of the columns with numbers; the extremes are exact, a column without values has none."""
    def read(p: float) -> Column:
        inner = F.kll_sketch_get_quantile_double("quantiles", F.lit(p)) if 0 < p < 1 else F.col("low" if p <= 0 else "high")
        return F.struct(F.lit(p).alias("probability"), inner.alias("value"))
    known = merged.where("quantiles IS NOT NULL AND present > 0 AND low IS NOT NULL")
    return known.select("column_name", F.explode(F.array(*map(read, probabilities))).alias("q")).select("column_name", "q.*")


def approximate_distinct(merged: DataFrame) -> DataFrame:
    """``column_name, rows, present, distinct_values``."""
    return merged.select("column_name", "rows", "present", F.hll_sketch_estimate("distinct").alias("distinct_values"))


def add_batch(root: str, sketches: DataFrame, name: str) -> None:
    """Keep the sketches of a batch under a name; a repeated batch overwrites its own."""
    sketches.write.mode("overwrite").parquet(f"{root}/name={name}")


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", root).parquet(root)
