"""In which order rows have arrived: by the time of their file, its path, the part of the file, the place in the part."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARRIVAL = "_arrival"


def file_order() -> Column:
    """Time and path of a row's file and where its part begins; only right on a table that is read from files."""
    meta = F.col("_metadata")
    return F.struct(meta["file_modification_time"].alias("time"), meta["file_path"].alias("path"), meta["file_block_start"].alias("start"))


def with_arrival(df: DataFrame) -> DataFrame:
    """``df`` with its order of arrival as ``_arrival``, a struct that sorts; a table that has one keeps it.

    Spark packs files into tasks by size, so the place within the plan does not follow the files. Rows of one part of a file are read in a row by
    one task, so there the place does. A table that comes from no file is ordered by its place in the plan.
    """
    place = F.monotonically_increasing_id()
    if ARRIVAL in df.columns:
        if "place" in df.schema[ARRIVAL].dataType.fieldNames():
            return df
        return df.withColumn(ARRIVAL, F.col(ARRIVAL).withField("place", place))
    try:
        read = with_file_order(df)
    except AnalysisException:
        none = F.struct(F.lit(None).cast("timestamp").alias("time"), F.lit("").alias("path"), F.lit(0).cast("long").alias("start"))
        read = df.withColumn(ARRIVAL, none)
    return read.withColumn(ARRIVAL, F.col(ARRIVAL).withField("place", place))


def with_file_order(df: DataFrame) -> DataFrame:
    """As ``with_arrival``, without the place; for streams, which number rows per batch."""
    return df if ARRIVAL in df.columns else df.select("*", file_order().alias(ARRIVAL))
