"""Helpers of several operators: tables of a folder, text as a column, row numbers, file systems that tasks can write to."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the blank and the five control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch, and the setting that holds them.
BATCH, BATCH_BYTES = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per session, for those that do not have it installed.

    Tasks get their rows in batches of ``BATCH`` bytes where the session has Spark's default, which for texts would fill a worker. A bound in rows would not hold
    where long texts stand side by side, as copies do after a shuffle.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(BATCH))
    context = spark.sparkContext
    if getattr(context, "_duebook_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="duebook-")) / f"duebook-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, f"duebook/{source.relative_to(root)}")
    context.addPyFile(str(archive))
    context._duebook_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def numbered(documents: DataFrame, *columns: str) -> DataFrame:
    """The named columns and ``row``, a number that tells repeated rows apart.

    The number follows from the partition and the place in it, so a lost task that is run again gives the same numbers.
    It holds within one job only.
    """
    return documents.select(*columns).withColumn("row", F.monotonically_increasing_id())


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches of few rows, so that what a task makes of one batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def file_system(uri: str):
    """The Arrow file system of a folder and the path in it; tasks and driver use it for files that are not tables."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


#: Bits of a bitmap of hashes: 16 MB for the driver and every worker, whatever the table.
BITS = 1 << 27


def bitmap(keys: DataFrame, column: str) -> Broadcast:
    """A bitmap of fixed size of the low bits of all values of a column of hashes, for the tasks.

    ``marked`` says of other hashes whether they can be among them: never no for one that is, the more often yes for others the more values there are. So
    tasks drop most of what a join would drop, and the join decides. Nothing that is sent grows with the table.
    """
    at = keys.select(F.col(column).bitwiseAND(F.lit(BITS - 1)).alias("at"))
    words = at.selectExpr("at >> 6 AS word", "shiftleft(1L, CAST(at & 63 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, dtype=np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.astype(np.int64) & np.int64(len(table) * 64 - 1)
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
