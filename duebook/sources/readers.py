"""Readers of invoices, history and playbook."""

from __future__ import annotations

import csv
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook import schema
from duebook.session import materialise
from duebook.sources.arrival import ARRIVAL, with_arrival

FORMATS = ("csv", "parquet", "orc", "json")


def read_invoices(spark: SparkSession, path: str, fmt: str = "csv",
                  table: T.StructType = schema.RAW_INVOICE) -> DataFrame:
    """Raw invoices with a fixed schema; no inference pass over the data."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read.schema(table)
    if fmt == "csv":
        return _read_csv(spark, path, table)
    return reader.format(fmt).load(path)


def _first_lines():
    """Task function: the first line of a task's part of a file, if the part begins the file; the rest is not read."""
    def first(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                if batch.column("start")[0].as_py() == 0:
                    yield batch.select(["file", "header"]).slice(0, 1)
                return
    return first


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """``file, header`` of every CSV file that has lines, as a written table. Each file is a task of its own, which ends after the first line."""
    settings = {"spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes"), "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                         F.col("value").alias("header"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return materialise(lines.mapInArrow(_first_lines(), "file string, header string"), "headers")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _fields(header: str, table: T.StructType) -> T.StructType:
    """The columns of a header line, stripped, with the types that the table gives them, else text."""
    by_name = {f.name: f.dataType for f in table.fields}
    names = [n.strip() for n in next(csv.reader([header], escapechar="\\"), [])]
    told = [n if n and names.count(n) == 1 else f"{n or '_c'}{i}" for i, n in enumerate(names)]
    return T.StructType([T.StructField(n, by_name.get(n, T.StringType())) for n in told])


def _read_csv(spark: SparkSession, path: str, table: T.StructType, arrival: bool = False) -> DataFrame:
    """Columns are matched by their header names. Files of one header, however many, are one plain scan.

    Where headers differ, lines meet the header of their file in a join with the table of files, and each kind of header parses its own lines. The driver sees the
    different headers, not the files. A line that repeats its file's header counts as one.
    """
    headers = file_headers(spark, path)
    kinds = [r["header"] for r in headers.select("header").distinct().orderBy("header").collect()]
    if len(kinds) <= 1:
        fields = _fields(kinds[0], table) if kinds else table
        df = spark.read.schema(fields).option("header", True).option("mode", "PERMISSIVE").csv(path)
        return with_arrival(df) if arrival else df
    lines = with_arrival(spark.read.text(path).withColumn("file", F.col("_metadata.file_path")))
    known = lines.join(headers, "file").where((F.col("value") != F.col("header")) & (F.trim("value") != ""))
    parsed = {k: F.when(F.col("header") == k, F.from_csv("value", _ddl(_fields(k, table)), {"mode": "PERMISSIVE"}))
              for k in kinds}
    rows = known.select(ARRIVAL, *[x.alias(f"_k{i}") for i, x in enumerate(parsed.values())])
    columns: dict[str, list[Column]] = {}
    for i, k in enumerate(kinds):
        for f in _fields(k, table).fields:
            columns.setdefault(f.name, []).append(F.col(f"_k{i}").getField(f.name))
    out = rows.select(*[F.coalesce(*x).alias(c) for c, x in columns.items()], ARRIVAL)
    return out if arrival else out.drop(ARRIVAL)


def _ddl(fields: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields.fields)


def read_uploaded_batch(spark: SparkSession, landing: str, arrival: bool = False) -> DataFrame:
    """All CSV files of a landing folder as one batch; with ``arrival`` the order of its rows too, for upserts."""
    return _read_csv(spark, landing, schema.RAW_INVOICE, arrival)


def read_history(spark: SparkSession, path: str, seed: DataFrame | None = None) -> DataFrame:
    """The invoice history with date and string types; an absent history starts from ``seed``."""
    if not table_exists(spark, path):
        if seed is None:
            raise FileNotFoundError(f"no history at {path} and no clean table to start from")
        seed.write.parquet(path)
    df = spark.read.parquet(path)
    for c in ("invoice_sent", "due_in_date", "invoice_paid"):
        df = df.withColumn(c, F.col(c).cast("date"))
    return df.withColumn("cust_number", F.col("cust_number").cast("string"))


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_playbook(spark: SparkSession, folder: str | list[str], pattern: str = "*.md") -> DataFrame:
    """Whole Markdown files of a folder, or of several, with the file name as ``source`` and their path."""
    return (spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source"),
                    F.col("value").alias("text")))
