"""Sinks: clean table, history, metrics, predictions, forecast, queue, models."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.operators.cleaning import keep_one
from duebook.operators.history import upsert_history
from duebook.operators.joins import add_missing_columns
from duebook.operators.queue import prediction_records
from duebook.operators.snapshots import features_as_of, population_as_of
from duebook.sources.readers import table_exists


def write_clean(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def history_table(clean: DataFrame, raw: DataFrame, as_of: Column) -> DataFrame:
    """Features at one date, one row per ``doc_id``, with the columns only the raw table has."""
    featured = features_as_of(clean, population_as_of(clean, as_of)).drop("reference_date")
    first = ["invoice_sent", "invoice_paid", "total_open_amount", "cust_number"]
    rest = [c for c in featured.columns if c not in first]
    one_each = keep_one(featured, "doc_id", [F.col(c) for c in first + rest])
    return add_missing_columns(one_each, raw.withColumn("doc_id", F.col("doc_id").cast("bigint")))


def write_history(clean: DataFrame, raw: DataFrame, as_of: Column, path: str) -> None:
    """Column names of the raw table may hold blanks and dots, which parquet accepts."""
    history_table(clean, raw, as_of).write.mode("overwrite").parquet(path)


def write_upserted_history(history: DataFrame, batch: DataFrame, features: DataFrame | None, path: str) -> None:
    """Write the merged history to a new folder; it must not be the folder it is read from."""
    upsert_history(history, batch, features).write.mode("errorifexists").parquet(path)


def write_metrics(metrics: DataFrame, root: str, run: str) -> None:
    """Metrics of one run as JSON in a folder named after the run."""
    metrics.write.mode("overwrite").json(f"{root}/run={run}")


def write_predictions(scored: DataFrame, path: str) -> None:
    prediction_records(scored).write.mode("overwrite").json(path)


def write_records(df: DataFrame, path: str) -> None:
    """Forecast and queue rows as JSON records."""
    df.write.mode("overwrite").json(path)


def stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S-%f")


def save_model(model: PipelineModel, root: str, version: str | None = None) -> str:
    """Save under a sortable version name and return the path."""
    path = f"{root}/{version or stamp()}"
    model.write().save(path)
    return path


def load_latest_model(spark: SparkSession, root: str) -> PipelineModel | None:
    """The model with the last version name, or None when none is saved."""
    if not table_exists(spark, root):
        return None
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory())
    return PipelineModel.load(f"{root}/{versions[-1]}") if versions else None


def _each_text(folder: str, suffix: str):
    """Task function: every text of a task as a file in a folder of this attempt; needs nothing of the package."""
    def write(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        own, files, n = f"{folder}/part-{uuid.uuid4().hex}", None, 0
        for batch in batches:
            if files is None and batch.num_rows:
                local = "://" not in own and not own.startswith("file:")
                files, path = ((fs.LocalFileSystem(), own) if local else (fs.LocalFileSystem(), "/" + own.removeprefix("file:").lstrip("/"))
                               if own.startswith("file:") else fs.FileSystem.from_uri(own))
                files.create_dir(path, recursive=True)
            for value in batch.column(0):
                with files.open_output_stream(f"{path}/{n}{suffix}", compression=None, buffer_size=None) as out:
                    out.write((value.as_py() or "").encode() + b"\n")
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"folder": pa.array([own], pa.string()), "files": pa.array([n], pa.int64())})
    return write


def write_texts(texts: DataFrame, folder: str, suffix: str = ".txt") -> list[str]:
    """Every text, and a line end, as a file of its own; returns the folders of the files, one for each task.

    Tasks write the files where they stay. The commit of Spark's writers moves every file once more, on the driver alone, and sets the rights of each. An attempt has a folder of its
    own, so files of attempts that failed are in none of the folders returned. Null text is empty.
    """
    written = texts.select(texts.columns[0]).mapInArrow(_each_text(folder, suffix), "folder string, files long")
    return sorted(r["folder"] for r in written.collect())
