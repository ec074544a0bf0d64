"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "duebook", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` unset and pass nothing: executor sizes, shuffle
    partitions and ``spark.checkpoint.dir`` come from the submit command.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_fallback: str | None = None
_open_scratch: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it then gets a folder of its own.
    """
    global _local_fallback
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_fallback is None:
        _local_fallback = tempfile.mkdtemp(prefix="duebook-")
    return _local_fallback


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder name of the shared folder; nothing is created yet. Inside ``scratch`` the folder goes with the rest."""
    path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    if _open_scratch:
        _open_scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove on exit what ``materialise`` writes inside and the other folders taken there; results must be written or collected by then."""
    written: list[str] = []
    _open_scratch.append(written)
    try:
        yield
    finally:
        _open_scratch[:] = [x for x in _open_scratch if x is not written]
        for path in written:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, purpose: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder, by the values of a column if one is named, and read it back.

    Cuts the lineage of tables with many consumers in a way that survives lost executors.
    """
    path = run_folder(df.sparkSession, purpose)
    (df.repartition(partition_by).write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
