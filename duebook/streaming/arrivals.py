"""Streams over landing folders: scoring, history upkeep, weekly cash."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from duebook.operators.cleaning import keep_one
from duebook.operators.forecast import payment_week
from duebook.operators.history import union_history
from duebook.operators.snapshots import Population
from duebook.plans.scoring import score_batch
from duebook.session import materialise
from duebook.sources.arrival import ARRIVAL, with_arrival, with_file_order
from duebook.sources.ledger import Ledger


def landing(spark: SparkSession, path: str, table: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    reader = spark.readStream.schema(table).format(fmt)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def stream_score(source: DataFrame, population: Population, model: PipelineModel, out: str, checkpoint: str) -> StreamingQuery:
    """Clean, feature and score every arriving batch of raw invoices.

    Each micro-batch goes through the batch code, so a stream gives what a batch over its files gives. The
    customers' history is written once, so a batch only joins it. The result of a batch has its own folder;
    a repeated batch overwrites that folder.
    """
    known = replace(population, customers=materialise(population.customers, "customers"))

    def write(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch, known, model).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_scored(spark: SparkSession, out: str) -> DataFrame:
    """The last scores of every invoice: all rows of the last batch that holds it, as the batch code keeps repeated ids."""
    every = spark.read.parquet(out)
    last = every.groupBy(F.col("doc_id").alias("_id")).agg(F.max("batch").alias("_last"))
    return every.join(last, every["doc_id"].eqNullSafe(last["_id"]) & (F.col("batch") == F.col("_last")), "left_semi").drop("batch")


def compact(merged: DataFrame, target: str) -> None:
    """Write a merged table as the first batch of a new folder, from which the streams' readers go on."""
    merged.write.parquet(f"{target}/batch=-1")


def _in_files(source: DataFrame) -> DataFrame:
    """A stream of files with the order of its files; other streams as they are, ordered by their place in a batch."""
    try:
        return with_file_order(source)
    except AnalysisException:
        return source


def stream_upsert_history(source: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Add arriving rows to the history, one folder per batch, with their order of arrival.

    A batch writes its own rows only, whatever the size of the history; a repeated batch overwrites its folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        with_arrival(batch).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return (_in_files(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_upserted_history(spark: SparkSession, initial: DataFrame, root: str) -> DataFrame:
    """The history with all arrivals merged in: the last row of each ``doc_id`` wins, in order of batch, file and place in it.

    ``compact`` writes this table as the first batch of a new root, which keeps the number of batches to merge small.
    """
    arrived = spark.read.parquet(root)
    order = F.col(ARRIVAL) if ARRIVAL in arrived.columns else F.lit(None)
    columns = [c for c in arrived.columns if c not in ("batch", ARRIVAL)]
    payload = F.struct(*[F.col(f"`{c}`") for c in columns])
    last = arrived.groupBy("doc_id").agg(F.max_by(payload, F.struct("batch", order.alias("order"))).alias("_row")).select("_row.*")
    merged = union_history(initial.withColumn("_side", F.lit(0)), last.withColumn("_side", F.lit(1)))
    rest = [F.col(f"`{c}`") for c in merged.columns if c not in ("_side", "doc_id")]
    return keep_one(merged, "doc_id", [-F.col("_side"), *rest]).drop("_side")


def stream_into_ledger(source: DataFrame, ledger: Ledger, checkpoint: str) -> StreamingQuery:
    """Upsert arriving rows into a stored history, batch by batch; a repeated batch changes nothing.

    A batch reads and rewrites the runs that may hold its ids. ``compact`` and ``vacuum`` run between streams.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        ledger.upsert(batch, applied=batch_id)

    return (_in_files(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def weekly_cash(payments: DataFrame, reference_date: str, late_by: str = "7 days") -> DataFrame:
    """Cash per week after a reference date from a stream with paid_ts and total_open_amount.

    Windows start at the reference date; a week is closed when the watermark has passed it, and later payments are dropped. Totals that must
    hold every payment come from ``stream_weekly_cash``.
    """
    offset = (date.fromisoformat(reference_date) - date(1970, 1, 1)).days % 7
    week = F.window("paid_ts", "7 days", "7 days", f"{offset} days")
    return (payments.withWatermark("paid_ts", late_by).groupBy(week.alias("week"))
            .agg(F.sum(F.col("total_open_amount").cast("decimal(28,6)")).alias("cash"))
            .select(F.to_date("week.start").alias("week_start"), F.col("cash").cast("double").alias("cash")))


def stream_weekly_cash(payments: DataFrame, reference_date: str, out: str, checkpoint: str) -> StreamingQuery:
    """Cash per week after a reference date: every batch writes the sums of its own payments to its own folder.

    No payment is too late: the sums of all batches are added on read. A repeated batch overwrites its folder.
    """
    at = F.lit(reference_date).cast("date")

    def write(batch: DataFrame, batch_id: int) -> None:
        week = payment_week(F.col("paid_ts").cast("date"), at).cast("int").alias("week_bucket")
        sums = batch.groupBy(week).agg(F.sum(F.col("total_open_amount").cast("decimal(28,6)")).alias("cash"))
        sums.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (payments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_weekly_cash(spark: SparkSession, out: str) -> DataFrame:
    """Cash of the weeks 1..6 after the reference date as the batch has it: earlier payments in week 1, weeks without payments 0."""
    sums = spark.read.schema("week_bucket int, cash decimal(38,6), batch long").parquet(out)
    total = sums.groupBy("week_bucket").agg(F.sum("cash").cast("double").alias("cash"))
    weeks = spark.range(1, 7).select(F.col("id").cast("int").alias("week_bucket"))
    return weeks.join(total, "week_bucket", "left").select("week_bucket", F.coalesce("cash", F.lit(0.0)).alias("actual_cash"))
