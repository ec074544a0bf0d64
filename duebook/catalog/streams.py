"""Streams driven to completion over files written from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duebook.catalog.base import dsum, plain, query, r, sql
from duebook.catalog.learning import parts
from duebook.functions import probability as P
from duebook.operators import models as ML
from duebook.operators import snapshots as S
from duebook.session import run_folder
from duebook.sources import adapter as A
from duebook.sources.ledger import Ledger
from duebook.streaming import arrivals as X

START = "2001-03-04"


@query("stream_weekly_cash", sql("paid", f"""
  SELECT CAST(week AS INTEGER) AS week_bucket, {r('coalesce(cash, 0)', 2)} AS actual_cash FROM range(1, 7) AS w(week)
  LEFT JOIN (SELECT greatest(floor((invoice_paid - DATE '{START}') / 7.0), 0) + 1 AS paid_week, {dsum('total_open_amount')} AS cash
    FROM paid GROUP BY 1) ON paid_week = week"""))
def _(spark, d):
    inv = A.invoices(spark, d).select(F.col("invoice_paid").cast("timestamp").alias("paid_ts"), "total_open_amount")
    path, out = run_folder(spark, "payments"), run_folder(spark, "weekly-cash")
    inv.repartition(4).write.parquet(path)
    X.stream_weekly_cash(X.landing(spark, path, inv.schema), START, out, run_folder(spark, "checkpoint")).awaitTermination()
    return plain(X.read_weekly_cash(spark, out), 2)


@query("stream_upsert_history", sql("inv", f"""
  SELECT doc_id, {r('CASE WHEN invoice_paid IS NULL THEN total_open_amount + 1 ELSE total_open_amount END')} AS total_open_amount,
    CAST(invoice_sent AS VARCHAR) AS invoice_sent FROM inv"""))
def _(spark, d):
    """Open invoices arrive again, in several files taken one per batch."""
    every = A.invoices(spark, d, only_paid=False)
    path, root = run_folder(spark, "arrivals"), run_folder(spark, "history")
    news = every.where("invoice_paid is null").withColumn("total_open_amount", F.col("total_open_amount") + 1)
    news.repartition(3).write.parquet(path)
    source = X.landing(spark, path, news.schema, maxFilesPerTrigger=1)
    X.stream_upsert_history(source, root, run_folder(spark, "checkpoint")).awaitTermination()
    return plain(X.read_upserted_history(spark, every, root).select("doc_id", "total_open_amount", "invoice_sent"))


@query("stream_into_ledger", sql("inv", f"""
  SELECT doc_id, {r('CASE WHEN invoice_paid IS NULL THEN total_open_amount + 1 ELSE total_open_amount END')} AS total_open_amount,
    CAST(invoice_sent AS VARCHAR) AS invoice_sent FROM inv"""))
def _(spark, d):
    """Open invoices arrive in several files, taken one per batch, into a stored history."""
    every = A.invoices(spark, d, only_paid=False).select("doc_id", "total_open_amount", "invoice_sent", "invoice_paid")
    path = run_folder(spark, "arrivals")
    news = every.where("invoice_paid is null").withColumn("total_open_amount", F.col("total_open_amount") + 1)
    news.repartition(2).write.parquet(path)
    ledger = Ledger(spark, run_folder(spark, "ledger"), buckets=8)
    ledger.create(every)
    source = X.landing(spark, path, news.schema, maxFilesPerTrigger=1)
    X.stream_into_ledger(source, ledger, run_folder(spark, "checkpoint")).awaitTermination()
    return plain(ledger.read().select("doc_id", "total_open_amount", "invoice_sent"))


@query("stream_score")
def _(spark, d):
    train, _, _ = parts(spark, d)
    model = ML.train_classifier(train, ML.forest())
    raw = A.raw_invoices(spark, d)
    path, out = run_folder(spark, "uploads"), run_folder(spark, "scored")
    raw.repartition(2).write.parquet(path)
    source = X.landing(spark, path, raw.schema, maxFilesPerTrigger=1)
    population = S.population_as_of(A.invoices(spark, d), A.as_of())
    X.stream_score(source, population, model, out, run_folder(spark, "checkpoint")).awaitTermination()
    return plain(X.read_scored(spark, out).select("doc_id", "total_open_amount", *P.spread(F.col("probabilities"))))
