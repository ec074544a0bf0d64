"""Streams give what the batch gives, take late payments, and survive a repeated batch."""

import datetime as dt

from pyspark.sql import functions as F

from duebook.operators import cleaning as C
from duebook.operators import forecast as FC
from duebook.operators import history as H
from duebook.operators import models as ML
from duebook.operators import snapshots as S
from duebook.plans import scoring
from duebook.session import run_folder
from duebook.sources import adapter as A
from duebook.streaming import arrivals as X

PAID = "paid_ts timestamp, total_open_amount double"


def pay(spark, path, rows):
    spark.createDataFrame([(dt.datetime(2020, 1, 6) + dt.timedelta(days=d), a) for d, a in rows], PAID).coalesce(1) \
        .write.mode("append").parquet(path)


def weekly(spark, out):
    return {r["week_bucket"]: r["actual_cash"] for r in X.read_weekly_cash(spark, out).collect()}


def test_weekly_cash_and_late_payments(spark):
    path, out, checkpoint = (run_folder(spark, n) for n in ("pay", "cash", "checkpoint"))
    schema = spark.createDataFrame([], PAID).schema

    def drain():
        X.stream_weekly_cash(X.landing(spark, path, schema), "2020-01-06", out, checkpoint).awaitTermination()

    pay(spark, path, [(0, 10.0), (6, 5.0), (7, 1.0), (60, 3.0), (-1, 9.0)])
    drain()
    assert weekly(spark, out) == {1: 24.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}
    pay(spark, path, [(3, 100.0), (55, 7.0)])
    drain()
    assert weekly(spark, out) == {1: 124.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}  # day 3 counts although day 60 came before
    paid = spark.read.parquet(path).select(F.col("paid_ts").cast("date").alias("invoice_paid"), "total_open_amount")
    batch = FC.weekly_actual_cash(paid, [], F.lit("2020-01-06").cast("date"))
    assert weekly(spark, out) == {r["week_bucket"]: r["actual_cash"] for r in batch.collect()}
    before = weekly(spark, out)
    drain()
    assert weekly(spark, out) == before


def test_upsert_stream_equals_batch(spark, folder):
    every = A.invoices(spark, folder, only_paid=False)
    news = C.paid_only(every).withColumn("total_open_amount", F.col("total_open_amount") * 2)
    path, root, checkpoint = (run_folder(spark, n) for n in ("news", "history", "checkpoint"))
    news.repartition(3).write.parquet(path)

    def drain():
        X.stream_upsert_history(X.landing(spark, path, news.schema, maxFilesPerTrigger=1), root, checkpoint).awaitTermination()

    drain()
    got = X.read_upserted_history(spark, every, root)
    want = H.upsert_history(every, news)
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count()
    drain()
    assert X.read_upserted_history(spark, every, root).count() == want.count()
    fresh = run_folder(spark, "history")
    X.compact(got, fresh)
    again = X.read_upserted_history(spark, every, fresh)
    assert again.exceptAll(got.select(again.columns)).count() == 0 and again.count() == got.count()


def test_the_last_row_of_a_batch_wins(spark):
    history = spark.createDataFrame([(1, "old", 5.0), (2, "kept", 6.0)], "doc_id long, name string, amount double")
    batch = spark.createDataFrame([(1, "zzz", 9.0), (1, "aaa", 1.0), (3, "aaa", 1.0), (3, "zzz", 9.0)], history.schema).coalesce(1)
    want = {(1, "aaa", 1.0), (2, "kept", 6.0), (3, "zzz", 9.0)}
    assert {tuple(r) for r in H.upsert_history(history, batch).select("doc_id", "name", "amount").collect()} == want
    by = H.upsert_history(history, batch, batch_order="amount")
    assert {tuple(r) for r in by.select("doc_id", "name", "amount").collect()} == {(1, "zzz", 9.0), (2, "kept", 6.0), (3, "zzz", 9.0)}
    path, root, checkpoint = (run_folder(spark, n) for n in ("news", "history", "checkpoint"))
    batch.write.parquet(path)
    X.stream_upsert_history(X.landing(spark, path, batch.schema), root, checkpoint).awaitTermination()
    assert {tuple(r) for r in X.read_upserted_history(spark, history, root).select("doc_id", "name", "amount").collect()} == want


def test_scores_of_repeated_ids(spark):
    out = run_folder(spark, "scored")
    for batch, rows in enumerate([[(1, 5.0), (1, 6.0), (2, 7.0)], [(2, 8.0), (2, 9.0)]]):
        spark.createDataFrame(rows, "doc_id long, total_open_amount double").write.parquet(f"{out}/batch={batch}")
    assert sorted(tuple(r) for r in X.read_scored(spark, out).collect()) == [(1, 5.0), (1, 6.0), (2, 8.0), (2, 9.0)]


def test_score_stream_equals_batch(spark, folder):
    paid = A.invoices(spark, folder)
    model = ML.train_classifier(C.impute_history(S.build_snapshots(paid)), ML.forest(trees=3, depth=3))
    raw = A.raw_invoices(spark, folder)
    path, out, checkpoint = (run_folder(spark, n) for n in ("raw", "scored", "checkpoint"))
    raw.coalesce(1).write.parquet(path)
    population = S.population_as_of(paid, A.as_of())
    X.stream_score(X.landing(spark, path, raw.schema), population, model, out, checkpoint).awaitTermination()
    columns = ["doc_id", "total_open_amount", "probabilities"]
    got = X.read_scored(spark, out).select(*columns)
    want = scoring.score_batch(raw, population, model).select(*columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
