"""History kept as state against the history counted from all invoices."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from duebook.operators import history as H
from duebook.operators import running as R
from duebook.session import run_folder

START = date(2020, 1, 6)


def day(n):
    return None if n is None else START + timedelta(days=n)


@pytest.fixture(scope="module")
def invoices(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        sent = rnd.choice([None, *range(90)])
        due = rnd.choice([None, (sent or 0) + rnd.choice([10, 30])])
        paid = rnd.choice([None, (sent or 0) + rnd.randrange(1, 60)])
        rows.append((i, rnd.choice(["a", "b", "hot", "hot", "hot", None]), day(sent), day(due), day(paid)))
    return spark.createDataFrame(rows, "doc_id long, cust_number string, invoice_sent date, due_in_date date, invoice_paid date")


def rows(df):
    return sorted(tuple(r) for r in df.select("cust_number", "customer_avg_delay", "late_payment_ratio", "prev_transaction_count", "last_invoice_date").collect())


def lit(n):
    return F.lit(str(day(n))).cast("date")


@pytest.mark.parametrize("clip_early", [True, False])
def test_every_week_equals_the_full_count(spark, invoices, clip_early):
    kept = R.RunningHistory(spark, run_folder(spark, "running"))
    assert kept.state() is None and kept.dates() == []
    kept.move_on(str(day(20)), R.payment_events(invoices, clip_early, lit(-10_000), lit(20)))
    for n in range(27, 130, 7):
        kept.move_on(str(day(n)), R.payment_events(invoices, clip_early, lit(n - 7), lit(n)))
        assert rows(kept.history()) == rows(H.customer_stats(invoices, lit(n), clip_early))
    assert rows(kept.history(str(day(27)))) == rows(H.customer_stats(invoices, lit(27), clip_early))


def test_early_and_late_arrivals(spark, invoices):
    """Events may arrive before they count or long after."""
    first, second = invoices.where("doc_id % 2 = 0"), invoices.where("doc_id % 2 = 1")
    state = R.move_on(None, R.payment_events(first), lit(30))
    state = R.move_on(state, R.payment_events(second), lit(44))
    assert rows(R.history_of(state)) == rows(H.customer_stats(invoices, lit(44)))
    state = R.move_on(state, R.payment_events(invoices.limit(0)), lit(400))
    assert rows(R.history_of(state)) == rows(H.customer_stats(invoices, lit(400)))
    assert state.where("day IS NOT NULL").count() == 0


def test_a_week_reads_the_week_and_the_state_alone(spark, invoices):
    root = run_folder(spark, "weeks")
    for n in range(0, 40, 7):
        R.payment_events(invoices, after=lit(n - 7), upto=lit(n)).write.parquet(f"{root}/week={day(n)}")
    kept = R.RunningHistory(spark, run_folder(spark, "running"))
    for n in range(0, 40, 7):
        arrived = spark.read.parquet(f"{root}/week={day(n)}")
        if n > 0:
            read = {f.rsplit("/", 2)[1] for f in R.move_on(kept.state(), arrived, lit(n)).inputFiles()}
            assert read == {f"week={day(n)}", f"as_of={day(n - 7)}"}
        kept.move_on(str(day(n)), arrived)
    before = rows(kept.history())
    kept.move_on(str(day(35)), spark.read.parquet(f"{root}/week={day(35)}"))  # a week that was added before
    assert rows(kept.history()) == before
    with pytest.raises(ValueError):
        kept.move_on(str(day(7)), arrived)


def test_no_invoices(spark, invoices):
    state = R.move_on(None, R.payment_events(invoices.limit(0)), lit(0))
    assert R.history_of(state).count() == 0
