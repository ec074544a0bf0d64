"""Snapshots and history against the plain formulations, and the edges of both."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duebook import schema
from duebook.operators import cleaning as C
from duebook.operators import forecast as FC
from duebook.operators import history as H
from duebook.operators import snapshots as S
from duebook.operators import splits as SP
from duebook.sources import adapter as A

START = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else START + dt.timedelta(days=n)


def invoices(spark, rows):
    """Rows of (doc, customer, sent, due, paid, amount), days counted from the start."""
    data = [(d, c, 2020, day(due), "USD", "RV", a, day(s), "NA10", day(p)) for d, c, s, due, p, a in rows]
    return spark.createDataFrame(data, schema.CLEAN_INVOICE)


def some(spark, n=400, seed=1, customers=12):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        c = "hot" if rnd.random() < 0.4 else rnd.choice([f"c{k}" for k in range(customers)] + [None])
        s = rnd.randrange(0, 300)
        due = rnd.choice([None, s + 10, s + 30])
        paid = rnd.choice([None, s, s + 7, s + rnd.randrange(0, 90)])
        rows.append((i, c, s, due, paid, float(rnd.randrange(1, 10**6)) / 100))
    return invoices(spark, rows)


def test_equals_theta_join(spark):
    inv = some(spark)
    grid = S.snapshot_grid(inv)
    dates = spark.range(1).select(F.explode(F.sequence(F.lit(grid[0]), F.lit(grid[1]), F.expr("interval 7 days"))).alias("t"))
    theta = inv.join(dates, (F.col("invoice_sent") <= F.col("t")) & (F.col("invoice_paid") > F.col("t")))
    want = sorted((r["doc_id"], r["t"]) for r in theta.collect())
    got = sorted((r["doc_id"], r["reference_date"]) for r in S.snapshot_open_invoices(inv).collect())
    assert got == want and len(got) > 500


def test_snapshot_edges(spark):
    # Paid on the sent date; paid on the next grid date; between two grid dates; sent on a grid date; unpaid.
    inv = invoices(spark, [(1, "a", 0, 5, 0, 1.0), (2, "a", 0, 5, 7, 1.0), (3, "a", 8, 9, 13, 1.0), (4, "a", 7, 9, 15, 1.0),
                           (5, "a", 0, 5, None, 1.0), (6, "b", 20, 30, 100, 1.0)])
    got = sorted((r["doc_id"], (r["reference_date"] - START).days) for r in S.snapshot_open_invoices(inv).collect())
    assert [x for x in got if x[0] != 6] == [(2, 0), (4, 7), (4, 14)]
    assert [x[1] for x in got if x[0] == 6] == [21, 28, 35, 42, 49, 56]


def test_fixed_grid(spark):
    inv = some(spark)
    whole = S.snapshot_open_invoices(inv, anchor=day(3), until=day(200))
    dates = {(r[0] - START).days for r in whole.select("reference_date").distinct().collect()}
    assert dates <= set(range(3, 201, 7)) and whole.count() > 0


def test_nothing_paid(spark):
    assert S.snapshot_open_invoices(invoices(spark, [(1, "a", 0, 5, None, 1.0)])).count() == 0


def nested(inv, t, c):
    mine = [r for r in inv if r["cust_number"] == c]
    paid = [r for r in mine if r["invoice_paid"] is not None and r["invoice_paid"] <= t]
    sent = [r for r in mine if r["invoice_sent"] < t]
    delays = [max((r["invoice_paid"] - r["due_in_date"]).days, 0) for r in paid if r["due_in_date"] is not None]
    late = [r["due_in_date"] is not None and r["invoice_paid"] > r["due_in_date"] for r in paid]
    return (np.mean(delays) if delays else None, np.mean(late) if late else None, len(sent),
            max((r["invoice_sent"] for r in sent), default=None))


def test_history_equals_nested_loop(spark):
    inv = some(spark)
    rows = inv.collect()
    probes = spark.createDataFrame([(c, day(t)) for c in ("hot", "c1", "c2", "new") for t in range(0, 320, 9)] * 2,
                                   "cust_number string, reference_date date")
    got = H.asof_customer_history(inv, probes).collect()
    assert len(got) == 4 * len(range(0, 320, 9))
    for r in got:
        delay, ratio, count, last = nested(rows, r["reference_date"], r["cust_number"])
        assert r["customer_avg_delay"] == (None if delay is None else pytest.approx(delay))
        assert r["late_payment_ratio"] == (None if ratio is None else pytest.approx(ratio))
        assert (r["prev_transaction_count"], r["last_invoice_date"]) == (count, last)


def test_history_boundaries(spark):
    # Paid on the date counts, sent on the date does not; two payments on one day both count.
    inv = invoices(spark, [(1, "a", 0, 5, 10, 1.0), (2, "a", 3, 20, 10, 1.0), (3, "a", 10, 20, 30, 1.0)])
    probes = spark.createDataFrame([("a", day(10)), ("a", day(9))], "cust_number string, reference_date date")
    got = {r["reference_date"]: r for r in H.asof_customer_history(inv, probes).collect()}
    at = got[day(10)]
    assert (at["customer_avg_delay"], at["late_payment_ratio"], at["prev_transaction_count"]) == (2.5, 0.5, 2)
    assert at["last_invoice_date"] == day(3)
    assert got[day(9)]["customer_avg_delay"] is None


def test_customer_without_history(spark):
    inv = some(spark)
    asked = invoices(spark, [(1, "new", 5, 9, None, 10.0)])
    population = S.population_as_of(inv, F.lit(day(50)))
    row = S.features_as_of(asked, population).first()
    assert row["customer_avg_delay"] is None and row["prev_transaction_count"] == 0 and row["customer_risk_score"] == 0
    filled = C.impute_history(S.features_as_of(asked, population)).first()
    assert (filled["customer_avg_delay"], filled["late_payment_ratio"], filled["days_since_last_invoice"]) == (0, 0, -1)


def test_forecast_properties(spark):
    s = A.scored(S.snapshot_open_invoices(some(spark)))
    assert FC.forecast_within_total(s, ["reference_date"]).where("not within_total").count() == 0
    shares = FC.forecast_share(FC.weekly_forecast_cash(s)).orderBy("week_bucket").collect()
    assert sum(r["share"] for r in shares) == pytest.approx(100)
    assert shares[-1]["cumulative_cash"] == pytest.approx(sum(r["forecast_cash"] for r in shares))
    wide = {r["reference_date"]: r for r in FC.forecast_per_reference_date(s).collect()}
    long = FC.forecast_metrics(FC.forecast_comparison(s), ["reference_date"]).collect()
    for r in long:
        for c in ("forecast_mae_weekly", "forecast_mape_weekly", "total_actual_cf", "total_forecast_cf"):
            assert wide[r["reference_date"]][c] == r[c]


def test_week_without_payments(spark):
    inv = invoices(spark, [(1, "a", 0, 5, 3, 10.0), (2, "a", 0, 5, 90, 7.0)])
    s = A.scored(inv.withColumn("reference_date", F.lit(START)))
    rows = {r["week_bucket"]: r for r in FC.forecast_comparison(s).collect()}
    assert rows[1]["actual_cash"] == 10.0 and rows[2]["actual_cash"] == 0 and rows[2]["perc_error"] is None
    only_late = A.scored(invoices(spark, [(2, "a", 0, 5, 90, 7.0)]).withColumn("reference_date", F.lit(START)))
    assert FC.forecast_per_reference_date(only_late).first()["forecast_mape_weekly"] is None


def test_folds(spark):
    df = spark.createDataFrame([(day(i // 10),) for i in range(100)], "reference_date date")
    rows = SP.time_series_folds(df).orderBy("fold").collect()
    assert [r["test_rows"] for r in rows] == [16] * 5 and [r["train_rows"] for r in rows] == [20, 36, 52, 68, 84]
    assert (rows[0]["train_end"], rows[0]["test_start"], rows[0]["test_end"]) == (day(1), day(2), day(3))


def test_frames_at_probe_dates(spark):
    from duebook.operators import history as H
    import datetime as dt
    day = lambda n: None if n is None else dt.date(2020, 1, 1) + dt.timedelta(days=n)
    events = [("a", 1, 3), ("a", 3, 3), ("a", None, 5), ("b", 2, None), (None, 1, 1)]
    probes = [("a", 3), ("a", 4), ("a", 3), ("b", 1), ("c", 9), (None, 3)]
    e = spark.createDataFrame([(k, day(x), day(y)) for k, x, y in events], "cust_number string, invoice_sent date, invoice_paid date")
    p = spark.createDataFrame([(k, day(n)) for k, n in probes], "cust_number string, reference_date date")
    got = {(r["cust_number"], r["reference_date"]): (r["paid"], r["sent"]) for r in
           H.asof_frames(e, p, {"paid": ("invoice_paid", 0), "sent": ("invoice_sent", 1)}).collect()}
    assert got == {(k, day(n)): (sum(c == k and y is not None and y <= n for c, _, y in events), sum(c == k and x is not None and x < n for c, x, _ in events))
                   for k, n in probes if k}


def test_days_of_a_frame_stay_in_as_many_parts(spark):
    """Rows are dealt by key before they are summed, in a number of parts that is not merged: the sums of a task take little memory."""
    e = spark.createDataFrame([(f"c{i % 40}", i % 300, i % 7) for i in range(2000)], "cust_number string, a int, b int").selectExpr(
        "cust_number", "date_add(DATE '2020-01-01', a) AS invoice_paid", "date_add(DATE '2020-01-01', b) AS invoice_sent")
    p = e.select("cust_number", F.col("invoice_paid").alias("reference_date"))
    frames = H.asof_frames(e, p, {"paid": ("invoice_paid", 0), "sent": ("invoice_sent", 1)})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert frames.rdd.getNumPartitions() == parts
    rows = e.collect()
    for r in frames.collect():
        own = [x for x in rows if x["cust_number"] == r["cust_number"]]
        assert r["paid"] == sum(x["invoice_paid"] <= r["reference_date"] for x in own) and r["sent"] == sum(x["invoice_sent"] < r["reference_date"] for x in own)
