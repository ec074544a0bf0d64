"""Snapshots, customer history, features, splits."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from duebook.catalog.base import AS_OF, plain, query, r, sql
from duebook.functions import dates as D
from duebook.functions import invoice as I
from duebook.operators import cleaning as C
from duebook.operators import history as H
from duebook.operators import joins as J
from duebook.operators import metrics as M
from duebook.operators import quantiles as Q
from duebook.operators import running as R
from duebook.operators import snapshots as S
from duebook.operators import splits as SP
from duebook.session import materialise, run_folder
from duebook.sources import adapter as A

def snaps(spark, d):
    return S.snapshot_open_invoices(A.invoices(spark, d))


def paid(spark, d):
    """The clean table, written once where a query reads it several times."""
    return materialise(A.invoices(spark, d), "clean")


@query("snapshot_open_invoices", sql("snap", f"""
  SELECT doc_id, cust_number, {r('total_open_amount')} AS total_open_amount, CAST(reference_date AS VARCHAR) AS reference_date,
    days_to_payment, week_bucket FROM snap"""))
def _(spark, d):
    return plain(snaps(spark, d).select("doc_id", "cust_number", "total_open_amount", "reference_date",
                                        "days_to_payment", "week_bucket"))


@query("snapshot_ceil_buckets", sql("snap", """
  SELECT doc_id, CAST(reference_date AS VARCHAR) AS reference_date,
    least(greatest(CAST(ceil(days_to_payment / 7.0) AS INTEGER), 1), 7) AS week_bucket FROM snap"""))
def _(spark, d):
    s = S.snapshot_open_invoices(A.invoices(spark, d), bucket_mode="ceil1")
    return plain(s.select("doc_id", "reference_date", "week_bucket"))


HIST = f"""cust_number, CAST(reference_date AS VARCHAR) AS reference_date, {r('customer_avg_delay')} AS customer_avg_delay,
  {r('late_payment_ratio')} AS late_payment_ratio, prev_transaction_count, CAST(last_invoice_date AS VARCHAR) AS last_invoice_date"""


@query("asof_customer_history", sql("hist", f"SELECT {HIST} FROM hist"))
def _(spark, d):
    inv = paid(spark, d)
    s = S.snapshot_open_invoices(inv)
    return plain(H.asof_customer_history(inv, s.select("cust_number", "reference_date")))


@query("asof_frames", sql("paid snap", f"""
  SELECT p.cust_number, CAST(p.reference_date AS VARCHAR) AS reference_date,
    count(CASE WHEN invoice_paid <= p.reference_date THEN 1 END) AS paid_until,
    count(CASE WHEN invoice_sent < p.reference_date THEN 1 END) AS sent_before
  FROM (SELECT DISTINCT cust_number, reference_date FROM snap) p JOIN paid USING (cust_number) GROUP BY 1, 2"""))
def _(spark, d):
    frames = {"paid_until": ("invoice_paid", 0), "sent_before": ("invoice_sent", 1)}
    return plain(H.asof_frames(A.invoices(spark, d), snaps(spark, d).select("cust_number", "reference_date"), frames))


@query("attach_history", sql("feat", f"""
  SELECT doc_id, CAST(reference_date AS VARCHAR) AS reference_date, {r('customer_avg_delay')} AS customer_avg_delay,
    {r('late_payment_ratio')} AS late_payment_ratio, prev_transaction_count, {r('customer_risk_score')} AS customer_risk_score,
    days_since_last_invoice FROM feat"""))
def _(spark, d):
    inv = paid(spark, d)
    s = S.snapshot_open_invoices(inv)
    h = H.asof_customer_history(inv, s.select("cust_number", "reference_date"))
    return plain(S.attach_history(s, h).select(
        "doc_id", "reference_date", "customer_avg_delay", "late_payment_ratio", "prev_transaction_count",
        "customer_risk_score", "days_since_last_invoice"))


TIMING = ["invoice_age_days", "days_until_due", "pay_terms_days", "invoice_month", "due_month", "days_past_due"]
CYCLIC = ["invoice_month_sin", "invoice_month_cos", "due_month_sin", "due_month_cos"]
FEATURES = TIMING + ["prev_transaction_count", "days_since_last_invoice", "invoice_size_cat", "invoice_size_cat_q"]
REALS = CYCLIC + ["customer_avg_delay", "late_payment_ratio", "customer_risk_score", "invoice_amount",
                  "invoice_amount_log", "open_amount"]


@query("engineer_features", sql("feat", f"""
  SELECT doc_id, CAST(reference_date AS VARCHAR) AS reference_date, week_bucket, days_to_payment, {', '.join(FEATURES)},
    {', '.join(f'{r(c)} + 0.0 AS {c}' for c in REALS)} FROM feat"""))
def _(spark, d):
    s = S.build_snapshots(paid(spark, d))
    flat = s.select("doc_id", "reference_date", "week_bucket", "days_to_payment", *FEATURES, *REALS)
    return plain(flat).select("doc_id", "reference_date", "week_bucket", "days_to_payment", *FEATURES,
                              *[(F.col(c) + F.lit(0.0)).alias(c) for c in REALS])


@query("timing_features", sql("feat", f"SELECT doc_id, CAST(reference_date AS VARCHAR) AS reference_date, {', '.join(TIMING)} FROM feat"))
def _(spark, d):
    return plain(S.timing_features(snaps(spark, d)).select("doc_id", "reference_date", *TIMING))


@query("month_cyclic", sql("inv", f"""
  SELECT doc_id, {', '.join(f"{r(f'{f}(2 * pi() * month({c}) / 12)')} + 0.0 AS {n}_{f}"
                            for n, c in (('invoice_month', 'invoice_sent'), ('due_month', 'due_in_date'))
                            for f in ('sin', 'cos'))} FROM inv"""))
def _(spark, d):
    inv = A.invoices(spark, d, only_paid=False)
    out = [("invoice_month", "invoice_sent"), ("due_month", "due_in_date")]
    cols = [(fn(I.month_angle(F.month(c)))).alias(f"{n}_{f}") for n, c in out for f, fn in (("sin", F.sin), ("cos", F.cos))]
    df = plain(inv.select("doc_id", *cols))
    return df.select("doc_id", *[(F.col(c) + F.lit(0.0)).alias(c) for c in df.columns[1:]])


@query("invoice_age_and_days_until_due", sql("inv", f"""
  SELECT doc_id, CASE WHEN invoice_paid IS NULL OR invoice_paid > {AS_OF} THEN CAST({AS_OF} - invoice_sent AS INTEGER) END AS invoice_age_days,
    CASE WHEN invoice_paid IS NULL OR invoice_paid > {AS_OF} THEN CAST(due_in_date - {AS_OF} AS INTEGER) END AS days_until_due FROM inv"""))
def _(spark, d):
    inv, at = A.invoices(spark, d, only_paid=False), A.as_of()
    return inv.select("doc_id", I.invoice_age_days(F.col("invoice_sent"), F.col("invoice_paid"), at).alias("invoice_age_days"),
                      I.days_until_due(F.col("due_in_date"), F.col("invoice_paid"), at).alias("days_until_due"))


@query("pay_terms_and_days_past_due", sql("inv", f"""
  SELECT doc_id, CAST(due_in_date - invoice_sent AS INTEGER) AS pay_terms_days, CAST({AS_OF} - due_in_date AS INTEGER) AS days_past_due,
    CAST(month(invoice_sent) AS INTEGER) AS invoice_month, CAST(month(due_in_date) AS INTEGER) AS due_month FROM inv"""))
def _(spark, d):
    inv = A.invoices(spark, d, only_paid=False)
    return inv.select("doc_id", F.datediff("due_in_date", "invoice_sent").alias("pay_terms_days"),
                      F.datediff(A.as_of(), "due_in_date").alias("days_past_due"),
                      F.month("invoice_sent").alias("invoice_month"), F.month("due_in_date").alias("due_month"))


@query("days_past_due_open", sql("inv", f"""
  SELECT doc_id, CASE WHEN (invoice_paid IS NULL OR invoice_paid > {AS_OF}) AND {AS_OF} > due_in_date
    THEN CAST({AS_OF} - due_in_date AS INTEGER) ELSE 0 END AS days_past_due FROM inv"""))
def _(spark, d):
    inv = A.invoices(spark, d, only_paid=False)
    return inv.select("doc_id", I.days_past_due_open(F.col("due_in_date"), F.col("invoice_paid"), A.as_of()).alias("days_past_due"))


@query("to_usd", sql("inv", f"SELECT doc_id, invoice_currency, business_year, {r('total_open_amount')} AS total_open_amount FROM inv"))
def _(spark, d):
    raw = A.raw_invoices(spark, d)
    usd = I.to_usd(F.col("total_open_amount"), F.col("invoice_currency"), F.col("buisness_year").cast("int"))
    return plain(raw.select("doc_id", "invoice_currency", F.col("buisness_year").cast("bigint").alias("business_year"),
                            usd.alias("total_open_amount")))


@query("amount_log", sql("inv", f"SELECT doc_id, {r('ln(1 + greatest(total_open_amount, 0))')} AS invoice_amount_log FROM inv"))
def _(spark, d):
    inv = A.invoices(spark, d, only_paid=False)
    return plain(inv.select("doc_id", I.amount_log(F.col("total_open_amount")).alias("invoice_amount_log")))


@query("size_category", sql("inv", """
  SELECT doc_id, CASE WHEN total_open_amount <= 10000 THEN 'small' WHEN total_open_amount <= 100000 THEN 'medium'
    ELSE 'large' END AS invoice_size_cat FROM inv"""))
def _(spark, d):
    inv = A.invoices(spark, d, only_paid=False)
    return inv.select("doc_id", I.size_category_fixed(F.col("total_open_amount")).alias("invoice_size_cat"))


@query("size_category_quantile", sql("inv", """
  SELECT doc_id, CASE WHEN total_open_amount <= q1 THEN 'small' WHEN total_open_amount <= q2 THEN 'medium'
    ELSE 'large' END AS invoice_size_cat_q
  FROM inv CROSS JOIN (SELECT quantile_cont(total_open_amount, 0.33) AS q1, quantile_cont(total_open_amount, 0.66) AS q2 FROM inv)"""))
def _(spark, d):
    inv = A.invoices(spark, d, only_paid=False)
    return S.amount_features(inv, Q.amount_quantiles(inv).first()).select("doc_id", "invoice_size_cat_q")


@query("customer_risk_score", sql("feat", f"""
  SELECT doc_id, CAST(reference_date AS VARCHAR) AS reference_date, {r('customer_risk_score')} AS customer_risk_score FROM feat"""))
def _(spark, d):
    inv = paid(spark, d)
    s = S.snapshot_open_invoices(inv)
    h = H.asof_customer_history(inv, s.select("cust_number", "reference_date"))
    joined = J.salted_join(s, h, ["cust_number", "reference_date"])
    return plain(joined.select("doc_id", "reference_date", I.customer_risk_score(
        F.col("late_payment_ratio"), F.col("customer_avg_delay")).alias("customer_risk_score")))


@query("days_since_last_invoice", sql("inv", f"""
  SELECT cust_number, CAST({AS_OF} - max(invoice_sent) AS INTEGER) AS days_since_last_invoice
  FROM inv WHERE invoice_sent < {AS_OF} GROUP BY 1"""))
def _(spark, d):
    sent = C.sent_before(A.invoices(spark, d, only_paid=False), A.as_of())
    return H.last_invoice_date(sent).select("cust_number", F.datediff(A.as_of(), "last_invoice_date").alias("days_since_last_invoice"))


@query("days_to_payment_and_week_bucket", sql("snap", """
  SELECT days_to_payment, week_bucket, count(*) AS n FROM snap GROUP BY 1, 2"""))
def _(spark, d):
    return snaps(spark, d).groupBy("days_to_payment", "week_bucket").agg(F.count(F.lit(1)).alias("n"))


@query("impute_history", sql("feat", f"""
  SELECT doc_id, CAST(reference_date AS VARCHAR) AS reference_date, {r('coalesce(customer_avg_delay, 0)')} AS customer_avg_delay,
    {r('coalesce(late_payment_ratio, 0)')} AS late_payment_ratio, coalesce(days_since_last_invoice, -1) AS days_since_last_invoice FROM feat"""))
def _(spark, d):
    s = C.impute_history(S.build_snapshots(paid(spark, d)))
    return plain(s.select("doc_id", "reference_date", "customer_avg_delay", "late_payment_ratio", "days_since_last_invoice"))


@query("feature_projection", sql("feat", f"""
  SELECT business_year, invoice_currency, document_type, {', '.join(FEATURES)}, {r('customer_avg_delay')} AS customer_avg_delay,
    {r('invoice_amount')} AS invoice_amount, {r('invoice_amount_log')} AS invoice_amount_log FROM feat"""))
def _(spark, d):
    x = C.feature_projection(S.build_snapshots(paid(spark, d)))
    return plain(x.select("business_year", "invoice_currency", "document_type", *FEATURES, "customer_avg_delay",
                          "invoice_amount", "invoice_amount_log"))


@query("week_bucket_distribution", sql("snap", "SELECT week_bucket, count(*) AS rows FROM snap GROUP BY 1 ORDER BY 1"))
def _(spark, d):
    return M.week_bucket_distribution(snaps(spark, d))


# -- customer aggregates -------------------------------------------------------------------------------

@query("customer_avg_delay", sql("paid", f"""
  SELECT cust_number, {r('avg(greatest(invoice_paid - due_in_date, 0))')} AS customer_avg_delay FROM paid
  WHERE invoice_paid <= {AS_OF} GROUP BY 1"""))
def _(spark, d):
    return plain(H.customer_avg_delay(C.paid_by(A.invoices(spark, d), A.as_of())))


@query("late_payment_ratio", sql("paid", f"""
  SELECT cust_number, {r('avg(CASE WHEN invoice_paid > due_in_date THEN 1e0 ELSE 0e0 END)')} AS late_payment_ratio FROM paid
  WHERE invoice_paid <= {AS_OF} GROUP BY 1"""))
def _(spark, d):
    return plain(H.late_payment_ratio(C.paid_by(A.invoices(spark, d), A.as_of())))


@query("prev_transaction_count", sql("inv", f"""
  SELECT cust_number, count(*) AS prev_transaction_count FROM inv WHERE invoice_sent < {AS_OF} GROUP BY 1"""))
def _(spark, d):
    return H.prev_transaction_count(C.sent_before(A.invoices(spark, d, only_paid=False), A.as_of()))


@query("last_invoice_date", sql("inv", f"""
  SELECT cust_number, CAST(max(invoice_sent) AS VARCHAR) AS last_invoice_date FROM inv WHERE invoice_sent < {AS_OF} GROUP BY 1"""))
def _(spark, d):
    return plain(H.last_invoice_date(C.sent_before(A.invoices(spark, d, only_paid=False), A.as_of())))


STATS_SQL = sql("inv", f"""
  SELECT cust_number, {r(f'avg(CASE WHEN invoice_paid <= {AS_OF} THEN greatest(invoice_paid - due_in_date, 0) END)')} AS customer_avg_delay,
    {r(f'avg(CASE WHEN invoice_paid <= {AS_OF} THEN CASE WHEN invoice_paid > due_in_date THEN 1e0 ELSE 0e0 END END)')} AS late_payment_ratio,
    count(CASE WHEN invoice_sent < {AS_OF} THEN 1 END) AS prev_transaction_count,
    CAST(max(CASE WHEN invoice_sent < {AS_OF} THEN invoice_sent END) AS VARCHAR) AS last_invoice_date
  FROM inv WHERE invoice_paid <= {AS_OF} OR invoice_sent < {AS_OF} GROUP BY 1""")


@query("join_customer_stats", STATS_SQL)
def _(spark, d):
    return plain(H.customer_stats(A.invoices(spark, d, only_paid=False), A.as_of()))


@query("running_history", STATS_SQL)
def _(spark, d):
    """The same from a stored state of four weeks before and the arrivals of each week since."""
    inv = A.invoices(spark, d, only_paid=False)
    kept = R.RunningHistory(spark, run_folder(spark, "running"))
    start = date.fromisoformat(A.AS_OF) - timedelta(weeks=4)
    kept.move_on(str(start), R.payment_events(inv, after=F.lit("0001-01-01").cast("date"), upto=F.lit(str(start)).cast("date")))
    for week in range(4):
        after, upto = (str(start + timedelta(weeks=week + i)) for i in (0, 1))
        kept.move_on(upto, R.payment_events(inv, after=F.lit(after).cast("date"), upto=F.lit(upto).cast("date")))
    return plain(kept.history())


@query("customer_stats_static", sql("inv", f"""
  SELECT cust_number, {r('l')} AS late_payment_ratio, {r('dl')} AS avg_payment_delay_days, n AS num_previous_invoices,
    {r('0.7e0 * l + 0.3e0 * dl')} AS customer_risk_score, CAST(m AS VARCHAR) AS last_invoice_date FROM (
    SELECT cust_number, avg(CASE WHEN invoice_paid > due_in_date THEN 1e0 ELSE 0e0 END) AS l,
      coalesce(avg(CASE WHEN invoice_paid <= {AS_OF} THEN invoice_paid - due_in_date END), 0) AS dl,
      count(*) AS n, max(invoice_sent) AS m FROM inv WHERE invoice_sent < {AS_OF} GROUP BY 1)"""))
def _(spark, d):
    return plain(H.customer_stats_static(A.invoices(spark, d, only_paid=False), A.as_of()))


@query("amount_quantiles", sql("inv", f"""
  SELECT {r('quantile_cont(total_open_amount, 0.33)')} AS q1, {r('quantile_cont(total_open_amount, 0.66)')} AS q2 FROM inv"""))
def _(spark, d):
    return plain(Q.amount_quantiles(A.invoices(spark, d, only_paid=False)))


def cut(column: str, p: float) -> str:
    return f"quantile_cont(CAST({column} - DATE '1970-01-01' AS DOUBLE), {p}) * 86400"


@query("date_quantile_cutoff", sql("snap", f"""
  SELECT CAST(round({cut('invoice_sent', 0.8)}) AS BIGINT) AS sent_80, CAST(round({cut('reference_date', 0.6)}) AS BIGINT) AS reference_60,
    CAST(round({cut('reference_date', 0.8)}) AS BIGINT) AS reference_80, CAST(round({cut('reference_date', 0.9)}) AS BIGINT) AS reference_90 FROM snap"""))
def _(spark, d):
    s = snaps(spark, d)
    cuts = Q.date_quantiles(s, "reference_date", {"reference_60": 0.6, "reference_80": 0.8, "reference_90": 0.9})
    sent = Q.date_quantile(s, "invoice_sent", 0.8).scalar()
    return cuts.select(F.unix_seconds(sent).alias("sent_80"), *[F.unix_seconds(c).alias(c) for c in cuts.columns])


FOLD_SQL = " UNION ALL ".join(
    f"SELECT {int(p * 100)} AS percentile, quantile_cont(x, {p}) AS c FROM (SELECT DISTINCT "
    f"CAST(reference_date - DATE '1970-01-01' AS DOUBLE) AS x FROM snap)" for p in (0.4, 0.5, 0.6, 0.7, 0.8))


@query("distinct_date_percentiles", sql("snap", f"SELECT percentile, CAST(round(c * 86400) AS BIGINT) AS cutoff FROM ({FOLD_SQL})"))
def _(spark, d):
    f = SP.backtest_folds(snaps(spark, d))
    return f.select("percentile", F.unix_seconds("cutoff").alias("cutoff"))


@query("backtest_windows", sql("snap", f"""
  SELECT percentile, CASE WHEN x <= c THEN 'train' ELSE 'test' END AS part, count(*) AS rows, count(DISTINCT x) AS reference_dates
  FROM ({FOLD_SQL}) JOIN (SELECT CAST(reference_date - DATE '1970-01-01' AS DOUBLE) AS x FROM snap) ON x <= c + 42 GROUP BY 1, 2"""))
def _(spark, d):
    w = SP.backtest_windows(snaps(spark, d))
    return w.groupBy("percentile", "part").agg(F.count(F.lit(1)).alias("rows"),
                                               F.count_distinct("reference_date").alias("reference_dates"))


@query("time_split", sql("snap", f"""
  SELECT doc_id, CAST(reference_date AS VARCHAR) AS reference_date,
    CASE WHEN CAST(reference_date - DATE '1970-01-01' AS DOUBLE) * 86400 <= c THEN 'train' ELSE 'test' END AS part
  FROM snap CROSS JOIN (SELECT {cut('invoice_sent', 0.8)} AS c FROM snap)"""))
def _(spark, d):
    return plain(SP.time_split(snaps(spark, d)).select("doc_id", "reference_date", "part"))


@query("train_valid_test", sql("snap", f"""
  SELECT doc_id, CAST(reference_date AS VARCHAR) AS reference_date, part,
    CASE part WHEN 'train' THEN -1 WHEN 'valid' THEN 0 END AS fold FROM (
    SELECT doc_id, reference_date, CASE WHEN CAST(reference_date - DATE '1970-01-01' AS DOUBLE) * 86400 <= a THEN 'train'
      WHEN CAST(reference_date - DATE '1970-01-01' AS DOUBLE) * 86400 <= b THEN 'valid' ELSE 'test' END AS part
    FROM snap CROSS JOIN (SELECT {cut('reference_date', 0.6)} AS a, {cut('reference_date', 0.8)} AS b FROM snap))"""))
def _(spark, d):
    return plain(SP.train_valid_test(snaps(spark, d)).select("doc_id", "reference_date", "part", "fold"))


@query("time_series_folds", sql("snap", """
  , n AS (SELECT row_number() OVER (ORDER BY reference_date, doc_id) AS pos, reference_date FROM snap),
  f AS (SELECT k AS fold, t - (6 - k) * (t // 6) AS train_rows, t // 6 AS test_rows
        FROM (SELECT unnest(range(1, 6)) AS k, t FROM (SELECT count(*) AS t FROM snap)))
  SELECT CAST(fold AS INTEGER) AS fold, train_rows, test_rows,
    CAST((SELECT reference_date FROM n WHERE pos = train_rows) AS VARCHAR) AS train_end,
    CAST((SELECT reference_date FROM n WHERE pos = train_rows + 1) AS VARCHAR) AS test_start,
    CAST((SELECT reference_date FROM n WHERE pos = train_rows + test_rows) AS VARCHAR) AS test_end FROM f"""))
def _(spark, d):
    return plain(SP.time_series_folds(snaps(spark, d)))


@query("parse_yyyymmdd", sql("raw", "SELECT doc_id, CAST(due_in_date AS VARCHAR) AS due_in_date, CAST(invoice_sent AS VARCHAR) AS invoice_sent FROM raw"))
def _(spark, d):
    raw = A.raw_invoices(spark, d)
    return plain(raw.select("doc_id", D.parse_yyyymmdd(F.col("due_in_date")).alias("due_in_date"),
                            D.parse_yyyymmdd(F.col("baseline_create_date").cast("string")).alias("invoice_sent")))


@query("parse_timestamp", sql("raw", """
  SELECT doc_id, strftime(CAST(invoice_paid AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS clear_date FROM raw"""))
def _(spark, d):
    raw = A.raw_invoices(spark, d)
    return plain(raw.select("doc_id", D.parse_timestamp(F.col("clear_date")).alias("clear_date")))


@query("extract_terms_days", sql("raw", """
  SELECT cust_payment_terms, CAST(substr(cust_payment_terms, 3) AS BIGINT) AS pay_terms_days, count(*) AS n FROM raw GROUP BY 1, 2"""))
def _(spark, d):
    raw = A.raw_invoices(spark, d)
    return (raw.select("cust_payment_terms", I.extract_terms_days(F.col("cust_payment_terms")).alias("pay_terms_days"))
            .groupBy("cust_payment_terms", "pay_terms_days").agg(F.count(F.lit(1)).alias("n")))


@query("row_date_range", sql("raw", """
  SELECT doc_id, CAST(least(invoice_sent, due_in_date, coalesce(invoice_paid, due_in_date)) AS VARCHAR) AS min_date,
    CAST(greatest(invoice_sent, due_in_date, coalesce(invoice_paid, due_in_date)) AS VARCHAR) AS max_date,
    CAST(greatest(invoice_sent, due_in_date, coalesce(invoice_paid, due_in_date))
         - least(invoice_sent, due_in_date, coalesce(invoice_paid, due_in_date)) AS INTEGER) AS date_range_days FROM raw"""))
def _(spark, d):
    raw = A.raw_invoices(spark, d)
    texts = ["clear_date", "posting_date", "document_create_date", "document_create_date.1"]
    days = ([D.parse_timestamp(F.col(f"`{c}`")).cast("date") for c in texts]
            + [D.parse_yyyymmdd(F.col(c)) for c in ("due_in_date", "baseline_create_date")])
    low, high, span = D.row_date_range(days)
    return plain(raw.select("doc_id", low.alias("min_date"), high.alias("max_date"), span.alias("date_range_days")))


@query("normalise_category", sql("raw", "SELECT trim(invoice_currency) AS invoice_currency, count(*) AS n FROM raw GROUP BY 1"))
def _(spark, d):
    raw = A.raw_invoices(spark, d)
    return (raw.groupBy(I.normalise_category(F.col("invoice_currency")).alias("invoice_currency"))
            .agg(F.count(F.lit(1)).alias("n")))
