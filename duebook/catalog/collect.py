"""The collections queue, its checks and its records."""

from __future__ import annotations

from pyspark.sql import functions as F

from duebook.catalog.base import AS_OF, ARGMAX, dsum, plain, query, r, sql
from duebook.functions import probability as P
from duebook.functions import risk as R
from duebook.operators import cleaning as C
from duebook.operators import joins as J
from duebook.operators import queue as Q
from duebook.operators import snapshots as S
from duebook.operators import splits as SP
from duebook.session import run_folder
from duebook.sources import adapter as A
from duebook.sources import writers as W


def scored(spark, d, with_name=False):
    return A.scored(A.invoices(spark, d, only_paid=False, with_name=with_name))


def risk(spark, d, with_name=False):
    return Q.risk_table(scored(spark, d, with_name), A.as_of())


UNTIL = f"CAST(due_in_date - {AS_OF} AS INTEGER)"
RISK = f"""SELECT *, {UNTIL} AS days_until_due, p5 + p6 + p7 AS risk_score, p1 + p2 AS paid_soon_score,
  CASE WHEN {UNTIL} < 0 THEN -{UNTIL} ELSE 0 END AS days_overdue, CAST({UNTIL} < 0 AS INTEGER) AS is_overdue FROM scored_named"""
RISK = f"""SELECT *, CASE WHEN risk_score < 0.2e0 THEN 'Low' WHEN risk_score < 0.5e0 THEN 'Medium' ELSE 'High' END AS risk_category,
  CASE WHEN days_overdue = 0 THEN 1.0e0 WHEN days_overdue < 7 THEN 1.2e0 WHEN days_overdue < 30 THEN 1.5e0 ELSE 2.0e0 END
    AS overdue_multiplier, {ARGMAX} + 1 AS predicted_bucket, greatest(p1,p2,p3,p4,p5,p6,p7) AS class_probability FROM ({RISK})"""
RISK = f"SELECT *, {r('total_open_amount * risk_score * overdue_multiplier', 2)} AS priority_score FROM ({RISK})"
TOP = f"""SELECT CAST(row_number() OVER (ORDER BY priority_score DESC NULLS LAST, doc_id) AS INTEGER) AS collections_rank, *
  FROM ({RISK}) ORDER BY 1 LIMIT 10"""
QUEUE = f"collections_rank, doc_id, cust_number, {r('total_open_amount')} AS total_open_amount, days_overdue, risk_category"


@query("risk_score_and_category", sql("scored_named", f"""
  SELECT doc_id, {r('risk_score')} AS risk_score, {r('paid_soon_score')} AS paid_soon_score, risk_category FROM ({RISK})"""))
def _(spark, d):
    return plain(risk(spark, d).select("doc_id", "risk_score", "paid_soon_score", "risk_category"))


@query("days_overdue_and_multiplier", sql("scored_named", f"""
  SELECT doc_id, days_until_due, is_overdue, days_overdue, overdue_multiplier FROM ({RISK})"""))
def _(spark, d):
    return risk(spark, d).select("doc_id", "days_until_due", "is_overdue", "days_overdue", "overdue_multiplier")


@query("priority_score", sql("scored_named", f"SELECT doc_id, priority_score FROM ({RISK})"))
def _(spark, d):
    return risk(spark, d).select("doc_id", "priority_score")


@query("predicted_class_and_probability", sql("scored_named", f"""
  SELECT doc_id, predicted_bucket, {r('class_probability')} AS class_probability FROM ({RISK})"""))
def _(spark, d):
    return plain(risk(spark, d).select("doc_id", "predicted_bucket", "class_probability"))


@query("collections_rank", sql("scored_named", f"SELECT {QUEUE}, priority_score FROM ({TOP})"))
def _(spark, d):
    top = Q.collections_rank(risk(spark, d))
    return plain(top.select("collections_rank", "doc_id", "cust_number", "total_open_amount", "days_overdue",
                            "risk_category", "priority_score"))


@query("top_n_priority", sql("scored_named", f"SELECT {QUEUE}, name_customer FROM ({TOP})"))
def _(spark, d):
    names = A.invoices(spark, d, only_paid=False, with_name=True).select("doc_id", "name_customer")
    return plain(J.attach_customer_name(Q.top_n_priority(risk(spark, d)), names))


@query("write_queue", sql("scored_named", f"SELECT {QUEUE} FROM ({TOP})"))
def _(spark, d):
    path = run_folder(spark, "queue")
    top = Q.top_n_priority(risk(spark, d))
    W.write_records(top, path)
    return plain(spark.read.schema(top.schema).json(path))


BY_BUCKET = f"""SELECT CAST(row_number() OVER (ORDER BY predicted_bucket DESC, total_open_amount DESC, doc_id) AS INTEGER) AS rank, *
  FROM ({RISK}) ORDER BY 1 LIMIT 10"""


@query("rank_by_bucket", sql("scored_named", f"""
  SELECT rank, doc_id, predicted_bucket, {r('total_open_amount')} AS total_open_amount FROM ({BY_BUCKET})"""))
def _(spark, d):
    return plain(Q.rank_by_bucket(risk(spark, d)).select("rank", "doc_id", "predicted_bucket", "total_open_amount"))


LABEL = ("CASE predicted_bucket WHEN 6 THEN 'Critical' WHEN 5 THEN 'Very High' WHEN 4 THEN 'High' WHEN 3 THEN 'Medium' "
         "WHEN 2 THEN 'Low' WHEN 1 THEN 'Very Low' ELSE 'Medium' END")


def score_of(label: str) -> str:
    return f"CASE {label} WHEN 'Critical' THEN 6 WHEN 'Very High' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 WHEN 'Very Low' THEN 1 ELSE 3 END"


@query("normalise_queue_ranked", sql("scored_named", f"""
  SELECT collections_rank AS rank, CAST(CAST(cust_number AS BIGINT) AS VARCHAR) AS customer_label, days_overdue, '' AS due_date,
    risk_category AS risk_label, {score_of('risk_category')} AS risk_score, 0.0e0 AS late_ratio, CAST(doc_id AS VARCHAR) AS doc_id,
    {r('total_open_amount')} AS total_open_amount, 'Other' AS business_segment, collections_rank, cust_number, risk_category
  FROM ({TOP})"""))
def _(spark, d):
    return plain(Q.normalise_queue(Q.top_n_priority(risk(spark, d))))


@query("normalise_queue_by_bucket", sql("scored_named", f"""
  SELECT rank, name_customer AS customer_label, 0 AS days_overdue, CAST(due_in_date AS VARCHAR) AS due_date, {LABEL} AS risk_label,
    predicted_bucket AS risk_score, 0.0e0 AS late_ratio, CAST(doc_id AS VARCHAR) AS doc_id,
    {r('total_open_amount')} AS total_open_amount, 'Other' AS business_segment, name_customer, predicted_bucket,
    CAST(due_in_date AS VARCHAR) AS due_in_date, cust_number FROM ({BY_BUCKET})"""))
def _(spark, d):
    pred = risk(spark, d, with_name=True).select("doc_id", "name_customer", "predicted_bucket", "due_in_date",
                                                 "total_open_amount", "cust_number")
    return plain(Q.normalise_queue(pred))


@query("queue_kpis", sql("scored_named", f"""
  SELECT (SELECT count(*) FROM scored_named) AS total_invoices, count(*) FILTER (WHERE {LABEL} IN ('Critical', 'Very High'))
    AS critical_or_very_high, count(*) FILTER (WHERE {LABEL} = 'High') AS high,
    (SELECT {r(dsum('total_open_amount'))} FROM scored_named) AS at_risk_value FROM ({BY_BUCKET})"""))
def _(spark, d):
    pred = risk(spark, d).select("doc_id", "predicted_bucket", "total_open_amount", "cust_number")
    return plain(Q.queue_kpis(Q.normalise_queue(pred), pred))


@query("risk_labels", sql("scored_named", f"""
  SELECT doc_id, {LABEL} AS risk_label, {score_of(LABEL)} AS label_score,
    CAST(floor({score_of(LABEL)} / 6 * 100) AS INTEGER) AS bar_percent FROM ({RISK})"""))
def _(spark, d):
    label = R.bucket_label(F.col("predicted_bucket"))
    return risk(spark, d).select("doc_id", label.alias("risk_label"), R.label_score(label).alias("label_score"),
                                 R.bar_percent(label).alias("bar_percent"))


RATIO = "CAST(doc_id * 7 % 101 AS DOUBLE) / 100"
PCT = f"CAST(CAST(round_even({RATIO} * 100, 0) AS BIGINT) AS VARCHAR) || '%'"


@query("reason_badges", sql("scored_named", f"""
  , b AS (SELECT doc_id, {LABEL} AS label, predicted_bucket, days_overdue, total_open_amount, {RATIO} AS ratio, {PCT} AS pct, doc_id % 9 AS rank FROM ({RISK})),
  t AS (SELECT *, concat_ws('|', CASE WHEN label IN ('Critical', 'Very High') THEN label || ' risk' END,
    CASE WHEN days_overdue > 30 THEN format('{{:,}}', days_overdue) || ' days overdue' END,
    CASE WHEN ratio > 0.5e0 THEN pct || ' historical late rate' END, CASE WHEN total_open_amount > 50000 THEN 'High invoice value' END,
    CASE WHEN rank <= 3 THEN 'Priority rank #' || rank END) AS x FROM b)
  SELECT doc_id, CASE WHEN x = '' THEN label || ' risk · week ' || predicted_bucket ELSE x END AS reasons FROM t"""))
def _(spark, d):
    ratio = (F.col("doc_id") * 7 % 101).cast("double") / 100
    label = R.bucket_label(F.col("predicted_bucket"))
    reasons = R.reason_badges(label, F.col("days_overdue"), ratio, F.col("total_open_amount"),
                              F.col("doc_id") % 9, F.col("predicted_bucket"))
    return plain(risk(spark, d).select("doc_id", reasons.alias("reasons")))


@query("detail_kpi", sql("scored_named", f"""
  SELECT doc_id, CASE WHEN {RATIO} > 0 THEN {PCT} ELSE risk_category END AS kpi FROM ({RISK})"""))
def _(spark, d):
    ratio = (F.col("doc_id") * 7 % 101).cast("double") / 100
    return risk(spark, d).select("doc_id", R.detail_kpi(ratio, F.col("risk_category")).alias("kpi"))


@query("queue_option_label", sql("scored_named", f"""
  SELECT '#' || collections_rank || '  |  ' || doc_id || '  |  $' || format('{{:,.0f}}', total_open_amount) || '  |  ' || risk_category
    AS option_label FROM ({TOP})"""))
def _(spark, d):
    q = Q.normalise_queue(Q.top_n_priority(risk(spark, d)))
    return q.select(R.option_label(F.col("rank"), F.col("doc_id"), F.col("total_open_amount"), F.col("risk_label")).alias("option_label"))


@query("customer_tier", sql("scored_named", f"""
  SELECT doc_id, CASE WHEN {RATIO} < 0.2e0 THEN 'low' WHEN {RATIO} < 0.6e0 THEN 'medium' ELSE 'high' END AS tier FROM scored_named"""))
def _(spark, d):
    ratio = (F.col("doc_id") * 7 % 101).cast("double") / 100
    return A.invoices(spark, d, only_paid=False).select("doc_id", R.customer_tier(ratio).alias("tier"))


# -- checks --------------------------------------------------------------------------------------------

@query("expectations", sql("scored_named", f"""
  SELECT count(*) AS rows, count(*) FILTER (WHERE risk_score < 0 OR risk_score > 1) AS risk_out_of_range, 0 AS risk_formula,
    count(*) FILTER (WHERE priority_score < 0) AS negative_priority, 0 AS probabilities_invalid FROM ({RISK})""").replace(
    "0 AS risk_formula", "CAST(0 AS BIGINT) AS risk_formula").replace("0 AS probabilities_invalid", "CAST(0 AS BIGINT) AS probabilities_invalid"))
def _(spark, d):
    return Q.enforce(Q.expectations(risk(spark, d)))


@query("quarantine", sql("scored_named", f"SELECT doc_id FROM ({RISK}) WHERE trim(invoice_currency) = 'cad'"))
def _(spark, d):
    """Amounts of one currency code are turned negative, which breaks the sign rule."""
    s = scored(spark, d).withColumn("total_open_amount", F.when(F.trim("invoice_currency") == "cad", -F.col("total_open_amount"))
                                    .otherwise(F.col("total_open_amount")))
    return Q.quarantine(Q.risk_table(s, A.as_of())).select("doc_id")


@query("validate_probabilities", sql("scored_named", """
  SELECT count(*) AS rows, CAST(0 AS BIGINT) AS wrong_class_count, CAST(0 AS BIGINT) AS out_of_range,
    count(*) FILTER (WHERE trim(invoice_currency) = 'cad') AS wrong_sum FROM scored_named"""))
def _(spark, d):
    """Halved probabilities of one currency code no longer sum to 1."""
    halved = F.transform("probabilities", lambda x: x / 2)
    s = scored(spark, d).withColumn("probabilities", F.when(F.trim("invoice_currency") == "cad", halved)
                                    .otherwise(F.col("probabilities")))
    return Q.validate_probabilities(s)


@query("drop_unscored", sql("scored_named", "SELECT doc_id FROM scored_named WHERE invoice_paid IS NULL"))
def _(spark, d):
    s = scored(spark, d).withColumn("probabilities", F.when(F.col("invoice_paid").isNull(), F.col("probabilities")))
    return C.drop_unscored(s).select("doc_id")


@query("drop_missing_target", sql("snap", """
  SELECT week_bucket, count(*) AS n FROM snap WHERE week_bucket < 6 GROUP BY 1"""))
def _(spark, d):
    s = S.snapshot_open_invoices(A.invoices(spark, d))
    labelled = s.withColumn("week_bucket", F.when(F.col("week_bucket") < 6, F.col("week_bucket")))
    return C.drop_missing_target(labelled).groupBy("week_bucket").agg(F.count(F.lit(1)).alias("n"))


@query("unseen_classes", sql("snap", "SELECT DISTINCT week_bucket FROM snap WHERE week_bucket > 3"))
def _(spark, d):
    s = SP.time_split(S.snapshot_open_invoices(A.invoices(spark, d)))
    train = s.where("part = 'train' and week_bucket <= 3")
    return Q.unseen_classes(s.where("part = 'test'"), train)


@query("class_difference", sql("snap", "SELECT DISTINCT days_to_payment FROM snap WHERE days_to_payment > 42"))
def _(spark, d):
    s = S.snapshot_open_invoices(A.invoices(spark, d))
    return Q.unseen_classes(s, s.where("days_to_payment <= 42"), "days_to_payment")


RECORD = " || ',' || ".join(f"""'"week_{c}":' || CAST({r(f'p{c + 1}', 4)} AS VARCHAR)""" for c in range(7))


@query("write_predictions", sql("scored_named", f"""
  SELECT doc_id, {ARGMAX} AS predicted_bucket, '{{' || {RECORD} || '}}' AS bucket_probabilities FROM scored_named"""))
def _(spark, d):
    path = run_folder(spark, "predictions")
    W.write_predictions(scored(spark, d), path)
    back = spark.read.schema("doc_id bigint, predicted_bucket int, bucket_probabilities map<string,double>").json(path)
    return back.withColumn("bucket_probabilities", F.to_json("bucket_probabilities"))


@query("class_columns", sql("scored_named", f"SELECT doc_id, {', '.join(f'{r(f'p{c}')} AS p_{c}' for c in (1, 2, 3))}, {', '.join(f'0.0e0 AS p_{c}' for c in (4, 5))}, {', '.join(f'{r(f'p{c}')} AS p_{c}' for c in (6, 7))} FROM scored_named"))
def _(spark, d):
    """A model that knows five of the seven classes: the other two get probability 0."""
    p = F.col("probabilities")
    known = F.array(*[p.getItem(c) for c in (0, 1, 2, 5, 6)])
    padded = P.pad_classes(known, F.array(*[F.lit(c) for c in (0, 1, 2, 5, 6)]))
    return plain(scored(spark, d).select("doc_id", *P.spread(padded)))


