"""Readers, writers, projections, filters, duplicates, history upkeep, checks of the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from duebook import schema
from duebook.catalog.base import AS_OF, dsum, plain, query, r, sql
from duebook.functions import risk as R
from duebook.functions.dates import parse_timestamp, parse_yyyymmdd
from duebook.operators import cleaning as C
from duebook.operators import history as H
from duebook.operators import joins as J
from duebook.operators import queue as Q
from duebook.operators import splits as SP
from duebook.session import run_folder
from duebook.sources import adapter as A
from duebook.sources import readers as RD
from duebook.sources.ledger import Ledger
from duebook.sources import writers as W

CLEAN = f"""SELECT doc_id, cust_number, business_year, CAST(due_in_date AS VARCHAR) AS due_in_date, invoice_currency, document_type,
  {r('total_open_amount')} AS total_open_amount, CAST(invoice_sent AS VARCHAR) AS invoice_sent, cust_payment_terms,
  CAST(invoice_paid AS VARCHAR) AS invoice_paid"""
CSV = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def raw_file(spark, d, fmt: str = "csv") -> str:
    """The raw invoices written to a fresh folder in the given format."""
    path = run_folder(spark, f"raw-{fmt}")
    raw = A.raw_invoices(spark, d).withColumn("doc_id", F.col("doc_id").cast("double"))
    writer = raw.write
    if fmt == "csv":
        writer = writer.options(header=True, **CSV)
    writer.format(fmt).save(path)
    return path


@query("read_invoices", sql("inv", f"{CLEAN} FROM inv"))
def _(spark, d):
    return plain(C.clean_invoices(RD.read_invoices(spark, raw_file(spark, d)), only_paid=False))


@query("read_invoices_parquet", sql("paid", f"{CLEAN} FROM paid"))
def _(spark, d):
    return plain(C.clean_invoices(RD.read_invoices(spark, raw_file(spark, d, "parquet"), "parquet")))


@query("read_invoices_orc", sql("paid", f"{CLEAN} FROM paid"))
def _(spark, d):
    return plain(C.clean_invoices(RD.read_invoices(spark, raw_file(spark, d, "orc"), "orc")))


@query("read_invoices_json", sql("paid", f"{CLEAN} FROM paid"))
def _(spark, d):
    return plain(C.clean_invoices(RD.read_invoices(spark, raw_file(spark, d, "json"), "json")))


@query("read_uploaded_batch", sql("raw", f"SELECT count(*) AS invoices, {r(dsum('raw_amount'))} AS outstanding FROM raw"))
def _(spark, d):
    return plain(C.upload_summary(RD.read_uploaded_batch(spark, raw_file(spark, d))))


@query("read_history", sql("paid", f"{CLEAN} FROM paid"))
def _(spark, d):
    return plain(RD.read_history(spark, run_folder(spark, "history"), seed=A.invoices(spark, d)))


@query("read_playbook", """
  SELECT md5(text || chr(10)) AS digest, CAST(length(text) + 1 AS INTEGER) AS chars FROM documents""")
def _(spark, d):
    """Every document written to a file of its own, then read back whole."""
    path = run_folder(spark, "playbook")
    folders = W.write_texts(A.table(spark, d, "documents").select("text"), path)
    return RD.read_playbook(spark, folders, "*.txt").select(F.md5("text").alias("digest"), F.length("text").alias("chars"))


@query("write_clean", sql("paid", f"{CLEAN} FROM paid"))
def _(spark, d):
    path = run_folder(spark, "clean")
    W.write_clean(A.invoices(spark, d), path)
    return plain(spark.read.schema(schema.CLEAN_INVOICE).parquet(path))


@query("write_history", sql("paid raw", f"""
  , h AS (SELECT cust_number, avg(CASE WHEN invoice_paid <= {AS_OF} THEN greatest(invoice_paid - due_in_date, 0) END) AS delay,
    avg(CASE WHEN invoice_paid <= {AS_OF} THEN CASE WHEN invoice_paid > due_in_date THEN 1e0 ELSE 0e0 END END) AS ratio,
    count(CASE WHEN invoice_sent < {AS_OF} THEN 1 END) AS n FROM paid GROUP BY 1)
  SELECT doc_id, cust_number, {r('delay')} AS customer_avg_delay, {r('ratio')} AS late_payment_ratio, n AS prev_transaction_count,
    CASE WHEN invoice_paid > {AS_OF} THEN CAST({AS_OF} - invoice_sent AS INTEGER) END AS invoice_age_days,
    business_code, strftime(invoice_paid, '%Y-%m-%d') AS clear_date
  FROM paid LEFT JOIN h USING (cust_number)"""))
def _(spark, d):
    path = run_folder(spark, "history")
    raw = A.raw_invoices(spark, d)
    W.write_history(A.invoices(spark, d), raw.unionByName(raw), A.as_of(), path)
    return plain(spark.read.parquet(path).select(
        "doc_id", "cust_number", "customer_avg_delay", "late_payment_ratio", "prev_transaction_count",
        "invoice_age_days", "business_code", "clear_date"))


@query("upsert_history", sql("inv", f"""
  SELECT doc_id, cust_number, CAST(invoice_paid AS VARCHAR) AS invoice_paid,
    CASE WHEN invoice_paid IS NULL THEN {r('total_open_amount + 1')} ELSE {r('total_open_amount')} END AS total_open_amount,
    CASE WHEN invoice_paid IS NULL THEN {r('ln(1 + total_open_amount)')} END AS invoice_amount_log FROM inv"""))
def _(spark, d):
    """Open invoices arrive again with a changed amount and a feature the history lacks."""
    every = A.invoices(spark, d, only_paid=False)
    batch = every.where("invoice_paid is null").withColumn("total_open_amount", F.col("total_open_amount") + 1)
    features = every.select("doc_id", F.log1p("total_open_amount").alias("invoice_amount_log"))
    merged = H.upsert_history(every, batch, features)
    return plain(merged.select("doc_id", "cust_number", "invoice_paid", "total_open_amount", "invoice_amount_log"))


LAST_FILE = sql("inv", f"""
  SELECT doc_id, {r('CASE WHEN invoice_paid IS NULL THEN total_open_amount + 2 WHEN doc_id % 3 = 0 THEN total_open_amount + 1 ELSE total_open_amount END')}
    AS total_open_amount, CAST(invoice_sent AS VARCHAR) AS invoice_sent, CASE WHEN invoice_paid IS NULL OR doc_id % 3 = 0 THEN 'new' END AS note FROM inv""")


def arrivals(spark, d):
    """The paid invoices as history, and a folder of files: of every third and every open invoice, then of the open ones again, in more or fewer files.

    Each task writes a file of its own; those of the second upload are later than all of the first."""
    every = A.invoices(spark, d, only_paid=False).select("doc_id", "total_open_amount", "invoice_sent", "invoice_paid")
    path = run_folder(spark, "landing")
    news = every.withColumn("note", F.lit("new"))
    for more, rows in enumerate([news.where("invoice_paid IS NULL OR doc_id % 3 = 0"), news.where("invoice_paid IS NULL")]):
        changed = rows.withColumn("total_open_amount", F.col("total_open_amount") + more + 1).drop("invoice_paid")
        changed.write.mode("append").parquet(path)
    return C.paid_only(every).drop("invoice_paid"), spark.read.parquet(path)


@query("upsert_uploaded_files", LAST_FILE)
def _(spark, d):
    """A batch of two uploads that repeat ids: the row of the later file stays, whichever file is larger."""
    history, batch = arrivals(spark, d)
    return plain(H.upsert_history(history, batch).select("doc_id", "total_open_amount", "invoice_sent", "note"))


@query("upsert_ledger", LAST_FILE)
def _(spark, d):
    """The same batch into a stored history."""
    history, batch = arrivals(spark, d)
    ledger = Ledger(spark, run_folder(spark, "ledger"), buckets=16)
    ledger.create(history)
    ledger.upsert(batch)
    return plain(ledger.read().select("doc_id", "total_open_amount", "invoice_sent", "note"))


@query("compact_ledger", LAST_FILE)
def _(spark, d):
    """New ids only add runs; compacting merges them, and vacuum leaves the last version alone."""
    history, batch = arrivals(spark, d)
    ledger = Ledger(spark, run_folder(spark, "ledger"), buckets=16)
    ledger.create(history.where("doc_id % 5 = 0"))
    for part in range(1, 5):
        ledger.upsert(history.where(F.col("doc_id") % 5 == part))
    ledger.upsert(batch)
    ledger.compact(runs=1)
    ledger.vacuum()
    return plain(ledger.read().select("doc_id", "total_open_amount", "invoice_sent", "note"))


@query("union_history", sql("inv", f"""
  SELECT doc_id, {r('total_open_amount')} AS total_open_amount, NULL AS note FROM inv WHERE invoice_paid IS NOT NULL UNION ALL
  SELECT doc_id, {r('total_open_amount')}, 'new' FROM inv WHERE invoice_paid IS NULL"""))
def _(spark, d):
    every = A.invoices(spark, d, only_paid=False).select("doc_id", "total_open_amount", "invoice_paid")
    new = every.where("invoice_paid is null").drop("invoice_paid").withColumn("note", F.lit("new"))
    return plain(H.union_history(C.paid_only(every).drop("invoice_paid"), new))


# -- projections and filters ---------------------------------------------------------------------------

@query("strip_column_names", sql("raw", "SELECT doc_id, document_type, raw_amount AS total_open_amount FROM raw"))
def _(spark, d):
    padded = A.raw_invoices(spark, d).select(F.col("doc_id").alias(" doc_id"), F.col("document type").alias("document_type  "),
                                             F.col("total_open_amount").alias("total_open_amount "))
    return C.strip_column_names(padded)


@query("select_rename", sql("paid", f"{CLEAN} FROM paid"))
def _(spark, d):
    return plain(A.invoices(spark, d))


@query("drop_columns", sql("raw", "SELECT business_code, cust_number, doc_id, raw_amount AS total_open_amount, cust_payment_terms FROM raw"))
def _(spark, d):
    absent = ["no_such_column"]
    kept = ["business_code", "cust_number", "doc_id", "total_open_amount", "cust_payment_terms"]
    raw = A.raw_invoices(spark, d)
    return C.drop_columns(raw, [c for c in raw.columns if c not in kept] + absent)


@query("drop_invalid_ids", sql("raw", "SELECT doc_id, invoice_currency FROM raw WHERE trim(invoice_currency) = 'USD' AND business_year <> 2021"))
def _(spark, d):
    """Ids are made unreadable for CAD invoices and null for one business year."""
    raw = A.raw_invoices(spark, d)
    broken = (F.when(F.col("buisness_year") == 2021, F.lit(None).cast("string"))
              .when(F.trim("invoice_currency") == "USD", F.col("invoice_id").cast("string")).otherwise("abc"))
    return C.drop_invalid_ids(raw.withColumn("invoice_id", broken)).select("doc_id", "invoice_currency")


@query("paid_only", sql("paid", "SELECT doc_id, CAST(invoice_paid AS VARCHAR) AS invoice_paid FROM paid"))
def _(spark, d):
    return plain(C.paid_only(A.invoices(spark, d, only_paid=False)).select("doc_id", "invoice_paid"))


@query("open_at", sql("inv", f"SELECT doc_id FROM inv WHERE invoice_paid IS NULL OR invoice_paid > {AS_OF}"))
def _(spark, d):
    return C.open_at(A.invoices(spark, d, only_paid=False), A.as_of()).select("doc_id")


@query("paid_by", sql("inv", f"SELECT doc_id FROM inv WHERE invoice_paid <= {AS_OF}"))
def _(spark, d):
    return C.paid_by(A.invoices(spark, d, only_paid=False), A.as_of()).select("doc_id")


@query("sent_before", sql("inv", f"SELECT doc_id FROM inv WHERE invoice_sent < {AS_OF}"))
def _(spark, d):
    return C.sent_before(A.invoices(spark, d, only_paid=False), A.as_of()).select("doc_id")


@query("valid_date_order", sql("raw", "SELECT doc_id FROM raw WHERE coalesce(invoice_paid >= due_in_date, true)"))
def _(spark, d):
    raw = A.raw_invoices(spark, d)
    dated = raw.select("doc_id", parse_timestamp(F.col("clear_date")).cast("date").alias("due_in_date"),
                       parse_yyyymmdd(F.col("due_in_date")).alias("document_create_date"))
    return C.valid_date_order(dated).select("doc_id")


@query("sort_by_sent", sql("inv", f"SELECT doc_id, CAST(invoice_sent AS VARCHAR) AS invoice_sent FROM inv ORDER BY invoice_sent, doc_id"))
def _(spark, d):
    return plain(SP.sort_by_sent(A.invoices(spark, d, only_paid=False).select("doc_id", "invoice_sent")))


# -- duplicates ----------------------------------------------------------------------------------------

@query("dedupe_rows", sql("raw", "SELECT doc_id, cust_number, raw_amount AS total_open_amount FROM raw"))
def _(spark, d):
    raw = A.raw_invoices(spark, d)
    return C.dedupe_rows(raw.unionByName(raw)).select("doc_id", "cust_number", "total_open_amount")


def twice(spark, d):
    inv = A.invoices(spark, d, only_paid=False).select("doc_id", "total_open_amount")
    later = inv.withColumn("total_open_amount", F.col("total_open_amount") + 1).withColumn("seq", F.lit(1))
    return inv.withColumn("seq", F.lit(0)).unionByName(later)


@query("keep_first", sql("inv", f"SELECT doc_id, {r('total_open_amount')} AS total_open_amount, 0 AS seq FROM inv"))
def _(spark, d):
    return plain(C.keep_first(twice(spark, d), "doc_id", "seq"))


@query("keep_last", sql("inv", f"SELECT doc_id, {r('total_open_amount + 1')} AS total_open_amount, 1 AS seq FROM inv"))
def _(spark, d):
    return plain(C.keep_last(twice(spark, d), "doc_id", "seq"))


@query("dedupe_by_key", sql("inv", """
  SELECT cust_number, doc_id, CAST(invoice_sent AS VARCHAR) AS invoice_sent FROM (
    SELECT *, row_number() OVER (PARTITION BY cust_number ORDER BY invoice_sent DESC, doc_id DESC) AS k FROM inv) WHERE k = 1"""))
def _(spark, d):
    inv = A.invoices(spark, d, only_paid=False).select("cust_number", "doc_id", "invoice_sent")
    return plain(C.keep_one(inv, "cust_number", [-F.unix_date("invoice_sent"), -F.col("doc_id")]))


# -- joins of the table side ---------------------------------------------------------------------------

@query("add_missing_columns", sql("inv raw", """
  SELECT inv.doc_id, inv.cust_number, raw.business_code, raw.raw_amount FROM inv JOIN raw ON inv.doc_id = raw.doc_id"""))
def _(spark, d):
    raw = A.raw_invoices(spark, d).select("doc_id", "cust_number", "business_code", F.col("total_open_amount").alias("raw_amount"))
    left = A.invoices(spark, d, only_paid=False).select("doc_id", "cust_number")
    return J.add_missing_columns(left, raw.unionByName(raw))


@query("fx_lookup_join", sql("raw", f"""
  , x AS (SELECT doc_id, invoice_currency, business_year, raw_amount, CASE business_year WHEN 2018 THEN 0.772e0 WHEN 2019 THEN 0.754e0
     WHEN 2020 THEN 0.746e0 WHEN 2021 THEN 0.798e0 END AS rate FROM raw)
  SELECT doc_id, rate AS cad_usd_rate, {r("CASE WHEN trim(invoice_currency) = 'CAD' THEN raw_amount * rate ELSE raw_amount END")} AS amount_usd,
    {r("ln(1 + CASE WHEN trim(invoice_currency) = 'CAD' THEN raw_amount * rate ELSE raw_amount END)")} AS amount_usd_log FROM x"""))
def _(spark, d):
    """Rates apply to the trimmed currency code, so the padded lower-case codes stay as they are."""
    rates = spark.createDataFrame(list(schema.CAD_USD_LOOKUP.items()), "business_year bigint, cad_usd_rate double")
    raw = A.raw_invoices(spark, d)
    inv = raw.select("doc_id", F.trim("invoice_currency").alias("invoice_currency"),
                     F.col("buisness_year").cast("bigint").alias("business_year"),
                     F.col("total_open_amount").alias("invoice_amount"))
    return plain(J.fx_lookup_join(inv, rates).select("doc_id", "cad_usd_rate", "amount_usd", "amount_usd_log"))


@query("segment_lookup", sql("inv", """
  SELECT doc_id, coalesce(c_mktsegment, 'Other') AS business_segment FROM inv
  LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey"""))
def _(spark, d):
    """Segments are known for customers in credit only; the rest shows the default."""
    segments = (A.table(spark, d, "customer").where("c_acctbal > 0")
                .select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cust_number"),
                        F.col("c_mktsegment").alias("business_segment")))
    return J.segment_lookup(A.invoices(spark, d, only_paid=False), segments).select("doc_id", "business_segment")


@query("attach_customer_name", sql("named", "SELECT doc_id, name_customer FROM named"))
def _(spark, d):
    names = A.invoices(spark, d, only_paid=False, with_name=True).select("doc_id", "name_customer")
    queue = A.invoices(spark, d, only_paid=False).select("doc_id")
    return J.attach_customer_name(queue, names.unionByName(names))


def requests(spark, d):
    """Requests for every invoice and for one unknown id per invoice; amounts are given for CAD only."""
    inv = A.invoices(spark, d, only_paid=False, with_name=True)
    ask = inv.select("doc_id", F.when(F.upper(F.trim("invoice_currency")) == "CAD", F.lit(1.0)).alias("total_open_amount"))
    unknown = inv.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit(2.0).alias("total_open_amount"))
    history = inv.withColumn("days_past_due", F.datediff(A.as_of(), "due_in_date"))
    return ask.unionByName(unknown), history


@query("enrich_request", sql("named", f"""
  SELECT doc_id, name_customer, cust_number, CASE WHEN upper(trim(invoice_currency)) = 'CAD' THEN 1.0e0 ELSE {r('total_open_amount')} END
    AS total_open_amount, CAST(due_in_date AS VARCHAR) AS due_in_date, CAST({AS_OF} - due_in_date AS INTEGER) AS days_past_due FROM named"""))
def _(spark, d):
    ask, history = requests(spark, d)
    return plain(J.enrich_request(ask, history, schema.REQUEST_FIELDS))


@query("unknown_requests", sql("inv", "SELECT -doc_id - 1 AS doc_id FROM inv"))
def _(spark, d):
    ask, history = requests(spark, d)
    return J.unknown_requests(ask, history).select("doc_id")


# -- checks of the input -------------------------------------------------------------------------------

@query("required_columns", """
  SELECT 'days_past_due' AS missing_column, count(*) AS rows FROM orders UNION ALL SELECT 'name_customer', count(*) FROM orders""")
def _(spark, d):
    """Names of the request fields the clean table lacks, next to the rows concerned."""
    inv = A.invoices(spark, d, only_paid=False)
    missing = Q.required_columns(inv, schema.REQUEST_FIELDS)
    return inv.agg(F.count(F.lit(1)).alias("rows")).select(
        F.explode(F.array(*[F.lit(c) for c in missing])).alias("missing_column"), "rows")


@query("required_fields", sql("inv", """
  SELECT CASE WHEN invoice_paid IS NULL THEN 'name_customer|days_past_due|invoice_paid' ELSE 'name_customer|days_past_due' END
    AS missing_fields, count(*) AS rows FROM inv GROUP BY 1"""))
def _(spark, d):
    inv = A.invoices(spark, d, only_paid=False)
    checked = plain(Q.required_fields(inv, [*schema.REQUEST_FIELDS, "invoice_paid"]))
    return checked.groupBy("missing_fields").agg(F.count(F.lit(1)).alias("rows"))


@query("upload_summary", sql("inv", f"SELECT count(*) AS invoices, {r(dsum('total_open_amount'))} AS outstanding FROM inv"))
def _(spark, d):
    return plain(C.upload_summary(A.invoices(spark, d, only_paid=False)))


@query("currency_control_totals", sql("inv", f"""
  SELECT {r(dsum('raw_amount'))} AS total_before, {r(dsum('total_open_amount'))} AS total_after,
    {r(dsum("CASE WHEN upper(trim(invoice_currency)) = 'CAD' THEN raw_amount END"))} AS cad_before,
    {r(dsum("CASE WHEN upper(trim(invoice_currency)) = 'CAD' THEN total_open_amount END"))} AS cad_after FROM inv"""))
def _(spark, d):
    return plain(C.currency_control_totals(A.raw_invoices(spark, d)))


@query("format_id_and_date", sql("raw", """
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id_text, strftime(due_in_date, '%Y-%m-%d') AS due_text, cust_payment_terms AS other_text FROM raw"""))
def _(spark, d):
    raw = A.raw_invoices(spark, d)
    return raw.select("doc_id", R.format_id(F.col("invoice_id")).alias("id_text"),
                      R.format_date(F.col("due_in_date")).alias("due_text"),
                      R.format_date(F.col("cust_payment_terms")).alias("other_text"))
