"""Profiles of the raw and clean tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duebook import schema
from duebook.catalog.base import plain, query, r, sql
from duebook.catalog.features import paid
from duebook.operators import profiling as PR
from duebook.operators import sketches as SK
from duebook.operators import snapshots as S
from duebook.session import run_folder
from duebook.sources import adapter as A


def line_sql(columns, body):
    return " UNION ALL ".join(body(c) for c in columns)


CLEAN = list(schema.CLEAN_COLUMNS.values())


@query("null_profile", sql("inv", line_sql(CLEAN, lambda c: f"""
  SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, {r(f'100.0 * (count(*) - count({c})) / count(*)')} AS null_percent FROM inv""")))
def _(spark, d):
    inv = A.invoices(spark, d, only_paid=False)
    return plain(PR.null_profile(inv.select(*CLEAN)))


NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]


@query("describe", line_sql(NUMERIC, lambda c: f"""
  SELECT '{c}' AS column_name, count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})', 3)} AS std,
    CAST(min({c}) AS DOUBLE) AS min, {r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS q50,
    {r(f'quantile_cont({c}, 0.75)')} AS q75, CAST(max({c}) AS DOUBLE) AS max FROM orders"""))
def _(spark, d):
    from duebook.functions.numbers import round_even
    out = PR.describe(A.table(spark, d, "orders"), NUMERIC)
    return plain(out.withColumn("std", round_even(F.col("std"), 3)), 6)


@query("value_counts", sql("inv", "SELECT CAST(invoice_paid AS VARCHAR) AS value, count(*) AS n FROM inv GROUP BY 1"))
def _(spark, d):
    return plain(PR.value_counts(A.invoices(spark, d, only_paid=False), "invoice_paid"))


@query("value_counts_filtered", sql("raw", "SELECT business_year AS value, count(*) AS n FROM raw WHERE upper(trim(invoice_currency)) = 'CAD' GROUP BY 1"))
def _(spark, d):
    inv = A.invoices(spark, d, only_paid=False)
    return PR.value_counts(inv, "business_year", F.upper(F.trim("invoice_currency")) == "CAD")


COUNTED = CLEAN


@query("distinct_counts", sql("inv", line_sql(COUNTED, lambda c: f"""
  SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, CAST(count(DISTINCT {c}) <= 1 AS INTEGER) AS is_constant,
    CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM inv WHERE {c} IS NOT NULL GROUP BY {c})) >= 0.99 * count({c}) AS INTEGER) AS is_quasi_constant FROM inv""")))
def _(spark, d):
    return plain(PR.distinct_counts(A.invoices(spark, d, only_paid=False), COUNTED))


@query("constant_columns", "SELECT 'posting_id' AS column_name, count(DISTINCT 1.0) AS distinct_values FROM orders UNION ALL "
                           "SELECT 'area_business', CAST(0 AS BIGINT) FROM (SELECT count(*) FROM orders)")
def _(spark, d):
    return PR.constant_columns(A.raw_invoices(spark, d, with_name=True))


@query("histogram", line_sql(NUMERIC, lambda c: f"""
  SELECT '{c}' AS column_name, CAST(least(floor((CAST({c} AS DOUBLE) - lo) * 50.0 / (hi - lo)), 49) AS INTEGER) AS bin, count(*) AS n
  FROM orders CROSS JOIN (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM orders) GROUP BY 1, 2"""))
def _(spark, d):
    return PR.histogram(A.table(spark, d, "orders"), NUMERIC)


PAIRED = ["doc_id", "business_year", "total_open_amount", "isOpen"]
PAIR_SOURCE = "(SELECT doc_id, business_year, raw_amount AS total_open_amount, CAST(invoice_paid IS NULL AS INTEGER) AS isOpen FROM raw)"
MATRIX = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {r(f'corr({a}, {b})')} AS correlation FROM {PAIR_SOURCE}"
    for a in PAIRED for b in PAIRED)


def paired(spark, d):
    raw = A.raw_invoices(spark, d)
    return raw.select("doc_id", F.col("buisness_year").alias("business_year"), "total_open_amount", "isOpen")


@query("correlation_matrix", sql("raw", MATRIX))
def _(spark, d):
    return plain(PR.correlation_matrix(paired(spark, d)))


@query("top_correlated_pairs", sql("raw", f"""
  SELECT feature_1, feature_2, correlation, abs(correlation) AS absolute_correlation FROM ({MATRIX})
  WHERE feature_1 <> feature_2 ORDER BY absolute_correlation DESC, feature_1, feature_2 LIMIT 30"""))
def _(spark, d):
    return PR.top_correlated_pairs(plain(PR.correlation_matrix(paired(spark, d))))


DAYS = ["invoice_sent", "due_in_date", "invoice_paid"]


@query("date_correlation", sql("inv", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, "
    + r(f"corr({a} - DATE '1970-01-01', {b} - DATE '1970-01-01')", 5) + " AS correlation FROM inv"
    for a in DAYS for b in DAYS)))
def _(spark, d):
    return plain(PR.date_correlation(A.invoices(spark, d, only_paid=False), DAYS), 5)


@query("duplicate_count", "SELECT count(*) AS duplicates, count(*) AS distinct_rows FROM orders")
def _(spark, d):
    raw = A.raw_invoices(spark, d)
    return PR.duplicate_count(raw.unionByName(raw))


@query("equal_column_count", "SELECT count(*) FILTER (WHERE o_orderkey = o_custkey) AS equal_rows FROM orders")
def _(spark, d):
    return PR.equal_column_count(A.table(spark, d, "orders"), "o_orderkey", "o_custkey")


@query("open_closed_counts", sql("inv", """
  SELECT count(*) FILTER (WHERE invoice_paid IS NULL) AS open_invoices, count(invoice_paid) AS closed_invoices FROM inv"""))
def _(spark, d):
    return PR.open_closed_counts(A.raw_invoices(spark, d))


VARIANCES = schema.MODEL_FEATURES


@query("variance_threshold", sql("feat", line_sql(VARIANCES, lambda c: f"""
  SELECT '{c}' AS feature, {r(f'var_pop({c})')} AS variance, CAST(var_pop({c}) > 0.05 AS INTEGER) AS kept FROM feat""")))
def _(spark, d):
    return plain(PR.variance_threshold(S.build_snapshots(paid(spark, d)), VARIANCES))


def order_sketches(spark, d):
    """Sketches of the orders, one batch for each order status, kept and read back."""
    orders, root = A.table(spark, d, "orders"), run_folder(spark, "sketches")
    for status in ("F", "O", "P"):
        SK.add_batch(root, SK.batch_sketches(orders.where(F.col("o_orderstatus") == status), NUMERIC, ["o_orderpriority"], F.lit(status)), status)
    return SK.merged_sketches(SK.read_batches(spark, root))


@query("sketched_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS probability, count({c}) AS present, 1 AS within FROM orders" for c in NUMERIC for p in (0.1, 0.25, 0.5, 0.75, 0.9)))
def _(spark, d):
    """Quantiles from sketches that three batches have left; ``within`` says that the share of rows up to each is off by 1 % at most."""
    merged = order_sketches(spark, d)
    found = SK.approximate_quantiles(merged, (0.1, 0.25, 0.5, 0.75, 0.9))
    values = A.table(spark, d, "orders").select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in NUMERIC])).alias("x"))
    below = values.select("x.*").join(F.broadcast(found), "column_name").groupBy("column_name", "probability").agg(
        F.count("v").alias("present"), F.avg((F.col("v") < F.col("value")).cast("double")).alias("below"),
        F.avg((F.col("v") <= F.col("value")).cast("double")).alias("upto"))
    p = F.col("probability")
    return below.select("column_name", "probability", "present", ((F.col("below") <= p + 0.01) & (F.col("upto") >= p - 0.01)).cast("int").alias("within"))


@query("sketched_distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS exact, 1 AS within FROM orders" for c in [*NUMERIC, "o_orderpriority"]))
def _(spark, d):
    """Distinct counts from the union of three batches' sketches; ``within`` says that each is off by 5 % at most."""
    found = SK.approximate_distinct(order_sketches(spark, d))
    exact = PR.distinct_counts(A.table(spark, d, "orders"), [*NUMERIC, "o_orderpriority"]).select("column_name", F.col("distinct_values").alias("exact"))
    off = F.abs(F.col("distinct_values") - F.col("exact")) / F.col("exact")
    return exact.join(found, "column_name").select("column_name", "exact", (off <= 0.05).cast("int").alias("within"))
