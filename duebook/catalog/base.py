"""Registry of queries and the shared parts of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook import schema
from duebook.functions.numbers import round_even

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name; without ``sql`` only its rows are checked."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def plain(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Dates, booleans and arrays in a form both engines print alike; doubles rounded half to even."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        elif isinstance(f.dataType, T.DoubleType) and digits is not None:
            c = round_even(c, digits)
        out.append(c.alias(f.name))
    return df.select(*out)


# -- SQL building blocks ----------------------------------------------------------------------------

WEEKS = schema.FORECAST_WEEKS
CLASSES = range(1, schema.N_CLASSES + 1)
AS_OF = "DATE '2001-06-01'"


def r(expression: str, digits: int = 6) -> str:
    return f"round_even(({expression}) * 1e{digits}, 0) / 1e{digits}"


def dsum(expression: str) -> str:
    return f"CAST(sum(CAST({expression} AS DECIMAL(28,6))) AS DOUBLE)"


def mean(expression: str, digits: int = 6) -> str:
    """Mean of amounts from an exact sum."""
    return r(f"{dsum(expression)} / count({expression})", digits)


USD = ("CASE WHEN upper(trim(invoice_currency)) = 'CAD' THEN raw_amount * CASE business_year "
       "WHEN 2018 THEN 0.771e0 WHEN 2019 THEN 0.754e0 WHEN 2020 THEN 0.745e0 ELSE 0.75e0 END ELSE raw_amount END")

PARTS: dict[str, tuple[list[str], str]] = {
    "raw": ([], """
      SELECT o_orderstatus AS business_code, o_custkey, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cust_number,
        o_orderkey AS doc_id, 2018 + o_custkey % 4 AS business_year,
        CASE WHEN o_custkey % 20 = 0 THEN ' cad ' WHEN o_custkey % 10 = 0 THEN 'CAD' ELSE 'USD' END AS invoice_currency,
        CASE WHEN o_orderstatus = 'P' THEN 'X2' ELSE 'RV' END AS document_type, o_totalprice AS raw_amount,
        CAST(o_orderdate AS DATE) AS invoice_sent, CAST(o_orderdate AS DATE) + terms AS due_in_date,
        'NA' || CAST(terms AS VARCHAR) AS cust_payment_terms,
        CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + CAST(1 + (o_orderkey * 37) % 97 AS INTEGER) END
          AS invoice_paid
      FROM (SELECT *, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 10 WHEN '2' THEN 15 WHEN '3' THEN 30
                      WHEN '4' THEN 45 WHEN '5' THEN 60 END AS terms FROM orders)"""),
    "inv": (["raw"], f"SELECT *, {USD} AS total_open_amount FROM raw"),
    "named": (["inv"], "SELECT inv.*, c_name AS name_customer FROM inv LEFT JOIN customer ON c_custkey = o_custkey"),
    "paid": (["inv"], "SELECT * FROM inv WHERE invoice_paid IS NOT NULL"),
    "grid": (["paid"], """
      SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS reference_date
      FROM (SELECT min(invoice_sent) AS lo, max(invoice_paid) - 42 AS hi FROM paid)"""),
    "snap": (["paid", "grid"], """
      SELECT *, least(greatest(CAST(floor(days_to_payment / 7.0) AS INTEGER), 0), 6) AS week_bucket FROM (
        SELECT paid.*, reference_date, CAST(invoice_paid - reference_date AS INTEGER) AS days_to_payment
        FROM paid JOIN grid ON invoice_sent <= reference_date AND invoice_paid > reference_date)"""),
    "hist": (["paid", "snap"], """
      SELECT p.cust_number, p.reference_date,
        avg(CASE WHEN invoice_paid <= p.reference_date THEN greatest(invoice_paid - due_in_date, 0) END) AS customer_avg_delay,
        avg(CASE WHEN invoice_paid <= p.reference_date THEN CASE WHEN invoice_paid > due_in_date THEN 1.0 ELSE 0.0 END END)
          AS late_payment_ratio,
        count(CASE WHEN invoice_sent < p.reference_date THEN 1 END) AS prev_transaction_count,
        max(CASE WHEN invoice_sent < p.reference_date THEN invoice_sent END) AS last_invoice_date
      FROM (SELECT DISTINCT cust_number, reference_date FROM snap) p JOIN paid USING (cust_number) GROUP BY 1, 2"""),
    "feat": (["snap", "hist", "paid"], f"""
      SELECT snap.*, CAST(reference_date - invoice_sent AS INTEGER) AS invoice_age_days,
        CAST(due_in_date - reference_date AS INTEGER) AS days_until_due,
        CAST(due_in_date - invoice_sent AS INTEGER) AS pay_terms_days,
        CAST(month(invoice_sent) AS INTEGER) AS invoice_month, CAST(month(due_in_date) AS INTEGER) AS due_month,
        CAST(reference_date - due_in_date AS INTEGER) AS days_past_due,
        sin(2 * pi() * month(invoice_sent) / 12) AS invoice_month_sin, cos(2 * pi() * month(invoice_sent) / 12) AS invoice_month_cos,
        sin(2 * pi() * month(due_in_date) / 12) AS due_month_sin, cos(2 * pi() * month(due_in_date) / 12) AS due_month_cos,
        customer_avg_delay, late_payment_ratio, coalesce(prev_transaction_count, 0) AS prev_transaction_count,
        0.7e0 * coalesce(late_payment_ratio, 0) + 0.3e0 * coalesce(customer_avg_delay, 0) AS customer_risk_score,
        CAST(reference_date - last_invoice_date AS INTEGER) AS days_since_last_invoice,
        total_open_amount AS invoice_amount, ln(1 + greatest(total_open_amount, 0)) AS invoice_amount_log,
        total_open_amount AS open_amount,
        CASE WHEN total_open_amount <= 10000 THEN 'small' WHEN total_open_amount <= 100000 THEN 'medium' ELSE 'large' END
          AS invoice_size_cat,
        CASE WHEN total_open_amount <= q1 THEN 'small' WHEN total_open_amount <= q2 THEN 'medium' ELSE 'large' END
          AS invoice_size_cat_q
      FROM snap LEFT JOIN hist USING (cust_number, reference_date)
      CROSS JOIN (SELECT quantile_cont(total_open_amount, 0.33) AS q1, quantile_cont(total_open_amount, 0.66) AS q2 FROM paid)"""),
}


def scored_parts(source: str, salt: int = 0) -> str:
    """Columns p1..p7 and the sharpened s1..s7 next to the rows of ``source``."""
    w = ", ".join(f"CAST(1 + (doc_id * {2 * c + 1 + salt}) % 11 AS DOUBLE) AS w{c + 1}" for c in range(7))
    total_w = "(" + " + ".join(f"w{c}" for c in CLASSES) + ")"
    p = ", ".join(f"w{c} / {total_w} AS p{c}" for c in CLASSES)
    z = ", ".join(f"pow(least(greatest(p{c}, 1e-12), 1.0), 1.25) AS z{c}" for c in CLASSES)
    total_z = "(" + " + ".join(f"z{c}" for c in CLASSES) + ")"
    s = ", ".join(f"z{c} / {total_z} AS s{c}" for c in CLASSES)
    return f"""SELECT *, {s} FROM (SELECT *, {z} FROM (SELECT *, {p} FROM (SELECT *, {w} FROM {source})))"""


PARTS["scored_inv"] = (["inv"], scored_parts("inv"))
PARTS["scored_open"] = (["named"], scored_parts("(SELECT * FROM named WHERE invoice_paid IS NULL)"))
PARTS["scored_named"] = (["named"], scored_parts("named"))
PARTS["scored_snap"] = (["snap"], scored_parts("snap"))

ARGMAX = "CASE greatest(p1,p2,p3,p4,p5,p6,p7) " + " ".join(f"WHEN p{c} THEN {c - 1}" for c in CLASSES) + " END"


def sql(parts: str, body: str) -> str:
    """A statement with the named parts, and what they need, in front."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for d in PARTS[name][0]:
            need(d)
        if name not in ordered:
            ordered.append(name)

    for name in parts.split():
        need(name)
    heads = ", ".join(f"{n} AS ({PARTS[n][1]})" for n in ordered)
    return f"WITH {heads} {body}"
