"""Weekly point-in-time snapshots of all open invoices."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from duebook.functions import invoice as I
from duebook.operators.history import asof_customer_history, customer_stats
from duebook.operators.quantiles import amount_quantiles


def snapshot_grid(invoices: DataFrame, anchor: date | None = None, horizon_weeks: int = 6) -> tuple[date, date] | None:
    """First grid date and last date a snapshot may have; None without sent and paid invoices.

    The two dates are fetched, so that the snapshot plan holds constants instead of repeated subqueries.
    """
    first = F.min("invoice_sent") if anchor is None else F.lit(anchor)
    row = invoices.agg(first.alias("first"), F.date_sub(F.max("invoice_paid"), 7 * horizon_weeks).alias("last")).first()
    return None if row["first"] is None or row["last"] is None else (row["first"], row["last"])


def snapshot_open_invoices(invoices: DataFrame, stride_days: int = 7, horizon_weeks: int = 6,
                           anchor: date | None = None, until: date | None = None,
                           bucket_mode: str = "floor0") -> DataFrame:
    """Every invoice on every grid date with ``sent <= date < paid``, with its label.

    The dates of an invoice form one run of the grid, so they are computed from its two ends and exploded:
    no join, no shuffle, and rows appear where the invoice already is. ``anchor`` and ``until`` fix the first
    and last grid date for incremental runs; given both, the table is not read beforehand.
    """
    if anchor is None or until is None:
        grid = snapshot_grid(invoices, anchor, horizon_weeks) or (None, None)
        anchor, until = grid[0], until or grid[1]
    first, last = F.lit(anchor).cast("date"), F.lit(until).cast("date")

    def steps(day: Column) -> Column:
        return F.datediff(day, first) / F.lit(float(stride_days))

    start = F.greatest(F.ceil(steps(F.col("invoice_sent"))), F.lit(0)).cast("int")
    stop = F.least(F.ceil(steps(F.col("invoice_paid"))) - 1, F.floor(steps(last))).cast("int")
    # Plain comparisons of the two dates, so that they reach the scan.
    bounded = (invoices.where((F.col("invoice_sent") <= last) & (F.col("invoice_paid") > first))
               .withColumn("_start", start).withColumn("_stop", stop)
               .where(F.col("_start") <= F.col("_stop")))
    step = F.explode(F.sequence("_start", "_stop"))
    dated = (bounded.withColumn("_k", step)
             .withColumn("reference_date", F.date_add(first, F.col("_k") * stride_days))
             .drop("_start", "_stop", "_k"))
    return label_snapshots(dated, bucket_mode)


def label_snapshots(df: DataFrame, bucket_mode: str = "floor0") -> DataFrame:
    return (df.withColumn("days_to_payment", F.datediff("invoice_paid", "reference_date"))
            .withColumn("week_bucket", I.week_bucket(F.col("days_to_payment"), bucket_mode)))


def timing_features(df: DataFrame) -> DataFrame:
    """Ages, terms and cyclic months of each invoice at its ``reference_date``."""
    sent, due, paid, at = (F.col(c) for c in ("invoice_sent", "due_in_date", "invoice_paid", "reference_date"))
    return (df.withColumn("invoice_age_days", I.invoice_age_days(sent, paid, at))
            .withColumn("days_until_due", I.days_until_due(due, paid, at))
            .withColumn("pay_terms_days", F.datediff(due, sent))
            .withColumn("invoice_month", F.month(sent))
            .withColumn("due_month", F.month(due))
            .withColumn("days_past_due", F.datediff(at, due))
            .withColumn("invoice_month_sin", F.sin(I.month_angle(F.col("invoice_month"))))
            .withColumn("invoice_month_cos", F.cos(I.month_angle(F.col("invoice_month"))))
            .withColumn("due_month_sin", F.sin(I.month_angle(F.col("due_month"))))
            .withColumn("due_month_cos", F.cos(I.month_angle(F.col("due_month")))))


def attach_history(snapshots: DataFrame, history: DataFrame) -> DataFrame:
    """Left join of the as-of history by customer and date, with the features made from it.

    A history without dates belongs to one date and is joined by customer.
    """
    keys = [c for c in ("cust_number", "reference_date") if c in history.columns]
    joined = snapshots.join(history, keys, "left")
    return (joined
            .withColumn("prev_transaction_count", F.coalesce("prev_transaction_count", F.lit(0).cast("bigint")))
            .withColumn("customer_risk_score",
                        I.customer_risk_score(F.col("late_payment_ratio"), F.col("customer_avg_delay")))
            .withColumn("days_since_last_invoice", F.datediff("reference_date", "last_invoice_date"))
            .drop("last_invoice_date"))


def amount_features(df: DataFrame, edges: Row) -> DataFrame:
    """Log amount and size classes; ``edges`` are the amount quantiles of the population."""
    amount = F.col("total_open_amount")
    low, high = (F.lit(edges[name]).cast("double") for name in ("q1", "q2"))
    return (df.withColumn("invoice_amount", amount)
            .withColumn("invoice_amount_log", I.amount_log(amount))
            .withColumn("open_amount", amount)
            .withColumn("invoice_size_cat", I.size_category_fixed(amount))
            .withColumn("invoice_size_cat_q", I.size_category(amount, low, high)))


def engineer_features(dated: DataFrame, population: DataFrame) -> DataFrame:
    """All features of invoices at their ``reference_date``; history and quantiles come from ``population``."""
    probes = dated.select("cust_number", "reference_date")
    history = asof_customer_history(population, probes)
    edges = amount_quantiles(population).first()
    return dated.transform(timing_features).transform(attach_history, history).transform(amount_features, edges)


def build_snapshots(invoices: DataFrame, **options) -> DataFrame:
    """The training table: weekly snapshots with label and all features."""
    return engineer_features(snapshot_open_invoices(invoices, **options), invoices)


@dataclass(frozen=True)
class Population:
    """What scoring needs to know about the invoice history at one date."""

    as_of: Column
    customers: DataFrame
    edges: Row


def population_as_of(invoices: DataFrame, as_of: Column) -> Population:
    """History of all customers at one date, a single grouped pass, and the amount quantiles."""
    return Population(as_of, customer_stats(invoices, as_of), amount_quantiles(invoices).first())


def features_as_of(invoices: DataFrame, population: Population) -> DataFrame:
    """Features of every invoice at one date, the form used for scoring and for the history table."""
    dated = invoices.withColumn("reference_date", population.as_of)
    return (dated.transform(timing_features).transform(attach_history, population.customers)
            .transform(amount_features, population.edges))
