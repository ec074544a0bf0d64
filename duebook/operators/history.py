"""Payment history of customers, as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duebook.functions.numbers import clip_low, share

COUNTS = ["delay_sum", "delay_n", "late_n", "paid_n", "sent_n", "probe"]


def _delay(clip_early: bool) -> Column:
    days = F.datediff("invoice_paid", "due_in_date")
    return clip_low(days, 0) if clip_early else days


def asof_customer_history(invoices: DataFrame, probes: DataFrame, clip_early: bool = True) -> DataFrame:
    """History of each customer at each probe date.

    Delay and late ratio look at invoices paid on or before the date, counts at invoices sent
    strictly before it. Payments, sendings and probes are first summed per customer and day, which caps a
    customer at one row per calendar day however many invoices it has; running sums over those days then
    answer all probes with one sort.
    """
    late = F.coalesce(F.col("invoice_paid") > F.col("due_in_date"), F.lit(False)).cast("int")
    delay = _delay(clip_early)
    zero = F.lit(0)

    def event(day: Column, **counts: Column) -> Column:
        return F.struct(day.alias("day"), *[counts.get(c, zero).cast("bigint").alias(c) for c in COUNTS])

    paid = event(F.col("invoice_paid"), delay_sum=F.coalesce(delay, zero), delay_n=delay.isNotNull().cast("int"),
                 late_n=late, paid_n=F.lit(1))
    sent = event(F.col("invoice_sent"), sent_n=F.lit(1))
    events = invoices.select("cust_number", F.explode(F.array(paid, sent)).alias("e")).select("cust_number", "e.*")
    asked = probes.select("cust_number", event(F.col("reference_date"), probe=F.lit(1)).alias("e")) \
        .select("cust_number", "e.*")
    daily = (events.unionByName(asked)
             .where(F.col("cust_number").isNotNull() & F.col("day").isNotNull())
             .groupBy("cust_number", "day")
             .agg(*[F.sum(c).alias(c) for c in COUNTS[:-1]], F.max("probe").alias("probe")))

    days = Window.partitionBy("cust_number").orderBy("day")
    until = days.rowsBetween(Window.unboundedPreceding, 0)
    before = days.rowsBetween(Window.unboundedPreceding, -1)
    running = daily.select(
        "cust_number", F.col("day").alias("reference_date"), "probe",
        F.sum("delay_sum").over(until).alias("delay_sum"), F.sum("delay_n").over(until).alias("delay_n"),
        F.sum("late_n").over(until).alias("late_n"), F.sum("paid_n").over(until).alias("paid_n"),
        F.coalesce(F.sum("sent_n").over(before), zero.cast("bigint")).alias("prev_transaction_count"),
        F.max(F.when(F.col("sent_n") > 0, F.col("day"))).over(before).alias("last_invoice_date"))
    return running.where(F.col("probe") == 1).select(
        "cust_number", "reference_date",
        F.try_divide(F.col("delay_sum").cast("double"), F.col("delay_n")).alias("customer_avg_delay"),
        F.try_divide(F.col("late_n").cast("double"), F.col("paid_n")).alias("late_payment_ratio"),
        "prev_transaction_count", "last_invoice_date")


def asof_frames(events: DataFrame, probes: DataFrame, counted: dict[str, tuple[str, int]], key: str = "cust_number", at: str = "reference_date") -> DataFrame:
    """Running counts of dated events at each probe date, one frame for each name in ``counted``: (date column, days before the probe that count last).

    Offset 0 is the frame up to and with the date, 1 the frame strictly before it. Events are summed per key and day first, and the frames are ranges of
    days, so no event is compared with a probe. Probes without events count 0; null dates and keys count nowhere.
    """
    names = list(counted)
    kinds = [F.struct(F.col(column).alias("_day"), *[F.lit(int(n == name)).cast("long").alias(n) for n in names], F.lit(0).alias("_probe"))
             for name, (column, _) in counted.items()]
    happened = events.select(key, F.explode(F.array(*kinds)).alias("e")).select(key, "e.*")
    asked = probes.select(key, F.col(at).alias("_day"), *[F.lit(0).cast("long").alias(n) for n in names], F.lit(1).alias("_probe"))
    # Dealt by a number of parts, which stay as many: parts merged by their compressed bytes would hold far more rows than memory for their sums.
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    daily = (happened.unionByName(asked).where(F.col(key).isNotNull() & F.col("_day").isNotNull())
             .repartition(parts, key).groupBy(key, "_day").agg(*[F.sum(n).alias(n) for n in names], F.max("_probe").alias("_probe")))
    days = Window.partitionBy(key).orderBy(F.unix_date("_day"))
    frames = [F.coalesce(F.sum(n).over(days.rangeBetween(Window.unboundedPreceding, -offset)), F.lit(0).cast("long")).alias(n)
              for n, (_, offset) in counted.items()]
    return daily.select(key, F.col("_day").alias(at), "_probe", *frames).where("_probe = 1").drop("_probe")


def customer_stats(invoices: DataFrame, as_of: Column, clip_early: bool = True,
                   denominator: str = "paid") -> DataFrame:
    """History of every customer at one date, in a single grouped pass.

    ``denominator='sent'`` counts all invoices sent before the date in the late ratio, open ones as not late.
    """
    paid = F.coalesce(F.col("invoice_paid") <= as_of, F.lit(False))
    sent = F.coalesce(F.col("invoice_sent") < as_of, F.lit(False))
    late = F.col("invoice_paid") > F.col("due_in_date")
    if denominator == "paid":
        base, delay_base = paid, paid
    elif denominator == "sent":
        base, delay_base = sent, sent & paid
    else:
        raise ValueError(f"unknown denominator {denominator!r}")
    late_flag = F.when(base, F.coalesce(late, F.lit(False)).cast("double"))
    return (invoices.where(F.col("cust_number").isNotNull()).groupBy("cust_number")
            .agg(F.avg(F.when(delay_base, _delay(clip_early))).alias("customer_avg_delay"),
                 F.avg(late_flag).alias("late_payment_ratio"),
                 F.count_if(sent).alias("prev_transaction_count"),
                 F.max(F.when(sent, F.col("invoice_sent"))).alias("last_invoice_date"))
            .where(F.col("late_payment_ratio").isNotNull() | (F.col("prev_transaction_count") > 0)))


def customer_avg_delay(paid: DataFrame, clip_early: bool = True) -> DataFrame:
    return (paid.where(F.col("cust_number").isNotNull()).groupBy("cust_number")
            .agg(F.avg(_delay(clip_early)).alias("customer_avg_delay")))


def late_payment_ratio(paid: DataFrame) -> DataFrame:
    return (paid.where(F.col("cust_number").isNotNull()).groupBy("cust_number")
            .agg(share(F.col("invoice_paid") > F.col("due_in_date")).alias("late_payment_ratio")))


def prev_transaction_count(sent: DataFrame) -> DataFrame:
    return (sent.where(F.col("cust_number").isNotNull()).groupBy("cust_number")
            .agg(F.count(F.lit(1)).alias("prev_transaction_count")))


def last_invoice_date(sent: DataFrame) -> DataFrame:
    return (sent.where(F.col("cust_number").isNotNull()).groupBy("cust_number")
            .agg(F.max("invoice_sent").alias("last_invoice_date")))


def customer_stats_static(invoices: DataFrame, as_of: Column) -> DataFrame:
    """The one-date variant: late share and counts over all invoices sent, unclipped delays, risk score."""
    stats = customer_stats(invoices, as_of, clip_early=False, denominator="sent")
    delay = F.coalesce("customer_avg_delay", F.lit(0.0))
    return (stats.where(F.col("prev_transaction_count") > 0)
            .select("cust_number", "late_payment_ratio", delay.alias("avg_payment_delay_days"),
                    F.col("prev_transaction_count").alias("num_previous_invoices"),
                    (F.lit(0.7) * F.col("late_payment_ratio") + F.lit(0.3) * delay).alias("customer_risk_score"),
                    "last_invoice_date"))


def union_history(history: DataFrame, batch: DataFrame) -> DataFrame:
    """Append a batch, matching columns by name; columns either side lacks are null."""
    return history.unionByName(batch, allowMissingColumns=True)


def arrived_last(batch: DataFrame, key: str = "doc_id", batch_order: str | None = None, features: DataFrame | None = None) -> DataFrame:
    """The last row of each key of a batch, with ``features`` by key: the one with the largest ``batch_order``, by default the one that arrived last.

    Rows have arrived by the time of their file, its path and their place in it (``with_arrival``). The other columns, in ascending order, decide
    among rows of equal ``batch_order``.
    """
    from duebook.operators.cleaning import keep_one
    from duebook.operators.joins import add_missing_columns
    from duebook.sources.arrival import ARRIVAL, with_arrival

    if batch_order:
        rows = batch.drop(ARRIVAL)
        last = keep_one(rows, key, [-F.col(f"`{batch_order}`"), *[F.col(f"`{c}`") for c in rows.columns if c != key]])
    else:
        payload = F.struct(*[F.col(f"`{c}`") for c in batch.columns if c != ARRIVAL])
        last = with_arrival(batch).groupBy(F.col(f"`{key}`")).agg(F.max_by(payload, ARRIVAL).alias("_row")).select("_row.*")
    return last if features is None else add_missing_columns(last, features, key)


def upsert_history(history: DataFrame, batch: DataFrame, features: DataFrame | None = None,
                   batch_order: str | None = None) -> DataFrame:
    """Append a batch with its features and keep the last row of each ``doc_id``.

    Rows of the batch replace rows of the history; within the batch the row with the largest ``batch_order`` is the last, by default the one that
    arrived last. A history that repeats an id keeps the row that is least in all columns. For a history that is stored, ``sources.ledger`` rewrites only what a batch touches.
    """
    from duebook.operators.cleaning import keep_one

    last = arrived_last(batch, "doc_id", batch_order, features)
    combined = union_history(history.withColumn("_side", F.lit(0)), last.withColumn("_side", F.lit(1)))
    order = [-F.col("_side")] + [F.col(f"`{c}`") for c in combined.columns if c not in ("_side", "doc_id")]
    return keep_one(combined, "doc_id", order).drop("_side")
