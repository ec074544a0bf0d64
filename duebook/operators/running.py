"""Payment history of customers as state that arrivals move on, week by week, instead of being counted anew from all invoices.

The state holds the sums of what counts at its date, one row per customer, and what is known but counts later, one row per customer and day. Moving on adds
the arrivals' sums and folds what has come due; it reads the arrivals and the state and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.functions.numbers import clip_low
from duebook.sources.readers import table_exists

SUMS = ["delay_sum", "delay_n", "late_n", "paid_n", "sent_n"]
STATE = "cust_number string, day date, " + ", ".join(f"{c} long" for c in SUMS) + ", last_sent date"


def payment_events(invoices: DataFrame, clip_early: bool = True, after: Column | None = None, upto: Column | None = None) -> DataFrame:
    """Payments and sendings as rows of the state; ``day`` is the first date at which an event counts.

    A payment counts from its date on, a sending from the day after. With ``after`` and ``upto`` only events that begin to count after the one and up to the
    other; the dates' conditions reach the scan.
    """
    paid, sent = F.col("invoice_paid"), F.date_add("invoice_sent", 1)
    days = F.datediff("invoice_paid", "due_in_date")
    delay = clip_low(days, 0) if clip_early else days
    late = F.coalesce(paid > F.col("due_in_date"), F.lit(False)).cast("long")
    if after is not None:
        low = F.date_sub(after, 1)
        invoices = invoices.where((paid > after) | (F.col("invoice_sent") > low)).where(
            ((paid > after) & (paid <= upto)) | ((F.col("invoice_sent") > low) & (F.col("invoice_sent") < upto)))

    def event(day: Column, last: Column, **sums: Column) -> Column:
        return F.struct(day.alias("day"), *[sums.get(c, F.lit(0)).cast("long").alias(c) for c in SUMS], last.cast("date").alias("last_sent"))
    both = F.array(event(paid, F.lit(None), delay_sum=F.coalesce(delay, F.lit(0)), delay_n=delay.isNotNull().cast("int"), late_n=late, paid_n=F.lit(1)),
                   event(sent, F.col("invoice_sent"), sent_n=F.lit(1)))
    rows = invoices.where(F.col("cust_number").isNotNull()).select("cust_number", F.explode(both).alias("e")).select("cust_number", "e.*")
    rows = rows.where(F.col("day").isNotNull())
    return rows if after is None else rows.where((F.col("day") > after) & (F.col("day") <= upto))


def move_on(state: DataFrame | None, events: DataFrame, as_of: Column) -> DataFrame:
    """The state at ``as_of`` from an earlier one and the events that have arrived since, in any order, late ones too.

    One aggregate, which combines in the tasks, so a customer with most events sends one row per task and day.
    """
    rows = events.select("cust_number", "day", *SUMS, "last_sent")
    if state is not None:
        rows = rows.unionByName(state.select(*rows.columns))
    counts = F.when(F.col("day") > as_of, F.col("day"))  # null for what counts already
    return rows.groupBy("cust_number", counts.alias("day")).agg(*[F.sum(c).alias(c) for c in SUMS], F.max("last_sent").alias("last_sent"))


def history_of(state: DataFrame) -> DataFrame:
    """The history columns of every customer at the state's date, as ``customer_stats`` counts them from all invoices."""
    return state.where("day IS NULL").select(
        "cust_number", F.try_divide(F.col("delay_sum").cast("double"), F.col("delay_n")).alias("customer_avg_delay"),
        F.try_divide(F.col("late_n").cast("double"), F.col("paid_n")).alias("late_payment_ratio"),
        F.col("sent_n").alias("prev_transaction_count"), F.col("last_sent").alias("last_invoice_date"))


class RunningHistory:
    """States under ``root``, one folder for each date; a date is written once, so moving on to it again changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def dates(self) -> list[str]:
        """The dates that have a whole state."""
        if not table_exists(self.spark, self.root):
            return []
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
        return sorted(n.removeprefix("as_of=") for n in names if table_exists(self.spark, f"{self.root}/{n}/_SUCCESS"))

    def state(self, as_of: str | None = None) -> DataFrame | None:
        """The state of a date, by default the last one."""
        known = self.dates()
        if not known:
            return None
        return self.spark.read.schema(STATE).parquet(f"{self.root}/as_of={as_of or known[-1]}")

    def move_on(self, as_of: str, events: DataFrame) -> DataFrame:
        """Write the state of a later date; ``events`` are those that have arrived since the last one."""
        known = self.dates()
        if known and as_of < known[-1]:
            raise ValueError(f"the state is at {known[-1]} already")
        if as_of not in known:
            move_on(self.state(), events, F.lit(as_of).cast("date")).write.mode("overwrite").parquet(f"{self.root}/as_of={as_of}")
        return self.state(as_of)

    def history(self, as_of: str | None = None) -> DataFrame:
        return history_of(self.state(as_of))
