"""From raw invoice tables to the clean invoice table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook import schema
from duebook.functions import invoice as I
from duebook.functions.dates import parse_timestamp, parse_yyyymmdd


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Remove full-row duplicates, nulls counting as equal."""
    return df.dropDuplicates()


def drop_invalid_ids(df: DataFrame) -> DataFrame:
    """Keep rows whose invoice id is a number; the text NaN is none."""
    number = F.col("invoice_id").try_cast("double")
    return df.where(number.isNotNull() & ~F.isnan(number))


def parse_dates(df: DataFrame) -> DataFrame:
    return (df.withColumn("due_in_date", parse_yyyymmdd(F.col("due_in_date")))
            .withColumn("baseline_create_date", parse_yyyymmdd(F.col("baseline_create_date")))
            .withColumn("clear_date", parse_timestamp(F.col("clear_date")).cast("date")))


def select_rename(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The ten columns of the clean table under their new names, plus any carried along."""
    columns = [F.col(f"`{old}`").alias(new) for old, new in schema.CLEAN_COLUMNS.items()]
    return df.select(*columns, *[F.col(f"`{c}`") for c in carry])


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop the named columns, ignoring those that are absent."""
    return df.drop(*columns)


def paid_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("invoice_paid").isNotNull())


def open_at(df: DataFrame, at: Column) -> DataFrame:
    return df.where(I.is_open(F.col("invoice_paid"), at))


def paid_by(df: DataFrame, at: Column) -> DataFrame:
    return df.where(F.col("invoice_paid") <= at)


def sent_before(df: DataFrame, at: Column) -> DataFrame:
    return df.where(F.col("invoice_sent") < at)


def valid_date_order(df: DataFrame, due: str = "due_in_date", created: str = "document_create_date") -> DataFrame:
    """Drop rows due before they were created; a missing date keeps the row."""
    return df.where(~F.coalesce(F.col(due) < F.col(created), F.lit(False)))


def drop_missing_target(df: DataFrame) -> DataFrame:
    return df.where(F.col("week_bucket").isNotNull())


def drop_unscored(df: DataFrame, column: str = "probabilities") -> DataFrame:
    return df.where(F.col(column).isNotNull() & F.col(column).getItem(4).isNotNull())


def in_horizon(df: DataFrame, column: str = "week_bucket") -> DataFrame:
    return df.where(F.col(column).between(min(schema.FORECAST_WEEKS), max(schema.FORECAST_WEEKS)))


def clean_invoices(raw: DataFrame, only_paid: bool = True, amount_source: str = "usd",
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """Raw invoices to the clean table: dedupe, valid ids, parsed dates, renamed columns, USD amounts.

    ``only_paid`` is the training form; scoring keeps open invoices. ``amount_source='raw'`` leaves amounts
    in their own currency.
    """
    df = dedupe_rows(strip_column_names(raw)).transform(drop_invalid_ids).transform(parse_dates)
    df = select_rename(df, carry)
    df = (df.withColumn("doc_id", F.col("doc_id").cast("bigint"))
          .withColumn("cust_number", F.col("cust_number").cast("string"))
          .withColumn("business_year", F.rint(F.col("business_year").cast("double")).cast("bigint"))
          .withColumn("total_open_amount", F.col("total_open_amount").cast("double")))
    if amount_source == "usd":
        df = df.withColumn("total_open_amount", I.to_usd(
            F.col("total_open_amount"), F.col("invoice_currency"), F.col("business_year")))
    elif amount_source != "raw":
        raise ValueError(f"unknown amount source {amount_source!r}")
    return paid_only(df) if only_paid else df


def keep_one(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The row that comes first in ``order`` for each key.

    Written as an aggregate, so repeated keys shrink before the shuffle. ``order`` holds ascending
    expressions; for the last row negate them.
    """
    names = [f"_o{i}" for i in range(len(order))]
    ranked = F.struct(*[o.alias(n) for o, n in zip(order, names)])
    payload = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(F.col(f"`{key}`")).agg(F.min_by(payload, ranked).alias("_row"))
    return best.select("_row.*")


def keep_first(df: DataFrame, key: str, seq: str) -> DataFrame:
    return keep_one(df, key, [F.col(seq)])


def keep_last(df: DataFrame, key: str, seq: str) -> DataFrame:
    return keep_one(df, key, [-F.col(seq)])


def impute_history(df: DataFrame) -> DataFrame:
    """Customers without history: no delay, never late, no previous invoice (-1)."""
    return df.na.fill({"customer_avg_delay": 0.0, "late_payment_ratio": 0.0, "days_since_last_invoice": -1})


def feature_projection(df: DataFrame) -> DataFrame:
    """Everything but ids, dates and columns that leak the label."""
    return df.select(*[c for c in df.columns if c not in schema.NON_FEATURES])


def upload_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("invoices"),
                  F.sum(F.col("total_open_amount").cast("decimal(28,6)")).cast("double").alias("outstanding"))


def currency_control_totals(raw: DataFrame) -> DataFrame:
    """Totals before and after currency conversion, for all invoices and for CAD alone."""
    amount = F.col("total_open_amount")
    usd = I.to_usd(amount, F.col("invoice_currency"), F.col("buisness_year").cast("int"))
    cad = F.upper(F.trim(F.col("invoice_currency"))) == "CAD"
    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value.cast("decimal(28,6)")), F.lit(0)).cast("double")
    return raw.agg(total(amount).alias("total_before"), total(usd).alias("total_after"),
                   total(F.when(cad, amount)).alias("cad_before"), total(F.when(cad, usd)).alias("cad_after"))
