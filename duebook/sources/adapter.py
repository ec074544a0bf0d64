"""The order tables of the test data seen as raw invoices.

Ship dates there are unrelated to order dates, so payment dates follow from the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook import schema
from duebook.functions.dates import as_yyyymmdd
from duebook.functions.probability import added
from duebook.operators.cleaning import clean_invoices

AS_OF = "2001-06-01"
TERMS_DAYS = {"1": 10, "2": 15, "3": 30, "4": 45, "5": 60}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def raw_invoices(spark: SparkSession, sf_dir: str, with_name: bool = False) -> DataFrame:
    """Orders as raw invoice rows; customer names are joined only when asked for."""
    orders = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    sent = F.col("o_orderdate").cast("date")
    terms = F.coalesce(*[F.when(F.substring("o_orderpriority", 1, 1) == k, F.lit(v)) for k, v in TERMS_DAYS.items()])
    paid = F.when(F.col("o_orderstatus") != "O", F.date_add(sent, (F.lit(1) + (key * 37) % 97).cast("int")))
    if with_name:
        names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                        F.col("c_name").alias("name_customer"))
        orders = orders.join(names, "o_custkey", "left")
    rows = orders.withColumn("_terms", terms)
    return rows.select(
        F.col("o_orderstatus").alias("business_code"),
        F.lpad(cust.cast("string"), 10, "0").alias("cust_number"),
        (F.col("name_customer") if with_name else F.lit(None).cast("string")).alias("name_customer"),
        paid.cast("string").alias("clear_date"),
        (F.lit(2018) + cust % 4).cast("double").alias("buisness_year"),
        key.alias("doc_id"),
        sent.cast("string").alias("posting_date"),
        sent.cast("string").alias("document_create_date"),
        sent.cast("string").alias("document_create_date.1"),
        as_yyyymmdd(F.date_add(sent, F.col("_terms"))).alias("due_in_date"),
        F.when(cust % 20 == 0, " cad ").when(cust % 10 == 0, "CAD").otherwise("USD").alias("invoice_currency"),
        F.when(F.col("o_orderstatus") == "P", "X2").otherwise("RV").alias("document type"),
        F.lit(1.0).alias("posting_id"),
        F.lit(None).cast("string").alias("area_business"),
        F.col("o_totalprice").alias("total_open_amount"),
        as_yyyymmdd(sent).alias("baseline_create_date"),
        F.concat(F.lit("NA"), F.col("_terms").cast("string")).alias("cust_payment_terms"),
        key.cast("double").alias("invoice_id"),
        F.when(paid.isNull(), 1).otherwise(0).alias("isOpen"),
    )


def invoices(spark: SparkSession, sf_dir: str, only_paid: bool = True, with_name: bool = False) -> DataFrame:
    """The clean invoice table of the test data."""
    carry = ("name_customer",) if with_name else ()
    return clean_invoices(raw_invoices(spark, sf_dir, with_name), only_paid=only_paid, carry=carry)


def pseudo_probabilities(doc_id: Column, salt: int = 0) -> Column:
    """Seven probabilities that depend on the key alone, in place of a model where results must be exact."""
    weights = [(F.lit(1) + (doc_id * (2 * c + 1 + salt)) % 11).cast("double") for c in range(schema.N_CLASSES)]
    row = added(weights)
    return F.array(*[w / row for w in weights])


def scored(df: DataFrame) -> DataFrame:
    return df.withColumn("probabilities", pseudo_probabilities(F.col("doc_id")))
