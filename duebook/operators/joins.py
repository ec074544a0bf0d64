"""Equi joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook.session import materialise


def hot_keys(left: DataFrame, on: list[str], rows_per_task: int) -> DataFrame:
    """Every key with more than ``rows_per_task`` rows as ``_hot0, _hot1, ...`` and the tasks it is spread over, ``_fan``.

    There are at most rows / ``rows_per_task`` of them. Counting combines on the map side, so a hot key costs its own counting nothing.
    """
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_task)
    return counts.select(*[F.col(f"`{c}`").alias(f"_hot{i}") for i, c in enumerate(on)],
                         F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_fan"))


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows_per_task: int = 1_000_000) -> DataFrame:
    """Join a left side to a right side with few rows per key, splitting hot keys of the left side.

    Keys with more than ``rows_per_task`` rows on the left, null keys among them, are counted as part of the query; their rows are spread
    over several salts and the matching right rows repeated per salt. The table of hot keys has one row for every
    ``rows_per_task`` rows at most and is broadcast: 10**12 rows and the default make a million short rows.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"{how!r} would repeat right rows of salted keys")
    hot = F.broadcast(hot_keys(left, on, rows_per_task))

    def fanned(side: DataFrame) -> DataFrame:
        same = reduce(and_, [side[f"`{c}`"].eqNullSafe(F.col(f"_hot{i}")) for i, c in enumerate(on)])
        return side.join(hot, same, "left").drop(*[f"_hot{i}" for i in range(len(on))]).withColumn("_fan", F.coalesce("_fan", F.lit(1)))
    # The partition id separates copies of one row; it stays the same when a task is repeated.
    row = [F.col(f"`{f.name}`") for f in left.schema.fields if _hashable(f.dataType)]
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *row), F.col("_fan")).cast("int")
    salted_left = fanned(left).withColumn("_salt", salt).drop("_fan")
    salted_right = fanned(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_fan") - 1))).drop("_fan")
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


# The joins below have keys that few rows share, or a small right side. They are plain equi joins: Spark broadcasts what is small and adaptive
# execution splits what is skewed, without a pass that counts keys first.


def attach_customer_name(queue: DataFrame, names: DataFrame) -> DataFrame:
    """Left join of the customer's name by ``doc_id``; one name per invoice, so no row multiplies.

    The queue is a report of a few rows. It is written first, as it both picks the names and takes them.
    """
    queue = materialise(queue, "queue")
    wanted = names.join(queue.select("doc_id"), "doc_id", "left_semi")
    one_name = wanted.groupBy("doc_id").agg(F.min("name_customer").alias("name_customer"))
    return queue.join(one_name, "doc_id", "left")


def attach_probabilities(invoices: DataFrame, scored: DataFrame) -> DataFrame:
    """Invoices that have probabilities, matched by ``doc_id``."""
    return invoices.join(scored, "doc_id", "inner")


def add_missing_columns(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Bring in the columns only the right side has; its rows are reduced to one per key first."""
    extra = [c for c in right.columns if c not in left.columns]
    if not extra:
        return left
    first = right.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in extra])).alias("_extra"))
    kept = [F.col(f"`{c}`") for c in left.columns]
    added = [F.col("_extra").getField(c).alias(c) for c in extra]
    return left.join(first, key, "left").select(*kept, *added)


def fx_lookup_join(invoices: DataFrame, rates: DataFrame) -> DataFrame:
    """Rate of the business year next to each invoice; CAD amounts in USD, null where no rate is known."""
    per_year = rates.groupBy("business_year").agg(F.max("cad_usd_rate").alias("cad_usd_rate"))
    is_cad = F.col("invoice_currency") == "CAD"
    amount_usd = F.when(is_cad, F.col("invoice_amount") * F.col("cad_usd_rate")).otherwise(F.col("invoice_amount"))
    return (invoices.join(per_year, "business_year", "left")
            .withColumn("amount_usd", amount_usd)
            .withColumn("amount_usd_log", F.log1p(F.when(F.col("amount_usd").isNotNull(),
                                                         F.greatest(F.col("amount_usd"), F.lit(0.0))))))


def segment_lookup(invoices: DataFrame, segments: DataFrame, default: str = "Other") -> DataFrame:
    """Business segment of each customer, ``default`` where the lookup has none."""
    one = segments.groupBy("cust_number").agg(F.min("business_segment").alias("business_segment"))
    return (invoices.join(one, "cust_number", "left")
            .withColumn("business_segment", F.coalesce("business_segment", F.lit(default))))


def enrich_request(requests: DataFrame, history: DataFrame, fields: list[str]) -> DataFrame:
    """Fill the fields a request lacks from the invoice history, matched by ``doc_id``."""
    wanted = [c for c in fields if c != "doc_id" and c in history.columns]
    known = (history.groupBy("doc_id")
             .agg(F.min(F.struct(*wanted)).alias("_known")))
    joined = requests.join(known, "doc_id", "inner")
    filled = []
    for c in wanted:
        stored = F.col("_known").getField(c)
        filled.append((F.coalesce(F.col(c), stored) if c in requests.columns else stored).alias(c))
    rest = [c for c in requests.columns if c not in wanted]
    return joined.select(*rest, *filled)


def unknown_requests(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Requests whose invoice the history does not have."""
    return requests.join(history.select("doc_id"), "doc_id", "left_anti")
