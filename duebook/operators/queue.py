"""The collections queue: risk, priority, top invoices, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duebook import schema
from duebook.functions import probability as P
from duebook.functions import risk as R

TOP = 10


def risk_table(scored: DataFrame, as_of: Column) -> DataFrame:
    """Risk score and category, overdue days, multiplier and priority of each scored invoice."""
    p = F.col("probabilities")
    return (scored
            .withColumn("days_until_due", F.datediff("due_in_date", as_of))
            .withColumn("risk_score", P.risk_score(p))
            .withColumn("paid_soon_score", P.paid_soon_score(p))
            .withColumn("risk_category", R.risk_category(F.col("risk_score")))
            .withColumn("is_overdue", R.is_overdue(F.col("days_until_due")))
            .withColumn("days_overdue", R.days_overdue(F.col("days_until_due")))
            .withColumn("overdue_multiplier", R.overdue_multiplier(F.col("days_overdue")))
            .withColumn("priority_score", R.priority_score(
                F.col("total_open_amount"), F.col("risk_score"), F.col("overdue_multiplier")))
            .withColumn("predicted_bucket", P.predicted_class(p) + 1)
            .withColumn("class_probability", P.class_probability(p)))


def top_ranked(df: DataFrame, order: list[Column], rank: str, n: int = TOP) -> DataFrame:
    """The first ``n`` rows with their rank.

    Every task keeps its own best ``n``, then those are merged, so no full sort takes place; the rank
    itself is a window over those ``n`` rows.
    """
    best = df.orderBy(*order).limit(n)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def collections_rank(risk: DataFrame, n: int = TOP) -> DataFrame:
    """The invoices to collect first; equal priorities are ordered by ``doc_id``."""
    return top_ranked(risk, [F.desc_nulls_last("priority_score"), F.asc("doc_id")], "collections_rank", n)


def top_n_priority(risk: DataFrame, n: int = TOP, carry: tuple[str, ...] = ()) -> DataFrame:
    columns = ["collections_rank", "doc_id", "cust_number", "total_open_amount", "days_overdue", "risk_category", *carry]
    return collections_rank(risk, n).select(*columns)


def rank_by_bucket(predictions: DataFrame, n: int = TOP) -> DataFrame:
    """The queue when only the predicted week is known: latest week first, then the larger amount."""
    order = [F.desc_nulls_last("predicted_bucket"), F.desc_nulls_last("total_open_amount"), F.asc("doc_id")]
    return top_ranked(predictions, order, "rank", n)


def _segment(df: DataFrame) -> Column:
    if "cust_number" not in df.columns:
        return F.lit("Other")
    return F.coalesce(F.try_element_at(R.literal_map(schema.BUSINESS_SEGMENTS), F.col("cust_number")), F.lit("Other"))


def normalise_queue(df: DataFrame, n: int = TOP) -> DataFrame:
    """One column set for both kinds of queue, ranked or known by predicted week only.

    Columns beyond the common ones are carried along.
    """
    def have(name: str, default: Column) -> Column:
        return F.col(name) if name in df.columns else default

    if "risk_category" in df.columns:
        best = top_ranked(df, [F.asc("collections_rank"), F.asc("doc_id")], "_pos", n)
        common = {
            "rank": F.col("collections_rank").cast("int"),
            "customer_label": R.format_id(F.col("cust_number")),
            "days_overdue": F.col("days_overdue").cast("int"),
            "due_date": F.lit(""),
            "risk_label": F.col("risk_category"),
            "risk_score": R.label_score(F.col("risk_category")),
            "late_ratio": F.lit(0.0),
        }
    else:
        best = rank_by_bucket(df, n).withColumn("_pos", F.col("rank"))
        common = {
            "rank": F.col("_pos"),
            "customer_label": have("name_customer", have("cust_number", F.lit(""))).cast("string"),
            "days_overdue": have("days_past_due", F.lit(0)).cast("int"),
            "due_date": R.format_date(have("due_in_date", F.lit(""))),
            "risk_label": R.bucket_label(F.col("predicted_bucket")),
            "risk_score": F.col("predicted_bucket").cast("int"),
            "late_ratio": have("cust_late_ratio", F.lit(0.0)).cast("double"),
        }
    common |= {
        "doc_id": R.format_id(F.col("doc_id")),
        "total_open_amount": F.col("total_open_amount").cast("double"),
        "business_segment": _segment(df),
    }
    carried = [F.col(f"`{c}`") for c in df.columns if c not in common]
    return best.select(*[c.alias(name) for name, c in common.items()], *carried)


def queue_kpis(queue: DataFrame, predictions: DataFrame) -> DataFrame:
    """Counts of critical and high labels in the queue, row count and amount of all predictions."""
    labels = queue.agg(F.struct(F.count_if(F.col("risk_label").isin("Critical", "Very High")).alias("critical"),
                                F.count_if(F.col("risk_label") == "High").alias("high")).alias("s")).scalar()
    totals = predictions.agg(F.count(F.lit(1)).alias("total_invoices"),
                             F.sum(F.col("total_open_amount").cast("decimal(28,6)")).cast("double").alias("at_risk_value"))
    return totals.select("total_invoices", labels.getField("critical").alias("critical_or_very_high"),
                         labels.getField("high").alias("high"), "at_risk_value")


def expectations(risk: DataFrame) -> DataFrame:
    """Number of rows that break each rule of the risk table, in one pass."""
    p = F.col("probabilities")
    score = F.col("risk_score")
    rules = {
        "risk_out_of_range": ~score.between(0, 1 + 1e-9),
        "risk_formula": F.abs(score - P.risk_score(p)) >= 1e-7,
        "negative_priority": F.col("priority_score") < 0,
        "probabilities_invalid": ~P.valid(p),
    }
    return risk.agg(F.count(F.lit(1)).alias("rows"),
                    *[F.count_if(F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])


def enforce(violations: DataFrame) -> DataFrame:
    """Let the job fail when a rule is broken: the result is computed only for clean data."""
    rules = [c for c in violations.columns if c != "rows"]
    broken = F.array_compact(F.array(*[
        F.when(F.col(c) > 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in rules]))
    guarded = F.when(F.size(broken) == 0, F.col("rows")).otherwise(
        F.raise_error(F.concat(F.lit("expectations failed: "), F.array_join(broken, ", "))).cast("bigint"))
    return violations.withColumn("rows", guarded)


def quarantine(risk: DataFrame) -> DataFrame:
    """The rows that break a rule."""
    p, score = F.col("probabilities"), F.col("risk_score")
    good = score.between(0, 1 + 1e-9) & (F.col("priority_score") >= 0) & P.valid(p)
    return risk.where(~F.coalesce(good, F.lit(False)))


def validate_probabilities(scored: DataFrame) -> DataFrame:
    """Row count and the rows with a wrong class count, an entry outside [0, 1] or a sum other than 1."""
    p = F.col("probabilities")
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(F.size(p) != schema.N_CLASSES, F.lit(True))).alias("wrong_class_count"),
        F.count_if(F.coalesce(~F.forall(p, lambda x: (x >= 0) & (x <= 1)), F.lit(True))).alias("out_of_range"),
        F.count_if(F.coalesce(F.abs(P.total(p) - 1) > 1e-6, F.lit(True))).alias("wrong_sum"))


def required_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Names of required columns the table lacks, in the required order."""
    present = {c.strip() for c in df.columns}
    return [c for c in required if c not in present]


def required_fields(requests: DataFrame, required: list[str]) -> DataFrame:
    """Per request, the required fields that are missing or null."""
    checks = [F.when(F.col(c).isNull(), F.lit(c)) if c in requests.columns else F.lit(c) for c in required]
    return requests.withColumn("missing_fields", F.array_compact(F.array(*checks)))


def unseen_classes(test: DataFrame, train: DataFrame, label: str = "week_bucket") -> DataFrame:
    """Labels that occur in the test part but not in the training part."""
    return test.select(label).distinct().exceptAll(train.select(label).distinct())


def prediction_records(scored: DataFrame) -> DataFrame:
    """Per invoice the predicted class and a map from week to probability with four decimals."""
    labels = F.array(*[F.lit(f"week_{c}") for c in range(schema.N_CLASSES)])
    rounded = F.transform("probabilities", lambda x: F.rint(x * 10000.0) / 10000.0)
    return scored.select("doc_id", P.predicted_class(F.col("probabilities")).alias("predicted_bucket"),
                         F.map_from_arrays(labels, rounded).alias("bucket_probabilities"))
