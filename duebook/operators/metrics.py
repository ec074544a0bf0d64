"""Classification metrics from class probabilities, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duebook import schema
from duebook.functions import probability as P

EPS = 2.220446049250313e-16
CLASSES = list(range(schema.N_CLASSES))


def log_loss_term(p: Column, label: Column) -> Column:
    """-ln of the true class's probability, clipped away from 0 and 1."""
    return -F.log(F.least(F.greatest(p[label], F.lit(EPS)), F.lit(1.0 - EPS)))


def metric_terms(label: str = "week_bucket", probabilities: str = "probabilities") -> dict[str, Column]:
    """Per row: log loss, whether the class is right, whether it is among the top two. Their means are the metrics."""
    p, y = F.col(probabilities), F.col(label)
    return {"log_loss": log_loss_term(p, y), "top_1_accuracy": (P.predicted_class(p) == y).cast("double"),
            "top_2_accuracy": P.in_top_k(p, y, 2).cast("double")}


def model_metrics(scored: DataFrame, by: list[str] | None = None, label: str = "week_bucket",
                  probabilities: str = "probabilities") -> DataFrame:
    """Log loss, accuracy and top-2 accuracy in one pass."""
    return scored.groupBy(*(by or [])).agg(
        *[F.avg(c).alias(name) for name, c in metric_terms(label, probabilities).items()])


def log_loss(scored: DataFrame, **options) -> DataFrame:
    return model_metrics(scored, **options).select("log_loss")


def confusion_counts(scored: DataFrame, by: list[str] | None = None, label: str = "week_bucket") -> DataFrame:
    """Rows per true and predicted class; at most 49 rows per group."""
    return (scored.withColumn("predicted", P.predicted_class(F.col("probabilities")))
            .groupBy(*(by or []), F.col(label).alias("actual"), "predicted").agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(scored: DataFrame, label: str = "week_bucket") -> DataFrame:
    """True classes as rows, predicted classes as columns, all classes present."""
    pairs = scored.select(F.col(label).alias("actual"), P.predicted_class(F.col("probabilities")).alias("predicted"))
    counts = pairs.agg(*[F.count_if((F.col("actual") == a) & (F.col("predicted") == c)).alias(f"n{a}{c}") for a in CLASSES for c in CLASSES])
    rows = F.array(*[F.struct(F.lit(a).alias("actual"), *[F.col(f"n{a}{c}").alias(f"pred_{c}") for c in CLASSES]) for a in CLASSES])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def classification_report(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of each class, computed from the confusion counts."""
    by = by or []
    sides = F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.lit(1).alias("true_side"), F.lit(0).alias("pred_side")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).alias("true_side"), F.lit(1).alias("pred_side"))))
    long = counts.select(*by, "actual", "predicted", "n", sides.alias("s")).select(*by, "actual", "predicted", "n", "s.*")
    hit = F.when((F.col("actual") == F.col("predicted")) & (F.col("true_side") == 1), F.col("n")).otherwise(0)
    sums = long.groupBy(*by, "class").agg(
        F.sum(hit).alias("tp"), F.sum(F.col("n") * F.col("true_side")).alias("support"),
        F.sum(F.col("n") * F.col("pred_side")).alias("predicted"))
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return (sums.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", f1)
            .select(*by, "class", "precision", "recall", "f1", "support"))


def report_means(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro and support-weighted means of the per-class report; at most seven rows per group."""
    columns = ["precision", "recall", "f1"]
    macro = [F.avg(c).alias(f"macro_{c}") for c in columns]
    weighted = [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in columns]
    return report.groupBy(*(by or [])).agg(*macro, *weighted)


def macro_f1(scored: DataFrame, by: list[str] | None = None, label: str = "week_bucket") -> DataFrame:
    """Mean F1 over the classes that occur or are predicted, as ``f1_macro``."""
    return classification_report(confusion_counts(scored, by, label), by).groupBy(*(by or [])).agg(F.avg("f1").alias("f1_macro"))


def calibration_bins(scored: DataFrame, bins: int = 10, label: str = "week_bucket") -> DataFrame:
    """Mean predicted probability and observed rate per class and bin (left-closed bins).

    Empty bins and classes with a single outcome are left out.
    """
    long = scored.select(F.col(label).alias("_y"), F.posexplode("probabilities").alias("class", "p"))
    hit = (F.col("_y") == F.col("class")).cast("double")
    binned = (long.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
              .groupBy("class", "bin")
              .agg(F.sum("p").alias("p_sum"), F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n")))
    of_class = Window.partitionBy("class")
    return (binned.withColumn("_hits", F.sum("hits").over(of_class)).withColumn("_n", F.sum("n").over(of_class))
            .where((F.col("_hits") > 0) & (F.col("_hits") < F.col("_n")))
            .select("class", "bin", (F.col("p_sum") / F.col("n")).alias("mean_predicted"),
                    (F.col("hits") / F.col("n")).alias("observed_rate"), "n"))


def backtest_aggregate(folds: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation over the folds, nulls skipped, and the number of folds."""
    return folds.agg(F.count(F.lit(1)).alias("n_folds"),
                     *[F.avg(c).alias(f"avg_{c}") for c in columns],
                     *[F.stddev_pop(c).alias(f"std_{c}") for c in columns])


def rank_results(results: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Place of each model or grid row, best first; a result table has one row per fit."""
    return results.withColumn(name, F.rank().over(Window.orderBy(*[F.asc_nulls_last(c) for c in order])))


def week_bucket_distribution(df: DataFrame, label: str = "week_bucket") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).orderBy(label)


def union_results(*tables: DataFrame) -> DataFrame:
    """Result rows of several runs in one table, columns matched by name."""
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t, allowMissingColumns=True)
    return merged


def data_summary(train: DataFrame, test: DataFrame, features: list[str], label: str = "week_bucket") -> DataFrame:
    """Rows, features and class distribution of both parts as one JSON record."""
    def part(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label).cast("string"), "n")))).alias("classes")
        ).select(F.struct("rows", "classes").alias(name))
    record = F.struct(part(train, "train").scalar().alias("train"), part(test, "test").scalar().alias("test"),
                      F.array(*[F.lit(f) for f in features]).alias("feature_names"),
                      F.lit(len(features)).alias("n_features"))
    return train.sparkSession.range(1).select(F.to_json(record).alias("summary"))
