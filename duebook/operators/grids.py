"""Grids over weights and tilts: models are fitted once, every grid row reuses their probabilities.

What does not depend on the grid, the cash that was paid, is summed once per date. What does is one aggregate of plain sums over the rows times the grid, from
which cash, losses and reports of every grid row follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook import schema
from duebook.functions import probability as P
from duebook.functions.numbers import round_even
from duebook.operators.forecast import WEEKS, expected_in_week, mean_of_dates, metrics_of_sums, paid_in_week
from duebook.operators.metrics import classification_report, metric_terms, rank_results
from duebook.session import materialise

#: What a grid reads of a row, beside its probabilities.
ROW = ["reference_date", "total_open_amount", "week_bucket"]


def expand_grid(df: DataFrame, name: str, rows: dict[str, list[float]], column: str) -> DataFrame:
    """Every row once per grid row; the grid is a fixed short list, so this is a projection, not a join."""
    grid = F.array(*[F.struct(F.lit(k).alias(name), F.array(*[F.lit(float(x)) for x in v]).alias(column))
                     for k, v in rows.items()])
    return df.withColumn("_g", F.explode(grid)).select(*[F.col(f"`{c}`") for c in df.columns], "_g.*")


def _cash_columns(holdout: DataFrame, kept: list) -> DataFrame:
    return holdout.select(*kept, round_even(F.col("forecast_mae_weekly"), 2).alias("forecast_mae_weekly"),
                          round_even(F.col("forecast_mape_weekly"), 4).alias("forecast_mape_weekly"),
                          round_even(F.col("forecast_total_cf_difference"), 2).alias("forecast_total_cf_difference"))


def _cash(sums: DataFrame, rows: DataFrame, name: str, others: list[Column] | None = None, rolled: list[Column] | None = None) -> DataFrame:
    """Means of the cash metrics over the dates for every grid row; ``sums`` has ``forecast_1..6`` by date, ``rows`` are those before the grid."""
    of_date = sums.groupBy(name, "reference_date").agg(
        *[round_even(F.sum(f"forecast_{w}"), 2).alias(f"forecast_{w}") for w in WEEKS], *(others or []))
    paid = rows.groupBy("reference_date").agg(*paid_in_week())
    return mean_of_dates(metrics_of_sums(of_date.join(paid, "reference_date"), [name, "reference_date"]), [name], rolled)


def weight_grid(members: DataFrame, columns: list[str],
                grid: list[tuple[int, ...]] = schema.WEIGHT_GRID) -> DataFrame:
    """Model metrics, macro F1 and cash metrics of every weight triple, placed by cash error; ``columns`` hold the members."""
    rows = {"-".join(str(x) for x in w): list(w) for w in grid}
    weights: list[Column] = [F.col("_w").getItem(i) for i in range(len(columns))]
    voted = (expand_grid(members.select(*ROW, *columns), "weights", rows, "_w")
             .withColumn("probabilities", P.soft_vote([F.col(c) for c in columns], weights)).drop("_w", *columns))
    p = voted.withColumn("_p", P.sharpen(F.col("probabilities"))).withColumn("predicted", P.predicted_class(F.col("probabilities")))
    terms = {n: t for n, t in metric_terms().items() if n != "top_1_accuracy"}
    sums = p.groupBy("weights", "reference_date", "week_bucket", "predicted").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"forecast_{w}") for w, x in zip(WEEKS, expected_in_week(F.col("_p")))],
        *[F.sum(t).alias(f"_{n}") for n, t in terms.items()])
    sums = materialise(sums, "grid")  # some 49 rows per date and grid row; two aggregates read different columns of it
    known = F.when(F.col("week_bucket").isNotNull(), F.col("n"))
    kept = [F.sum(known).alias("_n"), F.sum(F.when(F.col("predicted") == F.col("week_bucket"), F.col("n")).otherwise(0)).alias("_top_1_accuracy"),
            *[F.sum(f"_{n}").alias(f"_{n}") for n in terms]]
    means = [(F.sum(f"_{n}") / F.sum("_n")).alias(n) for n in metric_terms()]
    cash = _cash(sums, members, "weights", kept, means)
    confusion = sums.where("week_bucket IS NOT NULL").groupBy("weights", F.col("week_bucket").alias("actual"), "predicted").agg(F.sum("n").alias("n"))
    f1 = classification_report(confusion, ["weights"]).groupBy("weights").agg(F.avg("f1").alias("f1_macro"))
    rounded = [round_even(F.col(c), 6).alias(c) for c in [*metric_terms(), "f1_macro"]]
    return rank_results(_cash_columns(cash.join(f1, "weights", "left"), ["weights", *rounded]), ["forecast_mae_weekly", "forecast_mape_weekly"])


def bias_grid(scored: DataFrame, grid: dict[str, list[float]] = schema.BIAS_GRID) -> DataFrame:
    """Cash metrics of every tilt of the class probabilities, placed by cash error."""
    tilted = (expand_grid(scored.select("reference_date", "total_open_amount", "probabilities"), "bias_name", grid, "_w")
              .withColumn("_p", P.tilt(F.col("probabilities"), F.col("_w"))))
    sums = tilted.groupBy("bias_name", "reference_date").agg(
        *[F.sum(x).alias(f"forecast_{w}") for w, x in zip(WEEKS, expected_in_week(F.col("_p")))])
    return rank_results(_cash_columns(_cash(sums, scored, "bias_name"), ["bias_name"]), ["forecast_mae_weekly", "forecast_mape_weekly"])
