"""Weekly cash: expected, actual, their comparison and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duebook import schema
from duebook.functions import probability as P
from duebook.functions.numbers import MONEY, money_mean, money_sum, round_even

WEEKS = schema.FORECAST_WEEKS


def weeks_long(sums: DataFrame, keys: list[str], columns: dict[str, list[str]]) -> DataFrame:
    """One row per week out of one wide row per key; ``columns`` maps a name to its six week columns."""
    rows = F.array(*[
        F.struct(F.lit(w).alias("week_bucket"), *[F.col(cols[i]).alias(name) for name, cols in columns.items()])
        for i, w in enumerate(WEEKS)
    ])
    return sums.select(*keys, F.explode(rows).alias("_w")).select(*keys, "_w.*")


def expected_cash(scored: DataFrame) -> DataFrame:
    """Cash per invoice and week, ``expected_cash_1..6``, from sharpened probabilities."""
    cash = P.expected_cash(F.col("total_open_amount"), P.sharpen(F.col("probabilities")))
    return (scored.withColumn("_cash", cash)
            .select(*[F.col(f"`{c}`") for c in scored.columns],
                    *[F.col("_cash").getItem(i).alias(f"expected_cash_{w}") for i, w in enumerate(WEEKS)]))


def weekly_forecast_cash(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Expected cash per week: rounded per invoice, summed, rounded. One wide aggregate, no row per week."""
    keys = keys or []
    cash = expected_cash(scored)
    names = [f"expected_cash_{w}" for w in WEEKS]
    sums = cash.groupBy(*keys).agg(*[
        round_even(F.coalesce(money_sum(F.col(n)), F.lit(0.0)), 2).alias(n) for n in names])
    return weeks_long(sums, keys, {"forecast_cash": names})


def payment_week(paid: Column, at: Column) -> Column:
    """Week 1..7 of a payment seen from a date; earlier payments count as week 1, invoices not yet paid have none."""
    week = F.floor(F.datediff(paid, at) / 7)
    return F.when(week.isNotNull(), F.least(F.greatest(week, F.lit(0)), F.lit(6)) + 1)


def _sum_in_week(week: Column, amount: Column) -> list[Column]:
    return [F.coalesce(money_sum(F.when(week == w, amount)), F.lit(0.0)).alias(f"actual_{w}") for w in WEEKS]


def weekly_actual_cash(invoices: DataFrame, keys: list[str] | None = None, at: Column | None = None) -> DataFrame:
    """Cash paid in each of the weeks 1..6 after the reference date; weeks without payments are 0."""
    keys = ["reference_date"] if keys is None else keys
    at = F.col("reference_date") if at is None else at
    week = payment_week(F.col("invoice_paid"), at)
    sums = invoices.groupBy(*keys).agg(*_sum_in_week(week, F.col("total_open_amount")))
    return weeks_long(sums, keys, {"actual_cash": [f"actual_{w}" for w in WEEKS]})


def complete_weeks(weekly: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All weeks 1..6 for every key; weeks that are missing get 0."""
    calendar = (weekly.select(*keys).distinct()
                .withColumn("week_bucket", F.explode(F.array(*[F.lit(w) for w in WEEKS]))))
    return (calendar.join(weekly.select(*keys, "week_bucket", value), [*keys, "week_bucket"], "left")
            .withColumn(value, F.coalesce(value, F.lit(0.0))))


def forecast_errors(comparison: DataFrame) -> DataFrame:
    """Absolute and relative error per week; the relative one is null where nothing was paid."""
    diff = F.col("forecast_cash") - F.col("actual_cash")
    return (comparison.withColumn("abs_error", round_even(F.abs(diff), 2))
            .withColumn("perc_error", round_even(F.when(F.col("actual_cash") != 0, diff / F.col("actual_cash")), 2)))


def forecast_vs_actual(forecast: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    return forecast_errors(forecast.join(actual, [*keys, "week_bucket"], "left"))


def forecast_metrics(comparison: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """MAE, MAPE without weeks of zero actual cash, totals and their difference."""
    keys = keys or []
    ratio = F.when(F.col("actual_cash") > 0, F.col("abs_error") / F.col("actual_cash"))
    return (comparison.groupBy(*keys)
            .agg(money_mean(F.col("abs_error")).alias("mae"), F.avg(ratio).alias("mape"),
                 money_sum(F.col("actual_cash")).alias("a"), money_sum(F.col("forecast_cash")).alias("f"))
            .select(*keys, round_even(F.col("mae"), 2).alias("forecast_mae_weekly"),
                    round_even(F.col("mape"), 2).alias("forecast_mape_weekly"),
                    round_even(F.col("a"), 2).alias("total_actual_cf"),
                    round_even(F.col("f"), 2).alias("total_forecast_cf"),
                    round_even(F.col("f") - F.col("a"), 2).alias("total_cf_difference")))


def expected_in_week(p: Column) -> list[Column]:
    """Expected cash of the weeks 1..6, before any rounding."""
    return [F.col("total_open_amount") * p.getItem(w - 1) for w in WEEKS]


def paid_in_week() -> list[Column]:
    """Aggregates: cash paid in each week after the reference date, and the invoice total."""
    amount = F.col("total_open_amount")
    week = payment_week(F.col("invoice_paid"), F.col("reference_date"))
    return [*_sum_in_week(week, amount), round_even(money_sum(amount), 2).alias("total_invoice_amount")]


def _weekly_sums(scored: DataFrame, keys: list[str], probabilities: str, temperature: float | None,
                 extra: list[Column] | None = None) -> DataFrame:
    """One wide row per key: forecast and actual cash of each week and the invoice total."""
    p = F.col(probabilities)
    if temperature is not None:
        p = P.sharpen(p, temperature)
    forecast = [round_even(F.sum(x), 2).alias(f"forecast_{w}") for w, x in zip(WEEKS, expected_in_week(F.col("_p")))]
    return scored.withColumn("_p", p).groupBy(*keys).agg(*forecast, *paid_in_week(), *(extra or []))


def forecast_comparison(scored: DataFrame, keys: list[str] | None = None, probabilities: str = "probabilities",
                        temperature: float | None = schema.TEMPERATURE) -> DataFrame:
    """Forecast against actual cash per key and week in one aggregate over the scored snapshots.

    Sums come before rounding here. ``temperature=None`` takes the probabilities as they are.
    """
    keys = ["reference_date"] if keys is None else keys
    sums = _weekly_sums(scored, keys, probabilities, temperature)
    return forecast_errors(weeks_long(sums, [*keys, "total_invoice_amount"], {
        "forecast_cash": [f"forecast_{w}" for w in WEEKS], "actual_cash": [f"actual_{w}" for w in WEEKS]}))


def forecast_per_reference_date(scored: DataFrame, keys: list[str] | None = None, probabilities: str = "probabilities",
                                temperature: float | None = schema.TEMPERATURE, extra: list[Column] | None = None) -> DataFrame:
    """Forecast metrics of every reference date, with the check against the invoice total.

    The six weeks stay side by side in one row, so the metrics need no second grouping. ``extra`` adds
    aggregates over the same rows.
    """
    keys = ["reference_date"] if keys is None else keys
    return metrics_of_sums(_weekly_sums(scored, keys, probabilities, temperature, extra), keys)


def metrics_of_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Forecast metrics of rows that hold the cash of the six weeks, ``forecast_1..6`` and ``actual_1..6``; other columns stay."""
    pairs = [(F.col(f"forecast_{w}"), F.col(f"actual_{w}")) for w in WEEKS]
    errors = [round_even(F.abs(f - a), 2) for f, a in pairs]
    ratios = [F.when(a > 0, e / a) for e, (_, a) in zip(errors, pairs)]
    counted = P.added([F.coalesce((a > 0).cast("int"), F.lit(0)) for _, a in pairs])
    exact = [P.added([x.cast(MONEY) for x in side]).cast("double") for side in (errors, [f for f, _ in pairs], [a for _, a in pairs])]
    mae, forecast, actual = exact[0] / len(WEEKS), exact[1], exact[2]
    mape = F.when(counted > 0, P.added([F.coalesce(x, F.lit(0.0)) for x in ratios]) / counted)
    known = [*keys, *[c for c in sums.columns if c not in keys and not c.startswith(("forecast_", "actual_"))]]
    return sums.select(*known, round_even(mae, 2).alias("forecast_mae_weekly"), round_even(mape, 2).alias("forecast_mape_weekly"),
                       round_even(actual, 2).alias("total_actual_cf"), round_even(forecast, 2).alias("total_forecast_cf"),
                       round_even(forecast - actual, 2).alias("total_cf_difference"),
                       round_even(forecast, 2).alias("total_expected_cash"))


def forecast_holdout(scored: DataFrame, by: list[str] | None = None, probabilities: str = "probabilities",
                     temperature: float | None = schema.TEMPERATURE, means: dict[str, Column] | None = None) -> DataFrame:
    """Means of the per-date metrics; dates whose MAPE is undefined are left out of its mean.

    ``means`` adds plain means over the scored rows, such as model losses, from the same pass.
    """
    by = by or []
    extra = [F.struct(F.sum(c).alias("s"), F.count(c).alias("n")).alias(f"_{name}") for name, c in (means or {}).items()]
    per_date = forecast_per_reference_date(scored, [*by, "reference_date"], probabilities, temperature, extra)
    rolled = [(F.sum(F.col(f"_{name}").getField("s")) / F.sum(F.col(f"_{name}").getField("n"))).alias(name) for name in means or {}]
    return mean_of_dates(per_date, by, rolled)


def mean_of_dates(per_date: DataFrame, by: list[str], rolled: list[Column] | None = None) -> DataFrame:
    """Means of the metrics of every reference date, and other aggregates over the dates."""
    return per_date.groupBy(*by).agg(
        money_mean(F.col("forecast_mae_weekly")).alias("forecast_mae_weekly"),
        money_mean(F.col("forecast_mape_weekly")).alias("forecast_mape_weekly"),
        money_mean(F.col("total_actual_cf")).alias("forecast_total_actual_cf"),
        money_mean(F.col("total_forecast_cf")).alias("forecast_total_forecast_cf"),
        money_mean(F.col("total_cf_difference")).alias("forecast_total_cf_difference"),
        F.count(F.lit(1)).alias("reference_dates"), *(rolled or []))


def forecast_within_total(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Invoice total and expected cash, with a flag whether the forecast stays within the total."""
    keys = keys or []
    amount, p = F.col("total_open_amount"), F.col("probabilities")
    expected = F.sum(amount * P.added([p.getItem(w - 1) for w in WEEKS]))
    return (scored.groupBy(*keys).agg(money_sum(amount).alias("t"), expected.alias("e"))
            .select(*keys, round_even(F.col("t"), 2).alias("total_invoice_amount"),
                    round_even(F.col("e"), 2).alias("total_expected_cash"),
                    (F.col("e") <= F.col("t")).alias("within_total")))


def mape_score(scored: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """Negative MAPE of the weekly cash over all rows, the score used in parameter search; 0 if undefined."""
    amount, p = F.col("total_open_amount"), F.col(probabilities)
    ratios = []
    for w in WEEKS:
        forecast = F.sum(amount * p.getItem(w - 1))
        actual = F.sum(F.when(F.col("week_bucket") == w - 1, amount).otherwise(0.0))
        ratios.append(F.when(actual != 0, F.abs((actual - forecast) / actual)))
    return (scored.agg(F.array_compact(F.array(*ratios)).alias("r"))
            .select(F.when(F.size("r") > 0, -F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / F.size("r"))
                    .otherwise(0.0).alias("score")))


def forecast_share(weekly: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each week's share of its key's total in percent, and the running total. Six rows per key."""
    keys = keys or []
    all_weeks = Window.partitionBy(*keys)
    running = all_weeks.orderBy("week_bucket").rowsBetween(Window.unboundedPreceding, 0)
    return (weekly.withColumn("share", 100 * F.try_divide("forecast_cash", F.sum("forecast_cash").over(all_weeks)))
            .withColumn("cumulative_cash", F.sum("forecast_cash").over(running)))


def forecast_kpis(weekly: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Total, best week, mean and minimum; the earliest week wins a tie."""
    best = F.min_by("week_bucket", F.struct(-F.col("forecast_cash"), F.col("week_bucket")))
    return weekly.groupBy(*(keys or [])).agg(
        money_sum(F.col("forecast_cash")).alias("total_forecast"), best.alias("best_week"),
        money_mean(F.col("forecast_cash")).alias("mean_week"), F.min("forecast_cash").alias("lowest_week"))


def forecast_table(weekly: DataFrame) -> DataFrame:
    """The forecast as formatted text: week, amount, share, cumulative."""
    shares = forecast_share(weekly)
    def dollars(c: str) -> Column:
        return F.concat(F.lit("$"), F.format_number(F.rint(c), 0))
    return shares.select("week_bucket", F.concat(F.lit("Week "), F.col("week_bucket").cast("string")).alias("week"),
                         dollars("forecast_cash").alias("amount"),
                         F.concat(F.format_number("share", 1), F.lit("%")).alias("share"),
                         dollars("cumulative_cash").alias("cumulative"))
