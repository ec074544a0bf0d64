"""Weekly cash: forecast, actual, errors, holdout."""

from __future__ import annotations

from pyspark.sql import functions as F

from duebook.catalog.base import WEEKS, dsum, mean, plain, query, r, sql
from duebook.functions import probability as P
from duebook.functions.numbers import round_even
from duebook.operators import cleaning as C
from duebook.operators import forecast as FC
from duebook.operators import joins as J
from duebook.operators import snapshots as S
from duebook.session import run_folder
from duebook.sources import adapter as A
from duebook.sources import writers as W


def scored_snaps(spark, d):
    return A.scored(S.snapshot_open_invoices(A.invoices(spark, d)))


def scored_inv(spark, d):
    return A.scored(A.invoices(spark, d, only_paid=False))


P_COLS = ", ".join(f"{r(f'p{c}')} AS p_{c}" for c in range(1, 8))
S_COLS = ", ".join(f"{r(f's{c}')} AS p_{c}" for c in range(1, 8))


@query("attach_probabilities", sql("scored_inv", f"SELECT doc_id, {r('total_open_amount')} AS total_open_amount, {P_COLS} FROM scored_inv"))
def _(spark, d):
    inv = A.invoices(spark, d, only_paid=False).select("doc_id", "total_open_amount")
    probabilities = A.scored(A.invoices(spark, d, only_paid=False)).select("doc_id", "probabilities")
    joined = J.attach_probabilities(inv, probabilities)
    return plain(joined.select("doc_id", "total_open_amount", *P.spread(F.col("probabilities"))))


@query("sharpen_probabilities", sql("scored_inv", f"SELECT doc_id, {S_COLS} FROM scored_inv"))
def _(spark, d):
    return plain(scored_inv(spark, d).select("doc_id", *P.spread(P.sharpen(F.col("probabilities")))))


TILT = [1.05, 1.03, 1.02, 1.00, 0.98, 0.96, 1.00]
TILT_SUM = "(" + " + ".join(f"p{c + 1} * {w}e0" for c, w in enumerate(TILT)) + ")"


@query("tilt_probabilities", sql("scored_inv", f"""
  SELECT doc_id, {', '.join(f"{r(f'p{c + 1} * {w}e0 / {TILT_SUM}')} AS p_{c + 1}" for c, w in enumerate(TILT))} FROM scored_inv"""))
def _(spark, d):
    weights = F.array(*[F.lit(w) for w in TILT])
    return plain(scored_inv(spark, d).select("doc_id", *P.spread(P.tilt(F.col("probabilities"), weights))))


@query("expected_cash", sql("scored_inv", f"""
  SELECT doc_id, {', '.join(f"{r(f'total_open_amount * s{w}', 2)} AS expected_cash_{w}" for w in WEEKS)} FROM scored_inv"""))
def _(spark, d):
    return FC.expected_cash(scored_inv(spark, d)).select("doc_id", *[f"expected_cash_{w}" for w in WEEKS])


FORECAST = " UNION ALL ".join(
    f"SELECT {w} AS week_bucket, {r(dsum(r(f'total_open_amount * s{w}', 2)), 2)} AS forecast_cash FROM scored_inv" for w in WEEKS)


@query("weekly_forecast_cash", sql("scored_inv", FORECAST))
def _(spark, d):
    return FC.weekly_forecast_cash(scored_inv(spark, d))


FORECAST_AT = " UNION ALL ".join(
    f"SELECT reference_date, {w} AS week_bucket, {r(dsum(r(f'total_open_amount * s{w}', 2)), 2)} AS forecast_cash FROM scored_snap GROUP BY 1"
    for w in WEEKS)
ACTUAL_AT = " UNION ALL ".join(
    f"SELECT reference_date, {w} AS week_bucket, {r(f'coalesce({dsum(f_)}, 0)')} AS actual_cash FROM snap GROUP BY 1"
    for w, f_ in ((w, f"CASE WHEN week_bucket + 1 = {w} THEN total_open_amount END") for w in WEEKS))


@query("weekly_actual_cash", sql("snap", f"""
  SELECT CAST(reference_date AS VARCHAR) AS reference_date, week_bucket, actual_cash FROM ({ACTUAL_AT})"""))
def _(spark, d):
    return plain(FC.weekly_actual_cash(S.snapshot_open_invoices(A.invoices(spark, d))))


@query("complete_weeks", sql("snap", f"""
  SELECT CAST(reference_date AS VARCHAR) AS reference_date, week_bucket, actual_cash FROM ({ACTUAL_AT})"""))
def _(spark, d):
    """Sums of the weeks that have payments, then the calendar of all weeks."""
    s = S.snapshot_open_invoices(A.invoices(spark, d)).withColumn("week_bucket", F.col("week_bucket") + 1)
    paid = (C.in_horizon(s).groupBy("reference_date", "week_bucket")
            .agg(F.sum(F.col("total_open_amount").cast("decimal(28,6)")).cast("double").alias("actual_cash")))
    every = paid.unionByName(s.select("reference_date").distinct(), allowMissingColumns=True)
    return plain(FC.complete_weeks(every, ["reference_date"], "actual_cash"))


@query("in_horizon", sql("snap", "SELECT week_bucket + 1 AS week_bucket, count(*) AS n FROM snap WHERE week_bucket + 1 BETWEEN 1 AND 6 GROUP BY 1"))
def _(spark, d):
    s = S.snapshot_open_invoices(A.invoices(spark, d)).withColumn("week_bucket", F.col("week_bucket") + 1)
    return C.in_horizon(s).groupBy("week_bucket").agg(F.count(F.lit(1)).alias("n"))


ERRORS = f"""{r('abs(forecast_cash - actual_cash)', 2)} AS abs_error,
  CASE WHEN actual_cash <> 0 THEN {r('(forecast_cash - actual_cash) / actual_cash', 2)} + 0.0 END AS perc_error"""


@query("forecast_vs_actual", sql("scored_snap", f"""
  SELECT CAST(reference_date AS VARCHAR) AS reference_date, week_bucket, forecast_cash, actual_cash, {ERRORS}
  FROM ({FORECAST_AT}) JOIN ({ACTUAL_AT}) USING (reference_date, week_bucket)"""))
def _(spark, d):
    s = scored_snaps(spark, d)
    both = FC.forecast_vs_actual(FC.weekly_forecast_cash(s, ["reference_date"]), FC.weekly_actual_cash(s), ["reference_date"])
    return plain(both).withColumn("perc_error", F.col("perc_error") + 0.0)


COMPARISON = " UNION ALL ".join(
    f"""SELECT reference_date, {w} AS week_bucket, {r(f'sum(total_open_amount * s{w})', 2)} AS forecast_cash,
      coalesce({dsum(f'CASE WHEN week_bucket + 1 = {w} THEN total_open_amount END')}, 0) AS actual_cash,
      {r(dsum('total_open_amount'), 2)} AS total_invoice_amount FROM scored_snap GROUP BY 1""" for w in WEEKS)
PER_DATE = f"""
  SELECT reference_date, {r(f"{dsum('abs_error')} / count(abs_error)", 2)} AS forecast_mae_weekly,
    {r('avg(CASE WHEN actual_cash > 0 THEN abs_error / actual_cash END)', 2)} AS forecast_mape_weekly,
    {r(dsum('actual_cash'), 2)} AS total_actual_cf, {r(dsum('forecast_cash'), 2)} AS total_forecast_cf,
    {r(f"{dsum('forecast_cash')} - {dsum('actual_cash')}", 2)} AS total_cf_difference, max(total_invoice_amount) AS total_invoice_amount
  FROM (SELECT *, {ERRORS} FROM ({COMPARISON})) GROUP BY 1"""


@query("forecast_errors", sql("scored_snap", f"""
  SELECT CAST(reference_date AS VARCHAR) AS reference_date, week_bucket, forecast_cash, {r('actual_cash')} AS actual_cash,
    total_invoice_amount, {ERRORS} FROM ({COMPARISON})"""))
def _(spark, d):
    return plain(FC.forecast_comparison(scored_snaps(spark, d))).withColumn("perc_error", F.col("perc_error") + 0.0)


@query("forecast_metrics", sql("scored_snap", f"""
  SELECT {r(f"{dsum('abs_error')} / count(abs_error)", 2)} AS forecast_mae_weekly,
    {r('avg(CASE WHEN actual_cash > 0 THEN abs_error / actual_cash END)', 2)} AS forecast_mape_weekly,
    {r(dsum('actual_cash'), 2)} AS total_actual_cf, {r(dsum('forecast_cash'), 2)} AS total_forecast_cf,
    {r(f"{dsum('forecast_cash')} - {dsum('actual_cash')}", 2)} AS total_cf_difference
  FROM (SELECT *, {ERRORS} FROM ({COMPARISON}))"""))
def _(spark, d):
    return FC.forecast_metrics(FC.forecast_comparison(scored_snaps(spark, d)))


@query("forecast_per_reference_date", sql("scored_snap", f"""
  SELECT *  REPLACE (CAST(reference_date AS VARCHAR) AS reference_date), total_forecast_cf AS total_expected_cash FROM ({PER_DATE})"""))
def _(spark, d):
    return plain(FC.forecast_per_reference_date(scored_snaps(spark, d)), 2)


@query("forecast_holdout", sql("scored_snap", f"""
  SELECT {mean('forecast_mae_weekly', 2)} AS forecast_mae_weekly, {mean('forecast_mape_weekly', 4)} AS forecast_mape_weekly,
    {mean('total_actual_cf', 2)} AS forecast_total_actual_cf, {mean('total_forecast_cf', 2)} AS forecast_total_forecast_cf,
    {mean('total_cf_difference', 2)} AS forecast_total_cf_difference, count(*) AS reference_dates FROM ({PER_DATE})"""))
def _(spark, d):
    out = FC.forecast_holdout(scored_snaps(spark, d))
    digits = {"forecast_mape_weekly": 4, "reference_dates": None}
    return out.select(*[F.col(c) if digits.get(c, 2) is None else round_even(F.col(c), digits.get(c, 2)).alias(c)
                        for c in out.columns])


@query("forecast_within_total", sql("scored_snap", f"""
  SELECT CAST(reference_date AS VARCHAR) AS reference_date, {r(dsum('total_open_amount'), 2)} AS total_invoice_amount,
    {r(f"sum(total_open_amount * (p1+p2+p3+p4+p5+p6))", 2)} AS total_expected_cash,
    CAST(sum(total_open_amount * (p1+p2+p3+p4+p5+p6)) <= {dsum('total_open_amount')} AS INTEGER) AS within_total
  FROM scored_snap GROUP BY 1"""))
def _(spark, d):
    return plain(FC.forecast_within_total(scored_snaps(spark, d), ["reference_date"]), 2)


RATIOS = [f"abs((sum(CASE WHEN week_bucket = {w - 1} THEN total_open_amount ELSE 0 END) - sum(total_open_amount * p{w})) / "
          f"nullif(sum(CASE WHEN week_bucket = {w - 1} THEN total_open_amount ELSE 0 END), 0))" for w in WEEKS]


@query("mape_scorer", sql("scored_snap", f"""
  SELECT {r('-list_avg(list_filter([' + ', '.join(RATIOS) + '], lambda x: x IS NOT NULL))')} AS score FROM scored_snap"""))
def _(spark, d):
    return plain(FC.mape_score(scored_snaps(spark, d)))


@query("forecast_share", sql("scored_inv", f"""
  SELECT week_bucket, forecast_cash, {r('100 * forecast_cash / sum(forecast_cash) OVER ()')} AS share,
    {r('sum(forecast_cash) OVER (ORDER BY week_bucket)', 2)} AS cumulative_cash FROM ({FORECAST})"""))
def _(spark, d):
    shares = FC.forecast_share(FC.weekly_forecast_cash(scored_inv(spark, d)))
    return plain(shares).withColumn("cumulative_cash", round_even(F.col("cumulative_cash"), 2))


@query("cumulative_cash", sql("scored_snap", f"""
  SELECT CAST(reference_date AS VARCHAR) AS reference_date, week_bucket,
    {r('sum(forecast_cash) OVER (PARTITION BY reference_date ORDER BY week_bucket)', 2)} AS cumulative_cash FROM ({FORECAST_AT})"""))
def _(spark, d):
    weekly = FC.weekly_forecast_cash(scored_snaps(spark, d), ["reference_date"])
    return plain(FC.forecast_share(weekly, ["reference_date"]).select("reference_date", "week_bucket", "cumulative_cash"), 2)


@query("forecast_kpis", sql("scored_inv", f"""
  SELECT {r('sum(forecast_cash)', 2)} AS total_forecast, arg_max(week_bucket, forecast_cash) AS best_week,
    {mean('forecast_cash', 2)} AS mean_week, min(forecast_cash) AS lowest_week FROM ({FORECAST})"""))
def _(spark, d):
    return plain(FC.forecast_kpis(FC.weekly_forecast_cash(scored_inv(spark, d))), 2)


@query("forecast_table", sql("scored_inv", f"""
  SELECT week_bucket, 'Week ' || week_bucket AS week, '$' || format('{{:,.0f}}', forecast_cash) AS amount,
    format('{{:.1f}}', 100 * forecast_cash / sum(forecast_cash) OVER ()) || '%' AS share,
    '$' || format('{{:,.0f}}', sum(forecast_cash) OVER (ORDER BY week_bucket)) AS cumulative FROM ({FORECAST})"""))
def _(spark, d):
    return FC.forecast_table(FC.weekly_forecast_cash(scored_inv(spark, d)))


@query("write_forecast", sql("scored_inv", FORECAST))
def _(spark, d):
    path = run_folder(spark, "forecast")
    W.write_records(FC.weekly_forecast_cash(scored_inv(spark, d)), path)
    return spark.read.schema("week_bucket int, forecast_cash double").json(path)
