"""Model metrics on deterministic probabilities: losses, reports, grids, votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from duebook import schema
from duebook.catalog.base import ARGMAX, CLASSES, PARTS, WEEKS, dsum, mean, plain, query, r, sql
from duebook.catalog.cash import COMPARISON, ERRORS
from duebook.functions import probability as P
from duebook.operators import grids as G
from duebook.operators import metrics as M
from duebook.operators import splits as SP
from duebook.operators import snapshots as S
from duebook.session import materialise
from duebook.sources import adapter as A

TRUTH = "CASE week_bucket " + " ".join(f"WHEN {c - 1} THEN p{c}" for c in CLASSES) + " END"
LOSS = f"-ln(least(greatest({TRUTH}, 2.220446049250313e-16), 1 - 2.220446049250313e-16))"
BEFORE = " + ".join(f"CAST(p{c} > {TRUTH} OR (p{c} = {TRUTH} AND {c - 1} > week_bucket) AS INTEGER)" for c in CLASSES)


def scored(spark, d):
    return A.scored(S.snapshot_open_invoices(A.invoices(spark, d)))


@query("log_loss", sql("scored_snap", f"SELECT {r(f'avg({LOSS})')} AS log_loss FROM scored_snap"))
def _(spark, d):
    return plain(M.log_loss(scored(spark, d)))


METRICS = f"""{r(f'avg({LOSS})')} AS log_loss, {r(f'avg(CASE WHEN {ARGMAX} = week_bucket THEN 1e0 ELSE 0e0 END)')} AS top_1_accuracy,
  {r(f'avg(CASE WHEN {BEFORE} < 2 THEN 1e0 ELSE 0e0 END)')} AS top_2_accuracy"""


@query("accuracy_and_top_k_accuracy", sql("scored_snap", f"SELECT {METRICS} FROM scored_snap"))
def _(spark, d):
    return plain(M.model_metrics(scored(spark, d)))


@query("confusion_matrix", sql("scored_snap", f"""
  SELECT week_bucket AS actual, {', '.join(f'count(*) FILTER (WHERE {ARGMAX} = {c}) AS pred_{c}' for c in range(7))}
  FROM scored_snap GROUP BY 1"""))
def _(spark, d):
    return M.confusion_matrix(scored(spark, d))


REPORT = f"""SELECT c AS class, tp, support, predicted, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0e0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0e0 END AS recall FROM (
  SELECT c, CAST(count(*) FILTER (WHERE y = c AND z = c) AS DOUBLE) AS tp, count(*) FILTER (WHERE y = c) AS support,
    CAST(count(*) FILTER (WHERE z = c) AS DOUBLE) AS predicted
  FROM (SELECT week_bucket AS y, {ARGMAX} AS z FROM scored_snap) CROSS JOIN (SELECT CAST(unnest(range(7)) AS INTEGER) AS c) GROUP BY 1)"""
REPORT = f"SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM ({REPORT})"


@query("classification_report", sql("scored_snap", f"""
  SELECT class, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, support FROM ({REPORT})"""))
def _(spark, d):
    return plain(M.classification_report(M.confusion_counts(scored(spark, d))))


@query("report_means", sql("scored_snap", f"""
  SELECT {', '.join(f'{r(f"avg({c})")} AS macro_{c}, {r(f"sum({c} * support) / sum(support)")} AS weighted_{c}' for c in ('precision', 'recall', 'f1'))}
  FROM ({REPORT})"""))
def _(spark, d):
    return plain(M.report_means(M.classification_report(M.confusion_counts(scored(spark, d)))))


LONG = " UNION ALL ".join(f"SELECT {c - 1} AS class, p{c} AS p, CAST(week_bucket = {c - 1} AS INTEGER) AS hit FROM scored_snap" for c in CLASSES)


@query("calibration_bins", sql("scored_snap", f"""
  SELECT class, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, {r('avg(p)')} AS mean_predicted, {r('avg(hit)')} AS observed_rate, count(*) AS n
  FROM ({LONG}) GROUP BY 1, 2"""))
def _(spark, d):
    return plain(M.calibration_bins(scored(spark, d)))


FOLD_CUTS = " UNION ALL ".join(
    f"SELECT {int(p * 100)} AS percentile, quantile_cont(x, {p}) AS c FROM (SELECT DISTINCT "
    f"CAST(reference_date - DATE '1970-01-01' AS DOUBLE) AS x FROM snap)" for p in schema.BACKTEST_PERCENTILES)
FOLD_METRICS = f"""SELECT percentile, {METRICS} FROM ({FOLD_CUTS}) JOIN (SELECT *, CAST(reference_date - DATE '1970-01-01' AS DOUBLE) AS x
  FROM scored_snap) ON x > c AND x <= c + 42 GROUP BY 1"""


def fold_metrics(spark, d):
    folds = SP.backtest_windows(S.snapshot_open_invoices(A.invoices(spark, d))).where("part = 'test'")
    return plain(M.model_metrics(A.scored(folds), by=["percentile"]))


@query("backtest_fold_metrics", sql("scored_snap", FOLD_METRICS))
def _(spark, d):
    return fold_metrics(spark, d)


AVERAGED = ["log_loss", "top_1_accuracy", "top_2_accuracy"]


@query("backtest_aggregate", sql("scored_snap", f"""
  SELECT count(*) AS n_folds, {', '.join(f'{r(f"avg({c})")} AS avg_{c}, {r(f"stddev_pop({c})")} AS std_{c}' for c in AVERAGED)}
  FROM ({FOLD_METRICS})"""))
def _(spark, d):
    return plain(M.backtest_aggregate(fold_metrics(spark, d), AVERAGED))


@query("rank_results", sql("scored_snap", f"""
  SELECT percentile, log_loss, CAST(rank() OVER (ORDER BY log_loss, top_1_accuracy) AS INTEGER) AS place FROM ({FOLD_METRICS})"""))
def _(spark, d):
    return M.rank_results(fold_metrics(spark, d), ["log_loss", "top_1_accuracy"]).select("percentile", "log_loss", "place")


@query("union_results", sql("scored_snap", f"""
  SELECT 'all' AS part, NULL AS percentile, {METRICS} FROM scored_snap UNION ALL SELECT 'fold', * FROM ({FOLD_METRICS})"""))
def _(spark, d):
    base = plain(M.model_metrics(scored(spark, d))).withColumn("part", F.lit("all"))
    return M.union_results(base, fold_metrics(spark, d).withColumn("part", F.lit("fold")))


# -- votes and grids -------------------------------------------------------------------------------------

def member_sql(prefix: str, salt: int) -> str:
    """The seven probabilities of one member, from the key alone."""
    weights = [f"CAST(1 + (doc_id * {2 * c + 1 + salt}) % 11 AS DOUBLE)" for c in range(7)]
    return ", ".join(f"{w} / ({' + '.join(weights)}) AS {prefix}{c}" for c, w in zip(CLASSES, weights))


PARTS["members"] = (["snap"], f"SELECT *, {member_sql('p', 0)}, {member_sql('q', 2)}, {member_sql('u', 4)} FROM snap")


def members(s):
    return s.select("*", *[A.pseudo_probabilities(F.col("doc_id"), salt).alias(n) for n, salt in (("m1", 0), ("m2", 2), ("m3", 4))])


@query("soft_vote", sql("members", f"""
  , v AS (SELECT doc_id, reference_date, {', '.join(f'(p{c} * 2 + q{c} * 1 + u{c} * 1) / 4 AS v{c}' for c in CLASSES)} FROM members)
  SELECT doc_id, CAST(reference_date AS VARCHAR) AS reference_date, {', '.join(f'{r(f"v{c}")} AS p_{c}' for c in CLASSES)} FROM v"""))
def _(spark, d):
    vote = P.soft_vote([F.col("m1"), F.col("m2"), F.col("m3")], [F.lit(2.0), F.lit(1.0), F.lit(1.0)])
    return plain(members(S.snapshot_open_invoices(A.invoices(spark, d))).select("doc_id", "reference_date", *P.spread(vote)))


def grid_sql(source: str, key: str, final: str) -> str:
    """Holdout cash metrics per grid row; ``source`` has the key, s1..s7, the amount, the date and the label."""
    sums = " UNION ALL ".join(
        f"""SELECT {key}, reference_date, {w} AS week_bucket, {r(f'sum(total_open_amount * s{w})', 2)} AS forecast_cash,
        coalesce({dsum(f'CASE WHEN week_bucket + 1 = {w} THEN total_open_amount END')}, 0) AS actual_cash
        FROM {source} GROUP BY 1, 2""" for w in WEEKS)
    per_date = f"""SELECT {key}, reference_date, {r(f"{dsum('abs_error')} / count(abs_error)", 2)} AS mae,
      {r('avg(CASE WHEN actual_cash > 0 THEN abs_error / actual_cash END)', 2)} AS mape,
      {r(f"{dsum('forecast_cash')} - {dsum('actual_cash')}", 2)} AS diff FROM (SELECT *, {ERRORS} FROM ({sums})) GROUP BY 1, 2"""
    return f"""SELECT {key}, {mean('mae', 2)} AS forecast_mae_weekly, {mean('mape', 4)} AS forecast_mape_weekly,
      {mean('diff', 2)} AS forecast_total_cf_difference FROM ({per_date}) GROUP BY 1 {final}"""


def sharpened(columns: str, source: str, prefix: str) -> str:
    z = ", ".join(f"pow(least(greatest({prefix}{c}, 1e-12), 1.0), 1.25) AS z{c}" for c in CLASSES)
    total = "(" + " + ".join(f"z{c}" for c in CLASSES) + ")"
    return (f"SELECT {columns}, {', '.join(f'z{c} / {total} AS s{c}' for c in CLASSES)} "
            f"FROM (SELECT *, {z} FROM {source})")


WEIGHTS = " UNION ALL ".join(f"SELECT '{a}-{b}-{c}' AS weights, {a}e0 AS wa, {b}e0 AS wb, {c}e0 AS wc" for a, b, c in schema.WEIGHT_GRID)
VOTES = f"""SELECT weights, reference_date, total_open_amount, week_bucket,
  {', '.join(f'(p{c} * wa + q{c} * wb + u{c} * wc) / (wa + wb + wc) AS v{c}' for c in CLASSES)} FROM members CROSS JOIN ({WEIGHTS})"""
VOTE_TRUTH = "CASE week_bucket " + " ".join(f"WHEN {c - 1} THEN v{c}" for c in CLASSES) + " END"
VOTE_ARGMAX = "CASE greatest(v1,v2,v3,v4,v5,v6,v7) " + " ".join(f"WHEN v{c} THEN {c - 1}" for c in CLASSES) + " END"


@query("weight_grid", sql("members", f"""
  , votes AS ({VOTES}), sh AS ({sharpened('weights, reference_date, total_open_amount, week_bucket', 'votes', 'v')}),
  cash AS ({grid_sql('sh', 'weights', '')}),
  loss AS (SELECT weights, {r(f'avg(-ln({VOTE_TRUTH}))')} AS log_loss FROM votes GROUP BY 1),
  best AS (SELECT weights, week_bucket AS actual, {VOTE_ARGMAX} AS predicted FROM votes),
  sides AS (SELECT weights, actual AS class, 1 AS t, 0 AS p, CAST(actual = predicted AS INTEGER) AS hit FROM best
    UNION ALL SELECT weights, predicted, 0, 1, 0 FROM best),
  f AS (SELECT weights, {r('avg(f1)')} AS f1_macro FROM (SELECT weights, class, CASE WHEN sum(hit) > 0 THEN 2e0 * (sum(hit) / sum(p)) * (sum(hit) / sum(t))
    / (sum(hit) / sum(p) + sum(hit) / sum(t)) ELSE 0e0 END AS f1 FROM sides GROUP BY 1, 2) GROUP BY 1)
  SELECT weights, log_loss, f1_macro, forecast_mae_weekly, forecast_mape_weekly, forecast_total_cf_difference,
    CAST(rank() OVER (ORDER BY forecast_mae_weekly, forecast_mape_weekly) AS INTEGER) AS place FROM cash JOIN loss USING (weights)
  JOIN f USING (weights)"""))
def _(spark, d):
    # Written once: votes and paid cash read it, and the invoices would be cleaned for each.
    s = materialise(S.snapshot_open_invoices(A.invoices(spark, d)).select("doc_id", *G.ROW, "invoice_paid"), "snapshots")
    return G.weight_grid(members(s), ["m1", "m2", "m3"]).select(
        "weights", "log_loss", "f1_macro", "forecast_mae_weekly", "forecast_mape_weekly", "forecast_total_cf_difference", "place")


BIAS = " UNION ALL ".join(f"SELECT '{n}' AS bias_name, " + ", ".join(f"{x}e0 AS b{c + 1}" for c, x in enumerate(w))
                          for n, w in schema.BIAS_GRID.items())
BIAS_SUM = "(" + " + ".join(f"p{c} * b{c}" for c in CLASSES) + ")"


@query("bias_grid", sql("scored_snap", f"""
  , cuts AS (SELECT quantile_cont(x, 0.6) AS a, quantile_cont(x, 0.8) AS b FROM
     (SELECT CAST(reference_date - DATE '1970-01-01' AS DOUBLE) AS x FROM snap)),
  valid AS (SELECT s.* EXCLUDE (s1, s2, s3, s4, s5, s6, s7) FROM scored_snap s CROSS JOIN cuts
     WHERE CAST(reference_date - DATE '1970-01-01' AS DOUBLE) > a AND CAST(reference_date - DATE '1970-01-01' AS DOUBLE) <= b),
  tilted AS (SELECT bias_name, reference_date, total_open_amount, week_bucket, {', '.join(f'p{c} * b{c} / {BIAS_SUM} AS s{c}' for c in CLASSES)}
     FROM valid CROSS JOIN ({BIAS})),
  cash AS ({grid_sql('tilted', 'bias_name', '')})
  SELECT *, CAST(rank() OVER (ORDER BY forecast_mae_weekly, forecast_mape_weekly) AS INTEGER) AS place FROM cash"""))
def _(spark, d):
    valid = SP.train_valid_test(S.snapshot_open_invoices(A.invoices(spark, d))).where("part = 'valid'")
    return G.bias_grid(A.scored(valid)).select(
        "bias_name", "forecast_mae_weekly", "forecast_mape_weekly", "forecast_total_cf_difference", "place")
