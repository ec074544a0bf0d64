"""Models: preparation, training, scoring, search, backtests, importance."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from duebook import schema
from duebook.catalog.base import plain, query, r, sql
from duebook.catalog.features import paid
from duebook.catalog.scores import METRICS
from duebook.functions import probability as P
from duebook.operators import cleaning as C
from duebook.operators import metrics as M
from duebook.operators import models as ML
from duebook.operators import search as SE
from duebook.operators import snapshots as S
from duebook.operators import splits as SP
from duebook.plans import scoring, training
from duebook.session import materialise, run_folder
from duebook.sources import adapter as A
from duebook.sources import writers as W



#: What splits, fits, scores and forecasts read of a snapshot.
NEEDED = ["doc_id", "reference_date", "total_open_amount", "invoice_sent", "invoice_paid", "week_bucket", *schema.MODEL_FEATURES]


def table(spark, d):
    """The snapshot table, written once because fits read it several times. Other columns are left out before the join with the history moves them."""
    return materialise(C.impute_history(S.build_snapshots(paid(spark, d))).select(*dict.fromkeys(NEEDED)), "snapshots")


def parts(spark, d):
    marked = SP.train_valid_test(table(spark, d))
    return [marked.where(F.col("part") == p).drop("part", "fold") for p in ("train", "valid", "test")]


def before_test(spark, d):
    """Everything up to the 80 % date."""
    return SP.train_valid_test(table(spark, d)).where(F.col("part") != "test").drop("part", "fold")


IMPUTED = schema.MODEL_FEATURES

#: Forest of the jobs that fit five or more of them; the README gives the times.
SMALL = dict(trees=10, depth=6)


@query("impute_median", sql("feat", "SELECT doc_id, CAST(reference_date AS VARCHAR) AS reference_date, " + ", ".join(
    f"""round_even(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM feat)) * 1e6, 0) / 1e6 AS {c}""" for c in IMPUTED) + " FROM feat"))
def _(spark, d):
    # Written once: the medians read it twice, and the snapshots would be joined with the history each time.
    s = materialise(S.build_snapshots(paid(spark, d)).select("doc_id", "reference_date", *IMPUTED), "snapshots")
    return plain(ML.impute_median(s, IMPUTED).select("doc_id", "reference_date", *IMPUTED))


@query("impute_categorical", sql("inv", """
  SELECT doc_id, coalesce(CASE WHEN business_year <> 2021 THEN document_type END, 'Missing') AS constant,
    coalesce(CASE WHEN business_year <> 2021 THEN cust_payment_terms END, (SELECT cust_payment_terms FROM inv WHERE business_year <> 2021
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS frequent FROM inv"""))
def _(spark, d):
    known = F.col("business_year") != 2021
    inv = A.invoices(spark, d, only_paid=False).select(
        "doc_id", F.when(known, F.col("document_type")).alias("constant"), F.when(known, F.col("cust_payment_terms")).alias("frequent"))
    return ML.impute_categorical(ML.impute_categorical(inv, ["constant"]), ["frequent"], "most_frequent")


@query("ordinal_encode", sql("inv", """
  SELECT doc_id, CASE WHEN business_year = 2021 THEN -1 ELSE (SELECT CAST(count(DISTINCT cust_payment_terms) AS INTEGER) FROM inv i
    WHERE i.cust_payment_terms < inv.cust_payment_terms) END AS cust_payment_terms_code FROM inv"""))
def _(spark, d):
    inv = A.invoices(spark, d, only_paid=False)
    asked = inv.withColumn("cust_payment_terms", F.when(F.col("business_year") != 2021, F.col("cust_payment_terms")).otherwise("XX"))
    return ML.ordinal_encode(asked, ["cust_payment_terms"], train=inv).select("doc_id", "cust_payment_terms_code")


@query("shift_labels", sql("scored_snap", f"""
  SELECT week_bucket + 1 AS week, {', '.join(f'{r(f"avg(p{c})")} AS p_{c}' for c in range(1, 8))} FROM scored_snap GROUP BY 1"""))
def _(spark, d):
    s = A.scored(S.snapshot_open_invoices(A.invoices(spark, d)))
    return plain(s.groupBy((F.col("week_bucket") + 1).alias("week")).agg(
        *[F.avg(F.col("probabilities").getItem(c)).alias(f"p_{c + 1}") for c in range(schema.N_CLASSES)]))


def feature_sql(c: str) -> str:
    filled = {"customer_avg_delay": "coalesce(customer_avg_delay, 0)", "days_since_last_invoice": "coalesce(days_since_last_invoice, -1)"}
    return f"{r(filled.get(c, c))} + 0.0 AS {c}"


@query("assemble_features", sql("feat", f"""
  SELECT doc_id, CAST(reference_date AS VARCHAR) AS reference_date, {', '.join(feature_sql(c) for c in schema.MODEL_FEATURES)} FROM feat"""))
def _(spark, d):
    s = table(spark, d)
    vector = vector_to_array("features")
    out = Pipeline(stages=ML.assemble_features()).fit(s).transform(s).withColumn("v", vector)
    flat = plain(out.select("doc_id", "reference_date", *[F.col("v").getItem(i).alias(c) for i, c in enumerate(schema.MODEL_FEATURES)]))
    return flat.select("doc_id", "reference_date", *[(F.col(c) + F.lit(0.0)).alias(c) for c in schema.MODEL_FEATURES])


@query("train_and_score")
def _(spark, d):
    train, _, test = parts(spark, d)
    scored = ML.score(ML.train_classifier(train, ML.forest()), test)
    return plain(scored.select("doc_id", "reference_date", P.predicted_class(F.col("probabilities")).alias("predicted_class"),
                               *P.spread(F.col("probabilities"))))


@query("score_batch")
def _(spark, d):
    """Raw invoices, open ones included, scored as of one date with the paid invoices as history."""
    train, _, _ = parts(spark, d)
    model = ML.train_classifier(train, ML.forest())
    scored = scoring.score_batch(A.raw_invoices(spark, d), S.population_as_of(A.invoices(spark, d), A.as_of()), model)
    return plain(scored.select("doc_id", "total_open_amount", *P.spread(F.col("probabilities"))))


@query("score_forecast_and_queue")
def _(spark, d):
    train, _, _ = parts(spark, d)
    model = ML.train_classifier(train, ML.forest())
    raw = A.raw_invoices(spark, d, with_name=True)
    scored = materialise(scoring.score_batch(raw, S.population_as_of(A.invoices(spark, d), A.as_of()), model, carry=("name_customer",)), "scored")
    weekly = scoring.forecast(scored).select(F.lit("forecast").alias("kind"), F.col("week_bucket").cast("bigint").alias("key"),
                                             F.col("forecast_cash").alias("amount"), F.lit(None).cast("string").alias("name"))
    queue = scoring.queue(scored, A.as_of()).select(F.lit("queue").alias("kind"), F.col("doc_id").alias("key"),
                                                    F.col("total_open_amount").alias("amount"), F.col("name_customer").alias("name"))
    return plain(weekly.unionByName(queue))


@query("compare_models")
def _(spark, d):
    train, valid, _ = parts(spark, d)
    return plain(ML.compare_models(train, valid, {k: v for k, v in ML.learners().items()}))


@query("calibrate_sigmoid")
def _(spark, d):
    train, valid, test = parts(spark, d)
    model = ML.train_classifier(train, ML.forest())
    before = ML.score(model, test)
    after = ML.calibrate_sigmoid(ML.score(model, valid), before)

    def measured(scored, stage):
        scored = materialise(scored.select("week_bucket", "probabilities"), stage)
        return M.model_metrics(scored).crossJoin(F.broadcast(M.macro_f1(scored))).withColumn("stage", F.lit(stage))
    return plain(M.union_results(measured(before, "raw"), measured(after, "calibrated")))


def rows_of(spark, results: list[dict]):
    return spark.createDataFrame([{k: float(v) for k, v in x.items()} for x in results])


@query("random_search")
def _(spark, d):
    train, valid, _ = parts(spark, d)
    space = {"trees": [5, 10, 20], "depth": [4, 6, 8]}
    return plain(rows_of(spark, SE.random_search(train, valid, space, n=4)))


@query("grid_search")
def _(spark, d):
    return plain(rows_of(spark, SE.grid_search(before_test(spark, d), {"trees": [5], "depth": [4, 6]}, ["doc_id", "reference_date"], folds=3)))


@query("random_search_by_mape")
def _(spark, d):
    train, valid, _ = parts(spark, d)
    return plain(rows_of(spark, SE.random_search(train, valid, {"trees": [5, 10], "depth": [4, 6]}, n=2, scoring="mape")))


@query("walk_forward_backtest")
def _(spark, d):
    folds = SE.walk_forward(table(spark, d), ML.forest(**SMALL))
    return plain(folds.drop("cutoff").select("percentile", "log_loss", "top_1_accuracy", "top_2_accuracy"))


@query("walk_forward_cash_backtest")
def _(spark, d):
    folds = materialise(SE.walk_forward(table(spark, d), ML.forest(**SMALL)), "backtest")
    return plain(SE.backtest_summary(folds))


@query("train")
def _(spark, d):
    """The whole training job; its metrics, reports and model are saved, then read back."""
    run = training.train(A.raw_invoices(spark, d), ML.forest(**SMALL))
    root = run_folder(spark, "runs")
    name = training.save_run(run, root)
    return spark.read.json(f"{root}/metrics/run={name}")


@query("write_metrics", sql("scored_snap", f"SELECT 'first' AS run, {METRICS} FROM scored_snap"))
def _(spark, d):
    root = run_folder(spark, "metrics")
    W.write_metrics(M.model_metrics(A.scored(S.snapshot_open_invoices(A.invoices(spark, d)))), root, "first")
    return plain(spark.read.json(root))


CUT = "quantile_cont(CAST(invoice_sent - DATE '1970-01-01' AS DOUBLE), 0.8)"


@query("data_summary", sql("snap", f"""
  SELECT part, week_bucket, count(*) AS rows, {len(schema.MODEL_FEATURES)} AS n_features FROM (
    SELECT week_bucket, CASE WHEN CAST(reference_date - DATE '1970-01-01' AS DOUBLE) <= c THEN 'train' ELSE 'test' END AS part
    FROM snap CROSS JOIN (SELECT {CUT} AS c FROM snap)) GROUP BY 1, 2"""))
def _(spark, d):
    """The JSON summary, read back into one row per part and class."""
    marked = SP.time_split(S.snapshot_open_invoices(A.invoices(spark, d)))
    text = M.data_summary(marked.where("part = 'train'"), marked.where("part = 'test'"), schema.MODEL_FEATURES)
    part = "struct<rows:bigint,classes:map<string,bigint>>"
    read = text.select(F.from_json("summary", f"train {part}, test {part}, n_features int").alias("s"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col("s").getField(p).getField("classes").alias("classes")) for p in ("train", "test")]))
    return (read.select(each.alias("e"), F.col("s.n_features").alias("n_features"))
            .select("e.part", "n_features", F.explode("e.classes").alias("week_bucket", "rows"))
            .withColumn("week_bucket", F.col("week_bucket").cast("int")))


@query("save_and_load_model")
def _(spark, d):
    train, _, test = parts(spark, d)
    root = run_folder(spark, "models")
    W.save_model(ML.train_classifier(train, ML.forest(trees=2, depth=2)), root)
    W.save_model(ML.train_classifier(train, ML.forest()), root)
    return plain(M.model_metrics(ML.score(W.load_latest_model(spark, root), test)))


@query("feature_importance")
def _(spark, d):
    pairs = ML.feature_importance(ML.train_classifier(before_test(spark, d), ML.forest()))
    return plain(spark.createDataFrame(pairs, "feature string, importance double"))


@query("permutation_importance")
def _(spark, d):
    train, valid, _ = parts(spark, d)
    model = ML.train_classifier(train, ML.forest())
    return plain(ML.permutation_importance(model, valid, ["doc_id", "reference_date"]))


@query("recursive_elimination")
def _(spark, d):
    folds = SE.hash_folds(before_test(spark, d), ["doc_id", "reference_date"], 2)
    return spark.createDataFrame(ML.recursive_elimination(folds, classifier=ML.forest(trees=5, depth=5), minimum=1))


COLLINEAR = ["invoice_age_days", "days_until_due", "pay_terms_days"]  # the first two add up to the third
VIF = [c for c in schema.MODEL_FEATURES if c != "days_until_due"]


def vif_sql() -> str:
    """Diagonal of the product matrix times that of its inverse, by Gauss-Jordan steps; the collinear features are infinite, and one of them is left out."""
    n = len(VIF)
    known = " AND ".join(f"{c} IS NOT NULL" for c in VIF)
    matrix = "[" + ", ".join("[" + ", ".join(
        [f"sum(CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE))" for b in VIF] + ["1e0" if i == j else "0e0" for j in range(n)]) + "]" for i, a in enumerate(VIF)) + "]"
    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'g[{i + 1}][{i + 1}] * m[{i + 1}][{n + i + 1}]', 4)} AS vif FROM done"
                               for i, c in enumerate(VIF) if c not in COLLINEAR)
    never = " UNION ALL ".join(f"SELECT '{c}', CAST('inf' AS DOUBLE)" for c in COLLINEAR)
    return f""", g AS (SELECT {matrix} AS m FROM feat WHERE {known}),
  steps(k, g, m) AS (SELECT 0, m, m FROM g UNION ALL SELECT k + 1, g, list_transform(m, lambda row, i: CASE WHEN i = k + 1
    THEN list_transform(row, lambda x: x / m[k + 1][k + 1]) ELSE list_transform(row, lambda x, j: x - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
    FROM steps WHERE k < {n}), done AS (SELECT * FROM steps WHERE k = {n})
  {cells} UNION ALL {never}"""


@query("vif", sql("feat", vif_sql()).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, d):
    """Of all model features."""
    return plain(spark.createDataFrame(ML.vif(S.build_snapshots(paid(spark, d)), schema.MODEL_FEATURES), "feature string, vif double"), 4)
