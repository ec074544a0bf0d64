"""Models by their properties: better than guessing, repeatable, consistent after saving."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duebook import schema
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

SMALL = dict(trees=10, depth=5)


@pytest.fixture(scope="module")
def snapshots(spark, folder):
    return materialise(C.impute_history(S.build_snapshots(A.invoices(spark, folder))), "snapshots")


@pytest.fixture(scope="module")
def parts(snapshots):
    marked = SP.train_valid_test(snapshots)
    return {p: marked.where(F.col("part") == p).drop("part", "fold") for p in ("train", "valid", "test")}


@pytest.fixture(scope="module")
def model(parts):
    return ML.train_classifier(parts["train"], ML.forest(**SMALL))


def prior_loss(train, test):
    share = {r[0]: r[1] for r in train.groupBy("week_bucket").count().collect()}
    n = sum(share.values())
    counts = {r[0]: r[1] for r in test.groupBy("week_bucket").count().collect()}
    return sum(-math.log(share[c] / n) * k for c, k in counts.items()) / sum(counts.values())


def test_better_than_the_class_shares(parts, model):
    scored = ML.score(model, parts["test"])
    assert M.model_metrics(scored).first()["log_loss"] < prior_loss(parts["train"], parts["test"])
    row = scored.select(F.size("probabilities").alias("n"), F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert row.where("n <> 7 or abs(s - 1) > 1e-9").count() == 0


def test_absent_class_gets_zero(parts):
    few = ML.train_classifier(parts["train"].where("week_bucket < 4"), ML.forest(**SMALL))
    row = ML.score(few, parts["test"]).select("probabilities").first()[0]
    assert len(row) == 7 and row[4:] == [0.0, 0.0, 0.0]


def test_saved_model_scores_alike(spark, parts, model):
    root = run_folder(spark, "models")
    assert W.load_latest_model(spark, root) is None
    W.save_model(model, root, "1")
    W.save_model(ML.train_classifier(parts["train"], ML.forest(trees=1, depth=1)), root, "0")
    again = W.load_latest_model(spark, root)
    a, b = (ML.score(m, parts["test"]).orderBy("doc_id", "reference_date").select("probabilities").collect() for m in (model, again))
    assert a == b


def test_exact_median(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (3.0, None), (4.0, 7.0), (None, 9.0)], "a double, b double")
    fitted = ML.ExactMedianImputer(inputCols=["a", "b"], outputCols=["x", "y"]).fit(df)
    assert fitted.getMedians() == [2.5, 7.0]
    assert [r["x"] for r in fitted.transform(df).collect()] == [1.0, 2.0, 3.0, 4.0, 2.5]
    assert [r["b"] for r in ML.impute_median(df, ["b"]).collect()] == [7.0, 5.0, 7.0, 7.0, 9.0]


def test_codes(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "x string")
    test = spark.createDataFrame([("c",), ("z",), (None,), ("a",)], "x string")
    assert [r["x_code"] for r in ML.ordinal_encode(test, ["x"], train).collect()] == [2, -1, -1, 0]
    filled = ML.impute_categorical(train.union(spark.createDataFrame([("b",)], "x string")), ["x"], "most_frequent")
    assert sorted(r["x"] for r in filled.collect()) == ["a", "b", "b", "b", "c"]
    with pytest.raises(ValueError):
        ML.impute_categorical(train, ["x"], "mean")


def test_calibration_keeps_probabilities(parts, model):
    valid, test = ML.score(model, parts["valid"]), ML.score(model, parts["test"])
    out = ML.calibrate_sigmoid(valid, test)
    sums = out.select(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert sums.where("abs(s - 1) > 1e-9").count() == 0
    assert M.model_metrics(out).first()["log_loss"] < prior_loss(parts["train"], parts["test"]) * 1.1


def test_joint_newton_equals_separate_fits(spark):
    """Slopes and shifts of all classes at once, against MLlib's logistic regression of each class by itself."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    rnd = np.random.default_rng(4)
    rows = []
    for _ in range(3000):
        p = rnd.dirichlet(np.ones(6) * 0.7)
        rows.append(([*map(float, p), 0.0], int(rnd.choice(6, p=0.6 * p + 0.4 / 6))))
    scored = spark.createDataFrame(rows, "probabilities array<double>, week_bucket int").repartition(3)
    fits = ML.fit_sigmoids(scored)
    assert sorted(fits) == list(range(6))  # class 6 does not occur
    for c in (0, 3, 5):
        one = scored.select(F.col("probabilities")[c].alias("p"), (F.col("week_bucket") == c).cast("double").alias("y"))
        alone = LogisticRegression(labelCol="y", tol=1e-12, maxIter=500).fit(VectorAssembler(inputCols=["p"], outputCol="features").transform(one))
        assert fits[c] == pytest.approx((float(alone.coefficients[0]), float(alone.intercept)), rel=1e-4)
    assert ML.fit_sigmoids(scored.where("week_bucket = 2")) == {} and ML.fit_sigmoids(scored.where("false")) == {}
    apart = spark.createDataFrame([([1.0 * (y == c) for c in range(7)], y) for y in (0, 1)] * 20, scored.schema)
    after = ML.apply_sigmoids(apart, ML.fit_sigmoids(apart))
    assert after.where("probabilities[week_bucket] < 0.9").count() == 0  # separable classes end too


def test_permutation_is_global_and_repeatable(spark):
    from duebook.operators.numbering import shuffled_position, with_positions
    df = small_table(spark)
    features = schema.MODEL_FEATURES

    def places(table):
        return sorted((r["repeat"], r["doc_id"], r["position"], r["_moved"][features[1]])
                      for r in ML.permuted(table, ["doc_id"], features, 2, seed=7).collect())
    once = places(df)
    assert once == places(df.repartition(5)) and len(once) == 600
    assert {p for k, _, p, _ in once if k == 1} == set(range(300))
    own = {r["doc_id"]: r[features[1]] for r in df.collect()}
    for k in (1, 2):
        assert sorted(v for r, _, _, v in once if r == k) == sorted(own.values())
    assert [v for k, _, _, v in once if k == 1] != [v for k, _, _, v in once if k == 2]
    for n in (1, 2, 3, 17, 1000):
        got = spark.range(n).select(shuffled_position(F.col("id"), n, F.lit(3)).alias("p"), "id").collect()
        assert sorted(r["p"] for r in got) == list(range(n))
        if n == 1000:
            assert sum(r["p"] == r["id"] for r in got) < 10 and abs(np.corrcoef([r["p"] for r in got], [r["id"] for r in got])[0, 1]) < 0.1
    numbered = with_positions(spark.range(100, 0, -1, 4), [F.col("id")]).orderBy("id").collect()
    assert [r["position"] for r in numbered] == list(range(100))


def test_folds_by_position(spark):
    df = small_table(spark).select("doc_id", "reference_date")
    marked = SP.time_series_rows(df, ["reference_date", "doc_id"], splits=4)
    ordered = [r["test_fold"] for r in marked.orderBy("reference_date", "doc_id").collect()]
    assert ordered == [0] * 60 + [1] * 60 + [2] * 60 + [3] * 60 + [4] * 60
    folds = SP.fold_parts(marked, 4)
    assert [(t.count(), v.count()) for t, v in folds] == [(60, 60), (120, 60), (180, 60), (240, 60)]
    assert SP.time_series_rows(df.limit(3), ["doc_id"], splits=5).where("test_fold > 0").count() == 0


def test_distributions():
    space = {"a": SE.Uniform(2, 4), "b": SE.LogUniform(1, 1000), "c": SE.RandInt(3, 6), "d": ["x", "y"]}
    got = SE.draws(space, 200)
    assert got == SE.draws(space, 200) != SE.draws(space, 200, seed=1) and len(got) == 200
    assert all(2 <= g["a"] < 4 and 1 <= g["b"] <= 1000 and g["c"] in (3, 4, 5) and g["d"] in "xy" for g in got)
    assert {g["c"] for g in got} == {3, 4, 5} and 60 < sum(g["b"] < 32 for g in got) < 140
    assert SE.Uniform(2, 4).at(0.5) == 3 and SE.LogUniform(1, 100).at(0.5) == pytest.approx(10) and SE.RandInt(0, 2).at(0.99) == 1


def test_class_shares_of_cells(spark):
    from duebook.operators import shares as SH
    rows = [(0.5, 0), (0.7, 0), (0.9, 1), (5.0, 3), (None, 2)]
    train = spark.createDataFrame(rows, "a double, week_bucket int")
    learner = SH.CellShares(places=[0], widths=[1.0], smoothing=2.0)
    model = ML.train_classifier(train, learner, ["a"])
    got = {r["a"]: list(r["probabilities"]) for r in ML.score(model, spark.createDataFrame([(0.1,), (5.5,), (99.0,)], "a double")).collect()}
    prior = [0.4, 0.2, 0.2, 0.2, 0, 0, 0]
    assert got[99.0] == pytest.approx(prior)
    held = [2, 1, 1, 0, 0, 0, 0]  # the null is the median, 0.8
    assert got[0.1] == pytest.approx([(n + 2 * p) / 6 for n, p in zip(held, prior)])
    assert got[5.5] == pytest.approx([((c == 3) + 2 * p) / 3 for c, p in enumerate(prior)])
    assert sum(got[0.1]) == pytest.approx(1)
    nothing = ML.train_classifier(train.where("false"), learner, ["a"])
    assert list(ML.score(nothing, train.limit(1)).first()["probabilities"]) == pytest.approx([1 / 7] * 7)


def test_importance(parts, model):
    pairs = ML.feature_importance(model)
    assert sum(w for _, w in pairs) == pytest.approx(1) and {f for f, _ in pairs} == set(schema.MODEL_FEATURES)
    shuffled = ML.permutation_importance(model, parts["valid"], ["doc_id", "reference_date"], repeats=2).collect()
    assert len(shuffled) == 7 and shuffled[0]["importance_mean"] > 0


def test_vif_of_collinear_features(snapshots):
    got = dict(ML.vif(snapshots, schema.MODEL_FEATURES))
    assert all(math.isinf(got[c]) for c in ("invoice_age_days", "days_until_due", "pay_terms_days"))
    assert all(1 <= got[c] < 1000 for c in schema.MODEL_FEATURES if not math.isinf(got[c]))
    zero = snapshots.select(F.lit(0.0).alias("z"), F.col("invoice_age_days"))
    assert math.isnan(dict(ML.vif(zero, ["z", "invoice_age_days"]))["z"])


def test_vif(snapshots):
    names = ["invoice_age_days", "pay_terms_days", "invoice_amount_log"]
    x = np.array([[float(v) for v in r] for r in snapshots.select(*names).collect()])
    for (name, got), i in zip(ML.vif(snapshots, names), range(3)):
        others = np.delete(x, i, axis=1)
        fit = others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        r2 = 1 - ((x[:, i] - fit) ** 2).sum() / (x[:, i] ** 2).sum()
        assert name == names[i] and got == pytest.approx(1 / (1 - r2), rel=1e-6)


def test_search(parts):
    space = {"trees": [2, 5], "depth": [2, 5]}
    assert SE.draws(space, 3) == SE.draws(space, 3) and len(SE.draws(space, 99)) == 4
    best = SE.random_search(parts["train"], parts["valid"], space, n=3)
    assert [b["score"] for b in best] == sorted(b["score"] for b in best)
    folds = SE.hash_folds(parts["train"], ["doc_id", "reference_date"], 3)
    assert sum(v.count() for _, v in folds) == parts["train"].count()


def test_walk_forward(snapshots):
    rows = SE.walk_forward(snapshots, ML.forest(trees=3, depth=3)).collect()
    assert sorted(r["percentile"] for r in rows) == [40, 50, 60, 70, 80]
    assert all(r["log_loss"] > 0 and r["reference_dates"] <= 6 for r in rows)


def test_elimination(parts):
    rows = ML.recursive_elimination([(parts["train"], parts["valid"])], classifier=ML.forest(trees=3, depth=3), minimum=5)
    assert len(rows) == 7 and any(r["selected"] for r in rows) and all((r["ranking"] == 1) == r["selected"] for r in rows)


def test_elimination_learns_the_medians_of_a_fold_once(parts, monkeypatch):
    fits, fit = [], ML.ExactMedianImputer._fit
    monkeypatch.setattr(ML.ExactMedianImputer, "_fit", lambda self, df: fits.append(self) or fit(self, df))
    ML.recursive_elimination([(parts["train"], parts["valid"])], classifier=ML.forest(trees=2, depth=2), minimum=5)
    assert len(fits) == 1


def test_training_and_scoring_jobs(spark, folder):
    raw = A.raw_invoices(spark, folder, with_name=True)
    run = training.train(raw, ML.forest(trees=3, depth=3))
    root = run_folder(spark, "runs")
    name = training.save_run(run, root)
    assert {"log_loss", "forecast_mae_weekly"} <= set(spark.read.json(f"{root}/metrics/run={name}").columns)
    model = W.load_latest_model(spark, f"{root}/models")
    scored = scoring.score_batch(raw, S.population_as_of(A.invoices(spark, folder), A.as_of()), model, carry=("name_customer",))
    assert scored.count() == raw.count()
    assert [r["week_bucket"] for r in scoring.forecast(scored).orderBy("week_bucket").collect()] == [1, 2, 3, 4, 5, 6]
    queue = scoring.queue(scored, A.as_of()).collect()
    assert len(queue) == 10 and all(r["name_customer"] for r in queue)


def small_table(spark):
    rows = [(i, i % 4 if i % 3 else 0, float(i % 4), float(i % 7)) for i in range(300)]
    features = schema.MODEL_FEATURES
    df = spark.createDataFrame(rows, "doc_id long, week_bucket int, a double, b double")
    for i, c in enumerate(features):
        df = df.withColumn(c, F.col("a") if i == 0 else F.col("b") * i)
    return df.withColumn("reference_date", F.date_add(F.lit("2020-01-06").cast("date"), (F.col("doc_id") % 10).cast("int")))


def test_refit_of_the_best(spark):
    train, valid = (small_table(spark).where(F.col("doc_id") % 2 == i) for i in (0, 1))
    results = SE.search([(train, valid)], [{"trees": 2, "depth": 2}, {"trees": 3, "depth": 3}])
    model = SE.fit_best(results, train, valid)
    assert model.stages[-1].getNumTrees == results[0]["trees"]


def test_expanding_folds(spark):
    df = small_table(spark)
    cutoffs = [dt.date(2020, 1, 9), dt.date(2020, 1, 12)]
    folds = SE.expanding_folds(df, cutoffs)
    assert [(t.count(), v.count()) for t, v in folds] == [(90, 90), (180, 120)]


def test_balanced_classes_weigh_alike(spark):
    df = small_table(spark)
    plain, even = (ML.train_classifier(df, ML.forest(trees=3, depth=1), balanced=b) for b in (False, True))
    rare = [ML.score(m, df).agg(F.avg(F.col("probabilities")[3])).first()[0] for m in (plain, even)]
    assert rare[1] > rare[0]


def test_comparison_has_macro_f1(spark):
    df = small_table(spark)
    got = ML.compare_models(df, df, {"forest": ML.forest(trees=3, depth=4)}).first()
    assert 0 < got["f1_macro"] <= 1 and "forecast_mae_weekly" not in got
    paid = df.withColumn("total_open_amount", F.lit(10.0)).withColumn("invoice_paid", F.date_add("reference_date", F.col("week_bucket") * 7))
    got = ML.compare_models(paid, paid, {"forest": ML.forest(trees=3, depth=4), "small": ML.forest(trees=1, depth=1)}).collect()
    assert len(got) == 2 and all(r["forecast_mae_weekly"] >= 0 and r["reference_dates"] == 10 for r in got)


def test_draws_do_not_build_the_product():
    space = {f"p{i}": list(range(10)) for i in range(10)}
    got = SE.draws(space, 5)
    assert len({tuple(x.items()) for x in got}) == 5 and list(got[0]) == list(space)
    small = {"a": [1, 2], "b": [3, 4, 5]}
    assert SE.draws(small, 10) == SE.grid(small)
