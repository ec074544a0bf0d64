"""Week-of-payment models on MLlib: preparation, training, scoring, calibration, importance."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest)
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook import schema
from duebook.functions import probability as P
from duebook.operators.forecast import forecast_holdout
from duebook.operators.forests import BlockForest
from duebook.operators.metrics import (classification_report, confusion_counts, log_loss_term, macro_f1, metric_terms, model_metrics,
                                       rank_results, report_means, union_results)
from duebook.operators.numbering import shuffled_position, with_positions
from duebook.operators.quantiles import Quantile, exact_quantiles
from duebook.session import materialise

LABEL = "week_bucket"
CLASSES = schema.N_CLASSES


# -- preparation ---------------------------------------------------------------------------------------

class _MedianParams(HasInputCols, HasOutputCols):
    def _columns(self) -> list[tuple[str, str]]:
        return list(zip(self.getInputCols(), self.getOutputCols()))


class ExactMedianImputer(Estimator, _MedianParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fill nulls with the exact median of the training data; MLlib's own imputer only approximates it."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ExactMedianImputerModel:
        row = exact_quantiles(dataset, [Quantile(c, F.col(c), 0.5) for c in self.getInputCols()]).first()
        medians = [float("nan") if row[c] is None else float(row[c]) for c in self.getInputCols()]
        model = ExactMedianImputerModel()
        model._set(inputCols=self.getInputCols(), outputCols=self.getOutputCols(), medians=medians)
        return model


class ExactMedianImputerModel(Model, _MedianParams, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "median of each input column", TypeConverters.toListFloat)

    def getMedians(self) -> list[float]:
        return self.getOrDefault(self.medians)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = [F.coalesce(F.col(i).cast("double"), F.lit(m)).alias(o)
                  for (i, o), m in zip(self._columns(), self.getMedians())]
        return dataset.select("*", *filled)


def impute_median(df: DataFrame, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """Nulls replaced by the median of ``train``, column by column."""
    medians = exact_quantiles(df if train is None else train, [Quantile(c, F.col(c), 0.5) for c in columns])
    found = medians.first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(found[c]).cast("double")) for c in columns})


def impute_categorical(df: DataFrame, columns: list[str], strategy: str = "constant", value: str = "Missing") -> DataFrame:
    """Nulls replaced by a constant or by the most frequent value (the smallest of equally frequent ones)."""
    if strategy == "constant":
        return df.na.fill(value, columns)
    if strategy != "most_frequent":
        raise ValueError(f"unknown strategy {strategy!r}")
    for c in columns:
        top = (df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
               .agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias("top")).scalar())
        df = df.withColumn(c, F.coalesce(F.col(c), top))
    return df


def ordinal_encode(df: DataFrame, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """Categories as codes in alphabetical order, learnt on ``train``; unknown and null get -1."""
    out = [f"{c}_code" for c in columns]
    indexer = StringIndexer(inputCols=columns, outputCols=out, stringOrderType="alphabetAsc", handleInvalid="keep")
    model = indexer.fit(df if train is None else train)
    coded = model.transform(df)
    for o, labels in zip(out, model.labelsArray):
        coded = coded.withColumn(o, F.when(F.col(o) < len(labels), F.col(o)).otherwise(F.lit(-1.0)).cast("int"))
    return coded


def assemble_features(features: list[str] = schema.MODEL_FEATURES) -> list:
    """Stages that impute the features and put them in one vector; other columns do not reach the model."""
    filled = [f"{c}_filled" for c in features]
    return [ExactMedianImputer(inputCols=features, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="features")]


def side_by_side(spark: SparkSession, job: Callable, items: list, threads: int = 4) -> list:
    """Run independent fits at the same time; the driver only waits for the cluster in each thread."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(inheritable_thread_target(spark)(job), items))


# -- training and scoring --------------------------------------------------------------------------------

def forest(trees: int = 100, depth: int = 10, seed: int = 42) -> BlockForest:
    return BlockForest(labelCol=LABEL, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8, cacheNodeIds=True)


def build_model(classifier: Estimator | None = None, features: list[str] = schema.MODEL_FEATURES) -> Pipeline:
    return Pipeline(stages=[*assemble_features(features), classifier or forest()])


def train_classifier(train: DataFrame, classifier: Estimator | None = None,
                     features: list[str] = schema.MODEL_FEATURES, balanced: bool = False) -> PipelineModel:
    """Fit on the labelled rows; only the features and the label travel to the learner.

    ``balanced`` weighs rows by rows / (classes * rows of the class), so that all classes count alike.
    """
    rows = train.where(F.col(LABEL).isNotNull()).select(*features, F.col(LABEL).cast("double").alias(LABEL))
    if balanced:
        counts = {r[LABEL]: r["count"] for r in rows.groupBy(LABEL).count().collect()}
        total = sum(counts.values())
        weight = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, total / (len(counts) * n))])[F.col(LABEL)]
        rows = rows.withColumn("_weight", weight)
        classifier = (classifier or forest()).copy().setWeightCol("_weight")
    return build_model(classifier, features).fit(rows)


def score(model: PipelineModel, df: DataFrame, output: str = "probabilities") -> DataFrame:
    """Seven class probabilities per row, 0 for classes the model has not seen."""
    scored = model.transform(df)
    known = vector_to_array("probability") if "probability" in scored.columns else _vote_share(scored)
    filled = F.concat(known, F.array_repeat(F.lit(0.0), CLASSES))
    return (scored.withColumn(output, F.slice(filled, 1, CLASSES))
            .select(*[F.col(f"`{c}`") for c in df.columns], output))


def _vote_share(scored: DataFrame) -> Column:
    """One-versus-rest margins as probabilities: logistic per class, then normalised."""
    raw = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, y: a + y))


def learners(seed: int = 42) -> dict[str, Estimator]:
    """The learners that are compared."""
    return {
        "random_forest": forest(trees=50, depth=8, seed=seed),
        "decision_tree": DecisionTreeClassifier(labelCol=LABEL, maxDepth=8, seed=seed),
        "logistic_regression": LogisticRegression(labelCol=LABEL, family="multinomial", maxIter=50),
        "naive_bayes": NaiveBayes(labelCol=LABEL, modelType="gaussian"),
        "perceptron": Pipeline(stages=[
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
            MultilayerPerceptronClassifier(labelCol=LABEL, featuresCol="scaled", layers=[len(schema.MODEL_FEATURES), 16, CLASSES],
                                           seed=seed, maxIter=50)]),
        "boosted_trees": OneVsRest(labelCol=LABEL, classifier=GBTClassifier(labelCol=LABEL, maxIter=10, maxDepth=4, seed=seed)),
    }


def compare_models(train: DataFrame, test: DataFrame, candidates: dict[str, Estimator] | None = None) -> DataFrame:
    """One row per learner: model metrics, macro F1 and the metrics of its cash forecast, best log loss first.

    Every model scores the same table, which is written once per learner, as two aggregates read it. Cash metrics need the amounts and payment dates in ``test``.
    """
    chosen = candidates or learners()
    cash = {"total_open_amount", "invoice_paid", "reference_date"} <= set(test.columns)
    kept = [c for c in ("total_open_amount", "invoice_paid", "reference_date", LABEL) if c in test.columns]

    def one(name: str) -> DataFrame:
        scored = materialise(score(train_classifier(train, chosen[name]), test).select(*kept, "probabilities"), "compared")
        measured = forecast_holdout(scored, means=metric_terms()) if cash else model_metrics(scored)
        return measured.crossJoin(F.broadcast(macro_f1(scored))).withColumn("model", F.lit(name))

    return rank_results(union_results(*side_by_side(train.sparkSession, one, list(chosen))), ["log_loss"])


# -- calibration -----------------------------------------------------------------------------------------

def fit_sigmoids(scored: DataFrame, column: str = "probabilities", most: int = 60, tolerance: float = 1e-14) -> dict[int, tuple[float, float]]:
    """Slope and shift of a logistic regression of each class on its own probability, all classes at once.

    Newton steps: one aggregate over the rows gives the gradients, curvatures and losses of all classes that still move. A step that does not lower a class's
    loss is halved. Classes that do not occur, and a table of one class, have no fit. Perfectly separable classes stop once their loss is next to nothing.
    """
    rows = scored.where(F.col(LABEL).isNotNull() & F.col(column).isNotNull())
    shares = {r[LABEL]: r["count"] for r in rows.groupBy(LABEL).count().collect()}
    total = sum(shares.values())
    fits = {int(c): [0.0, math.log(n / (total - n))] for c, n in shares.items() if 0 <= int(c) < CLASSES and n < total}
    best: dict[int, tuple] = {}  # of each class: loss, fit, step that led away from it
    moving = sorted(fits)
    for _ in range(most if moving else 0):
        sums = []
        for c in moving:
            x, y = F.col(column).getItem(c), (F.col(LABEL) == c).cast("double")
            z = x * F.lit(fits[c][0]) + F.lit(fits[c][1])
            p = 1 / (1 + F.exp(-z))
            w = p * (1 - p)
            loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
            sums.append(F.struct(*[F.avg(v).alias(n) for n, v in (("loss", loss), ("gx", (p - y) * x), ("g", p - y), ("xx", w * x * x), ("x", w * x), ("w", w))])
                        .alias(f"c{c}"))
        found = rows.agg(*sums).first()
        still = []
        for c in moving:
            f = found[f"c{c}"]
            if c in best and f["loss"] > best[c][0]:
                step = [v / 2 for v in best[c][2]]
                if max(map(abs, step)) <= 1e-9 * (1 + max(map(abs, best[c][1]))):
                    fits[c] = list(best[c][1])
                    continue
                best[c] = (best[c][0], best[c][1], step)
            else:
                lift = 1e-12 * (f["xx"] + f["w"])
                det = (f["xx"] + lift) * (f["w"] + lift) - f["x"] ** 2
                if det <= 0 or f["loss"] < 1e-9:
                    continue
                step = [((f["w"] + lift) * f["gx"] - f["x"] * f["g"]) / det, ((f["xx"] + lift) * f["g"] - f["x"] * f["gx"]) / det]
                if step[0] * f["gx"] + step[1] * f["g"] < tolerance:
                    continue
                best[c] = (f["loss"], list(fits[c]), step)
            fits[c] = [v - d for v, d in zip(best[c][1], best[c][2])]
            still.append(c)
        moving = still
        if not moving:
            break
    return {c: (v[0], v[1]) for c, v in fits.items()}


def apply_sigmoids(scored: DataFrame, fits: dict[int, tuple[float, float]], column: str = "probabilities") -> DataFrame:
    """Each class's probability through its sigmoid, renormalised per row; classes without a fit keep theirs."""
    parts = [1 / (1 + F.exp(-(F.col(column).getItem(c) * fits[c][0] + fits[c][1]))) if c in fits else F.col(column).getItem(c) for c in range(CLASSES)]
    row = P.added(parts)
    even = F.lit(1.0 / CLASSES)
    return scored.withColumn(column, F.array(*[F.when(row > 0, x / row).otherwise(even) for x in parts]))


def calibrate_sigmoid(scored_valid: DataFrame, scored: DataFrame, column: str = "probabilities") -> DataFrame:
    """Sigmoid calibration of every class on the validation part, which is written once, renormalised per row."""
    valid = materialise(scored_valid.select(F.col(column), F.col(LABEL)), "calibration")
    return apply_sigmoids(scored, fit_sigmoids(valid, column), column)


# -- importance and selection ------------------------------------------------------------------------------

def feature_importance(model: PipelineModel, features: list[str] = schema.MODEL_FEATURES) -> list[tuple[str, float]]:
    """Importance of every feature of a tree model, largest first."""
    weights = model.stages[-1].featureImportances.toArray()
    return sorted(((f, float(w)) for f, w in zip(features, weights)), key=lambda x: (-x[1], x[0]))


def permuted(df: DataFrame, id_columns: list[str], features: list[str], repeats: int, seed: int = 42) -> DataFrame:
    """Every row once per repeat, with ``position``, and as ``_moved`` the features of the row that a permutation of the whole table puts there.

    Positions follow the ids, so a seed gives the same permutation at any partitioning. Rows without label are left out.
    """
    # Written first: dealing the rows out by ranges reads them twice.
    rows = materialise(df.where(F.col(LABEL).isNotNull()).select(*id_columns, *features, LABEL), "permuted")
    rows = with_positions(rows, [F.col(c) for c in (*id_columns, LABEL, *features)])
    total = rows.count()
    each = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    # Each copy asks for the row that moves to its place, so the other side of the join is the table once. Spark does not see that an explode makes a table
    # larger: copies on both sides were sent to the driver to be broadcast.
    source = shuffled_position(F.col("position"), max(total, 1), F.xxhash64(F.lit(seed), F.col("repeat")), back=True)
    there = rows.select(F.col("position").alias("_source"), F.struct(*features).alias("_moved"))
    joined = each.withColumn("_source", source).join(there, "_source")
    return joined.select("repeat", "position", *[c for c in rows.columns if c != "position"], "_moved")


def permutation_importance(model: PipelineModel, df: DataFrame, id_columns: list[str], repeats: int = 10,
                           features: list[str] = schema.MODEL_FEATURES, seed: int = 42) -> DataFrame:
    """Rise of the log loss when one feature is shuffled over the whole table: mean and deviation over the repeats.

    All features and repeats are scored in one plan.
    """
    base = model_metrics(score(model, df.where(F.col(LABEL).isNotNull()))).first()["log_loss"]
    variants = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 *[(F.col("_moved").getField(g) if g == f else F.col(g)).alias(g) for g in features])
        for f in features])).alias("v")
    shuffled = permuted(df, id_columns, features, repeats, seed).select("repeat", LABEL, variants).select("repeat", LABEL, "v.*")
    losses = (score(model, shuffled).groupBy("feature", "repeat")
              .agg(F.avg(log_loss_term(F.col("probabilities"), F.col(LABEL))).alias("loss")))
    return (losses.groupBy("feature").agg((F.avg("loss") - F.lit(base)).alias("importance_mean"),
                                          F.stddev_pop("loss").alias("importance_std"))
            .orderBy(F.desc("importance_mean")))


def recursive_elimination(folds: list[tuple[DataFrame, DataFrame]], features: list[str] = schema.MODEL_FEATURES,
                          classifier: Estimator | None = None, minimum: int = 1) -> list[dict]:
    """Drop the weakest feature step by step; the kept set has the best mean macro F1 over the folds.

    Returns a row per feature: whether it is kept and its ranking (1 for kept features). The medians of a fold do not depend on which features are left, so
    they are learnt once for the fits of all steps; the folds of a step are fitted at the same time. Pass folds of a written table: every fit reads them.
    """
    left, dropped, trail = list(features), [], []
    filled = {f: f"{f}_filled" for f in features}
    ready = []
    for train, test in folds:
        train = train.where(F.col(LABEL).isNotNull()).select(*features, F.col(LABEL).cast("double").alias(LABEL))
        imputer = ExactMedianImputer(inputCols=features, outputCols=list(filled.values())).fit(train)
        ready.append((imputer.transform(train), imputer.transform(test).select(*filled.values(), LABEL)))

    def one(fold: tuple[DataFrame, DataFrame]) -> tuple[float, np.ndarray]:
        train, test = fold
        model = Pipeline(stages=[VectorAssembler(inputCols=[filled[f] for f in left], outputCol="features"), classifier or forest(20, 6)]).fit(train)
        means = report_means(classification_report(confusion_counts(score(model, test)))).first()
        return means["macro_f1"], model.stages[-1].featureImportances.toArray()

    while True:
        found = side_by_side(folds[0][0].sparkSession, one, ready)
        weights = sum(w for _, w in found)
        trail.append((float(np.mean([f1 for f1, _ in found])), list(left)))
        if len(left) <= minimum:
            break
        weakest = left[int(np.argmin(weights))]
        left.remove(weakest)
        dropped.append(weakest)
    kept = max(trail, key=lambda t: (t[0], -len(t[1])))[1]
    gone = [f for f in reversed(dropped) if f not in kept]
    return [{"feature": f, "selected": f in kept, "ranking": 1 if f in kept else 2 + gone.index(f)} for f in features]


def vif(df: DataFrame, features: list[str]) -> list[tuple[str, float]]:
    """Variance inflation factor of each feature, without an intercept; infinite where the others give it exactly.

    One aggregate gives the matrix of products; only that small square matrix reaches the driver.
    """
    cells = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    complete = df.select(*[F.col(f).cast("double") for f in features]).na.drop()
    row = complete.agg(*[F.sum(F.col(features[i]) * F.col(features[j])).alias(f"g_{i}_{j}") for i, j in cells]).first()
    gram = np.zeros((len(features), len(features)))
    for i, j in cells:
        gram[i, j] = gram[j, i] = row[f"g_{i}_{j}"] or 0.0
    size = np.sqrt(np.diag(gram))
    scaled = gram / np.where(size > 0, size, 1)[:, None] / np.where(size > 0, size, 1)[None, :]
    out = []
    for i, f in enumerate(features):
        others = [j for j in range(len(features)) if j != i]
        explained = scaled[i, others] @ np.linalg.pinv(scaled[np.ix_(others, others)], rcond=1e-12, hermitian=True) @ scaled[others, i]
        rest = 1 - explained
        out.append((f, float("nan") if size[i] == 0 else float("inf") if rest < 1e-10 else float(1 / rest)))
    return out
