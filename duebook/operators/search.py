"""Parameter search and walk-forward backtests."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from itertools import product
from math import prod

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from duebook import schema
from duebook.operators.forecast import forecast_holdout, mape_score
from duebook.operators.metrics import backtest_aggregate, metric_terms, model_metrics, union_results
from duebook.operators.models import LABEL, assemble_features, forest, score, side_by_side, train_classifier
from duebook.operators.shares import features_read
from duebook.operators.splits import backtest_folds, in_fold
from duebook.session import materialise


@dataclass(frozen=True)
class Uniform:
    """Any number from ``low`` to ``high``, by the inverse of its distribution function."""
    low: float
    high: float

    def at(self, u: float) -> float:
        return self.low + (self.high - self.low) * u


@dataclass(frozen=True)
class LogUniform:
    """Numbers whose logarithm is uniform."""
    low: float
    high: float

    def at(self, u: float) -> float:
        return math.exp(math.log(self.low) + (math.log(self.high) - math.log(self.low)) * u)


@dataclass(frozen=True)
class RandInt:
    """Whole numbers from ``low`` to below ``high``, all alike."""
    low: int
    high: int

    def at(self, u: float) -> int:
        return self.low + int((self.high - self.low) * u)


def draws(space: dict, n: int, seed: int = 42) -> list[dict]:
    """``n`` random parameter sets. A space of lists alone gives no set twice; with distributions every parameter is drawn by itself, lists as well."""
    if any(hasattr(values, "at") for values in space.values()):
        random_ = random.Random(seed)
        return [{name: v.at(random_.random()) if hasattr(v, "at") else v[int(random_.random() * len(v))] for name, v in space.items()} for _ in range(n)]
    total = prod(len(values) for values in space.values())
    picked = range(total) if n >= total else random.Random(seed).sample(range(total), n)
    return [_numbered(space, i) for i in picked]


def _numbered(space: dict[str, list], number: int) -> dict:
    """The set with this number in the order of ``grid``; the product itself is not built."""
    chosen = {}
    for name, values in reversed(space.items()):
        number, at = divmod(number, len(values))
        chosen[name] = values[at]
    return {name: chosen[name] for name in space}


def grid(space: dict[str, list]) -> list[dict]:
    return [dict(zip(space, values)) for values in product(*space.values())]


def prepared(parts: list[tuple[DataFrame, DataFrame]], features: list[str] = schema.MODEL_FEATURES) -> list[tuple[DataFrame, DataFrame]]:
    """The parts with their feature vectors, written once: what is learnt of the preparation comes from the training part of each fold."""
    out = []
    for train, valid in parts:
        train = train.where(F.col(LABEL).isNotNull())
        pipeline = Pipeline(stages=assemble_features(features)).fit(train)
        out.append((materialise(pipeline.transform(train).select("features", F.col(LABEL).cast("double").alias(LABEL)), "fold-train"),
                    materialise(pipeline.transform(valid).select(*valid.columns, "features"), "fold-valid")))
    return out


def counted(parts: list[tuple[DataFrame, DataFrame]], places: list[int], features: list[str] = schema.MODEL_FEATURES) -> list[tuple[DataFrame, DataFrame]]:
    """The parts for learners that read some features only: rows alike in these and the label are one row, with ``_rows``, how many they are.

    The preparation is learnt as in ``prepared``, from the training part of each fold. What is written has no more rows than the part, and few where the features are few and
    whole numbers. Features that no learner reads are 0 in the vectors.
    """
    known = [f"_f{i}" for i in places]
    vector = array_to_vector(F.array(*[F.col(f"_f{i}") if i in places else F.lit(0.0) for i in range(len(features))])).alias("features")

    def count(part: DataFrame, purpose: str) -> DataFrame:
        values = vector_to_array("features")
        alike = part.select(*[values.getItem(i).alias(f"_f{i}") for i in places], LABEL).groupBy(*known, LABEL)
        return materialise(alike.agg(F.count(F.lit(1)).alias("_rows")).select(vector, LABEL, "_rows"), purpose)
    out = []
    for train, valid in parts:
        train = train.where(F.col(LABEL).isNotNull())
        pipeline = Pipeline(stages=assemble_features(features)).fit(train)
        out.append((count(pipeline.transform(train), "fold-train"), count(pipeline.transform(valid), "fold-valid")))
    return out


def search(parts: list[tuple[DataFrame, DataFrame]], candidates: list[dict], make=forest, scoring: str = "log_loss",
           parallelism: int = 4, features: list[str] = schema.MODEL_FEATURES) -> list[dict]:
    """Mean score of every parameter set over the (train, validation) pairs, best first.

    Preparation is fitted once per pair and shared by all candidates; candidates in closed form share counts of the rows that are alike to them. Fits run on the cluster; the driver only holds one thread per running fit and
    one number per result.
    """
    spark, places = parts[0][0].sparkSession, None if scoring == "mape" else features_read([make(**c) for c in candidates])
    ready = prepared(parts, features) if places is None else counted(parts, places, features)

    def one(params: dict) -> dict:
        values = []
        for train, valid in ready:
            if places is not None:
                scored = score(make(**params).setWeightCol("_rows").fit(train), valid)
                term = metric_terms()[scoring]
                values.append(scored.agg((F.sum(term * F.col("_rows")) / F.sum(F.when(term.isNotNull(), F.col("_rows")))).alias("score")).first()["score"])
                continue
            scored = score(make(**params).fit(train), valid)
            measured = mape_score(scored) if scoring == "mape" else model_metrics(scored).select(F.col(scoring).alias("score"))
            values.append(measured.first()["score"])
        mean = sum(values) / len(values)
        return {**params, "score": mean}

    results = side_by_side(spark, one, candidates, parallelism)
    return sorted(results, key=lambda x: x["score"], reverse=scoring != "log_loss")


def random_search(train: DataFrame, valid: DataFrame, space: dict, n: int = 60, seed: int = 42, **options) -> list[dict]:
    """Random draws evaluated on one predefined validation part."""
    return search([(train, valid)], draws(space, n, seed), **options)


def fit_best(results: list[dict], train: DataFrame, valid: DataFrame, make=forest) -> PipelineModel:
    """The first parameter set of a search, fitted on training and validation rows together."""
    params = {k: v for k, v in results[0].items() if k != "score"}
    return train_classifier(train.unionByName(valid), make(**params))


def expanding_folds(df: DataFrame, cutoffs: list, date: str = "reference_date") -> list[tuple[DataFrame, DataFrame]]:
    """Train and validation parts in time order: all rows before a cutoff, and those from it to the next."""
    ends = [*cutoffs[1:], None]
    return [(df.where(F.col(date) < start), df.where((F.col(date) >= start) & (F.lit(True) if stop is None else F.col(date) < stop)))
            for start, stop in zip(cutoffs, ends, strict=True)]


def hash_folds(df: DataFrame, id_columns: list[str], folds: int = 5) -> list[tuple[DataFrame, DataFrame]]:
    """Train and validation parts of a cross validation; the fold of a row depends on its key only."""
    marked = df.withColumn("_fold", F.pmod(F.xxhash64(*id_columns), F.lit(folds)))
    return [(marked.where(F.col("_fold") != i).drop("_fold"), marked.where(F.col("_fold") == i).drop("_fold"))
            for i in range(folds)]


def grid_search(df: DataFrame, space: dict[str, list], id_columns: list[str], folds: int = 5, **options) -> list[dict]:
    return search(hash_folds(df, id_columns, folds), grid(space), **options)


def walk_forward(snapshots: DataFrame, classifier: Estimator | None = None, weeks: int = 6,
                 percentiles: tuple[float, ...] = schema.BACKTEST_PERCENTILES, parallelism: int = 4) -> DataFrame:
    """Model and cash metrics of every cutoff: train up to it, test on the weeks after it.

    One fit per cutoff serves both kinds of metrics. Pass a written snapshot table: it is read twice per cutoff.
    """
    def one(fold: Row) -> DataFrame | None:
        before, after = in_fold(F.lit(fold["cutoff"]), weeks)
        train, test = snapshots.where(before), snapshots.where(after)
        if train.isEmpty() or test.isEmpty():
            return None
        scored = score(train_classifier(train, classifier), test)
        return (forecast_holdout(scored, means=metric_terms())
                .withColumn("percentile", F.lit(fold["percentile"])).withColumn("cutoff", F.lit(fold["cutoff"])))

    folds = sorted(backtest_folds(snapshots, percentiles).collect(), key=lambda r: r["percentile"])
    rows = [x for x in side_by_side(snapshots.sparkSession, one, folds, parallelism) if x is not None]
    if not rows:
        raise ValueError("no cutoff has both training and test rows")
    return union_results(*rows)


def backtest_summary(folds: DataFrame) -> DataFrame:
    return backtest_aggregate(folds, ["log_loss", "top_1_accuracy", "top_2_accuracy",
                                      "forecast_mae_weekly", "forecast_mape_weekly"])
