"""Forests over blocks of binned rows against MLlib's."""

import os
import random

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from duebook.operators import forests as FO
from duebook.operators import metrics as M
from duebook.operators import models as ML
from duebook.session import shared_folder


def table(spark, rows, values=None, seed=3):
    """Three features, of ``values`` values if given, and a class of four that follows them loosely."""
    rnd = random.Random(seed)
    out = []
    for i in range(rows):
        a, b, c = (rnd.randrange(values) if values else rnd.random() for _ in range(3))
        top = values or 1
        out.append((i, float(a), float(b), float(c), float(min(3, int(2 * a / top) + 2 * (rnd.random() < b / top)))))
    df = spark.createDataFrame(out, "id long, a double, b double, c double, week_bucket double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def trees(model):
    return model.toDebugString.split("\n")[1:]


def learner(kind, **options):
    return kind(labelCol="week_bucket", numTrees=1, maxDepth=5, seed=5, bootstrap=False, featureSubsetStrategy="all", **options)


def test_one_tree_of_all_rows_is_mllibs(spark):
    """Without draws both fit the same tree: bounds, splits, counts and pruning."""
    df = table(spark, 3000, values=9)
    for options in ({}, {"impurity": "entropy", "minInstancesPerNode": 60}, {"minInfoGain": 0.02, "minWeightFractionPerNode": 0.05}):
        ours, theirs = (learner(kind, **options).fit(df) for kind in (FO.BlockForest, RandomForestClassifier))
        assert trees(ours) == trees(theirs), options
        assert isinstance(ours, RandomForestClassificationModel)
        assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray())
        got, want = (dict(m.transform(df).select("id", F.col("probability").cast("string")).collect()) for m in (ours, theirs))
        assert got == want


def test_weights_count_like_repeated_rows(spark):
    df = table(spark, 2000, values=6).withColumn("w", 1.0 + F.col("id") % 3)
    repeated = df.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    assert trees(learner(FO.BlockForest, weightCol="w").fit(df)) == trees(learner(FO.BlockForest).fit(repeated))


def test_forest_is_as_good_as_mllibs(spark):
    df, held = table(spark, 4000), table(spark, 4000, seed=4)
    losses, sizes = [], []
    for kind in (FO.BlockForest, RandomForestClassifier):
        model = kind(labelCol="week_bucket", numTrees=30, maxDepth=6, seed=1, subsamplingRate=0.8).fit(df)
        scored = ML.score(model, held.withColumn("week_bucket", F.col("week_bucket").cast("int")))
        losses.append(M.log_loss(scored).first()["log_loss"])
        sizes.append(model.totalNumNodes)
    assert abs(losses[0] - losses[1]) < 0.03 * losses[1] and 0.8 < sizes[0] / sizes[1] < 1.25


def test_fit_does_not_depend_on_the_size_of_a_pass(spark):
    df = table(spark, 1500).coalesce(1)
    small, large = (ML.forest(trees=2, depth=3).setMaxMemoryInMB(mb).fit(df) for mb in (0, 256))
    assert trees(small) == trees(large)


def test_rows_take_a_byte_a_feature_and_nothing_stays(spark):
    """The rows of a fit do not grow with its trees, and its files go with it."""
    rows = table(spark, 5000).select("a", "b", "c", F.col("week_bucket").alias("label")).toDF("f0", "f1", "f2", "label")
    bounds, classes, total = FO._bounds(rows, 3, 32)
    assert classes == 4 and total == 5000 and all(len(b) <= 31 for b in bounds)
    block = FO._blocks(rows, bounds, False).agg(F.sum(F.length("bins")).alias("bins"), F.sum(F.length("labels")).alias("labels")).first()
    assert (block["bins"], block["labels"]) == (3 * 5000, 2 * 5000)
    before = set(os.listdir(shared_folder(spark)))
    ML.forest(trees=3, depth=3).fit(table(spark, 500))
    assert set(os.listdir(shared_folder(spark))) == before
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_odd_tables(spark):
    """One class, no splits, one value, and no rows."""
    df = table(spark, 50)
    one = ML.forest(trees=2, depth=3).fit(df.withColumn("week_bucket", F.lit(2.0)))
    assert one.totalNumNodes == 2 and one.numClasses == 3
    assert ML.forest(trees=2, depth=0).fit(df).totalNumNodes == 2
    same = VectorAssembler(inputCols=["a"], outputCol="features").transform(df.select(F.lit(1.0).alias("a"), "week_bucket"))
    assert ML.forest(trees=2, depth=3).fit(same).totalNumNodes == 2
    for bad in (df.where("false"), df.withColumn("week_bucket", F.lit(0.5))):
        try:
            ML.forest(trees=1, depth=1).fit(bad)
        except Exception:
            continue
        raise AssertionError("fitted")
