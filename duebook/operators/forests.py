"""Random forests fitted level by level over blocks of binned rows."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.session import remove, run_folder

#: Rows of a block, and nodes whose counts travel in one row.
BLOCK, NODES = 1 << 16, 64
#: Ranks of the quantiles that bound the bins are off by at most the rows divided by this.
ACCURACY = 10_000
#: A bin that no row is beyond, as bound of leaves.
NEVER = 1 << 16
#: Parameters that the trees of a forest do not have.
FOREST_ONLY = ("bootstrap", "featureSubsetStrategy", "numTrees", "subsamplingRate")


class BlockForest(RandomForestClassifier):
    """MLlib's random forest with another way to fit it: same parameters, method and kind of model, other random draws.

    MLlib holds every row with a number per tree for the bag and one for its node, some 900 bytes a row at 100 trees, and adds a row to all trees at once, in a
    table too large for caches. Here a row is written once, as a byte per feature. Each level is one pass over these blocks, tree by tree: the bag of a block and a
    tree follows from their numbers and the seed, a row's node from walking it down. Tasks send counts per node, which other tasks add up and split.
    The bounds of bins are quantiles of all rows (weights do not move them) where MLlib takes those of some 10 000. Nominal features are left to MLlib.
    """

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        described = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        if "nominal" in described or "binary" in described:
            return super()._fit(dataset)
        spark = dataset.sparkSession
        weight = self.getWeightCol() if self.isDefined("weightCol") and self.getWeightCol() else None
        size = len(dataset.select(self.getFeaturesCol()).first()[0]) if not described else sum(map(len, described.values()))
        values = vector_to_array(self.getFeaturesCol())
        rows = dataset.select(*[values.getItem(i).alias(f"f{i}") for i in range(size)], F.col(self.getLabelCol()).cast("double").alias("label"),
                              *([F.col(weight).cast("double").alias("weight")] if weight else []))
        bounds, classes, total = _bounds(rows, size, self.getMaxBins())
        shape = (size, max(map(len, bounds), default=0) + 1, classes + (weight is not None))
        path = run_folder(spark, "forest-blocks")
        try:
            blocks = _blocks(rows, bounds, weight is not None)
            blocks.repartition(max(spark.sparkContext.defaultParallelism, 8)).write.parquet(path)
            nodes = _grow(spark.read.schema(blocks.schema).parquet(path), self, shape, total, weight is not None)
        finally:
            remove(spark, path)
        return _model(spark, self, _pruned(nodes), bounds, classes)


def _bounds(rows: DataFrame, size: int, bins: int) -> tuple[list[np.ndarray], int, float]:
    """Upper bounds of the bins of each feature, number of classes, sum of the weights."""
    names = [f"f{i}" for i in range(size)]
    weights = F.sum("weight") if "weight" in rows.columns else F.count(F.lit(1))
    ranks = F.lit([i / bins for i in range(1, bins)])
    found = rows.agg(F.max("label").alias("last"), F.count_if((F.col("label") < 0) | (F.col("label") != F.floor("label"))).alias("wrong"), weights.alias("total"),
                     *[F.approx_count_distinct(c).alias(f"n_{c}") for c in names],
                     *[F.percentile_approx(c, ranks, F.lit(ACCURACY)).alias(c) for c in names]).first()
    if found["last"] is None:
        raise ValueError("no rows to fit a forest on")
    if found["wrong"]:
        raise ValueError(f"{found['wrong']} labels are not whole numbers from 0 on")
    bounds = {c: np.unique(found[c]) for c in names}
    few = [c for c in names if found[f"n_{c}"] <= 2 * bins]
    if few:
        listed = rows.agg(*[F.collect_set(c).alias(c) for c in few]).first()
        for c in few:
            each = np.sort(listed[c])
            if len(each) <= bins:
                bounds[c] = (each[:-1] + each[1:]) / 2
    return [bounds[c] for c in names], int(found["last"]) + 1, float(found["total"] or 0)


def _blocks(rows: DataFrame, bounds: list[np.ndarray], weighted: bool) -> DataFrame:
    """Rows in blocks: number of the block, bins by row and feature, labels and weights as bytes."""
    kind, block = np.uint8 if max(map(len, bounds), default=0) < 255 else np.uint16, BLOCK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held: list) -> pa.RecordBatch:
            bins, labels, weights = (b"".join(x) for x in zip(*held))
            return pa.RecordBatch.from_pydict({"bins": pa.array([bins], pa.binary()), "labels": pa.array([labels], pa.binary()),
                                               "weights": pa.array([weights], pa.binary())})
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                bins = np.empty((part.num_rows, len(bounds)), kind)
                for i, b in enumerate(bounds):
                    bins[:, i] = np.searchsorted(b, part.column(i).to_numpy(zero_copy_only=False), side="left")
                labels = part.column(len(bounds)).to_numpy(zero_copy_only=False).astype(np.uint16)
                held.append((bins.tobytes(), labels.tobytes(), part.column(len(bounds) + 1).to_numpy(zero_copy_only=False).tobytes() if weighted else b""))
                n += part.num_rows
                if n >= block:
                    yield row(held)
                    held, n = [], 0
        if n:
            yield row(held)
    return rows.mapInArrow(cut, "bins binary, labels binary, weights binary").withColumn("block", F.monotonically_increasing_id())


def _bag(rate: float, bootstrap: bool) -> np.ndarray:
    """How often a row is in a tree's bag, for each value of 16 random bits: Poisson with the rate as mean, without ``bootstrap`` once or not."""
    if not bootstrap:
        return (np.arange(65536) < rate * 65536).astype(np.uint8)
    most = int(20 + 10 * rate)
    terms = np.exp([k * math.log(rate) - rate - math.lgamma(k + 1) for k in range(most)])
    return np.searchsorted(np.cumsum(terms), (np.arange(65536) + 0.5) / 65536).astype(np.uint8 if most < 256 else np.uint16)


def _subset(strategy: str, size: int, trees: int) -> int:
    """How many features a node may choose from, as MLlib reads the strategy."""
    named = {"all": size, "sqrt": math.ceil(math.sqrt(size)), "log2": max(1, math.ceil(math.log2(size))), "onethird": math.ceil(size / 3)}
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt"
    if strategy in named:
        return named[strategy]
    return min(int(strategy), size) if strategy.isdigit() else math.ceil(float(strategy) * size)


def _counts(walk: tuple[np.ndarray, ...], level: int, ranges: dict[int, tuple[int, int]], offered: np.ndarray, seed: int, bag: np.ndarray,
            shape: tuple[int, int, int], weighted: bool) -> Callable:
    """Task function: counts by node, feature, bin and class over a task's blocks, ``NODES`` nodes in a row.

    ``walk`` has feature, bin and left child of every node, and its place among those counted now (-1: not counted); ``ranges`` has the places of each tree's,
    ``offered`` the features that each may choose from. With weights, one class more counts the rows themselves.
    """
    size, bins, classes = shape
    per_row, kind = NODES, np.float64 if weighted else np.uint32
    feature, bound, left, place = walk
    k = offered.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((k, (b - a) * bins * classes), kind) for t, (a, b) in ranges.items()}
        seen = False
        for batch in batches:
            for number, block, marks, weights in zip(*(batch.column(c).to_pylist() for c in ("block", "bins", "labels", "weights"))):
                seen = True
                labels = np.frombuffer(marks, np.uint16).astype(np.int64)
                n = len(labels)
                flat = np.frombuffer(block, np.uint8 if len(block) == n * size else np.uint16)
                weight = np.frombuffer(weights, np.float64) if weighted else None
                for tree, (a, b) in ranges.items():
                    drawn = bag.take(np.frombuffer(np.random.Generator(np.random.SFC64([seed, number, tree])).bytes(2 * n), np.uint16))
                    rows = np.flatnonzero(drawn)
                    base = rows * size
                    node = np.full(len(rows), tree)
                    for _ in range(level):
                        right = flat.take(base + feature.take(node)) > bound.take(node)
                        node = left.take(node) + right
                    slot = place.take(node)
                    if len(slot) and slot.min() < 0:
                        kept = slot >= 0
                        rows, base, slot = rows[kept], base[kept], slot[kept]
                    label, often = labels.take(rows), drawn.take(rows).astype(np.float64)
                    amount = often * weight.take(rows) if weighted else often
                    own, cells = (slot - a) * bins, sums[tree].shape[1]
                    for j in range(k):
                        at = (own + flat.take(base + offered[:, j].take(slot))) * classes
                        found = np.bincount(at + label, amount, cells)
                        if weighted:
                            found += np.bincount(at + (classes - 1), often, cells)
                        sums[tree][j] += found.astype(kind)
        for tree in list(sums) if seen else []:
            cells = sums.pop(tree).reshape(k, -1, bins, classes)
            for at in range(0, cells.shape[1], per_row):
                yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "part": pa.array([at // per_row], pa.int32()),
                                                  "cells": pa.array([cells[:, at:at + per_row].tobytes()], pa.binary())})
    return run


def _splits(shape: tuple[int, int, int], offered: int, weighted: bool, entropy: bool, least: tuple[int, float]) -> Callable:
    """Task function: adds the counts of all tasks and gives, for each node, the best of its splits: place of the feature, bin, gain, counts and those on the left."""
    _, bins, classes = shape
    kind = np.float64 if weighted else np.uint32

    def impurity(c: np.ndarray, total: np.ndarray) -> np.ndarray:
        p = c / np.maximum(total, 1e-300)[..., None]
        return -np.sum(p * np.log2(np.where(p > 0, p, 1)), axis=-1) if entropy else 1 - np.sum(p * p, axis=-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for tree, part, cells in zip(*(batch.column(c).to_pylist() for c in ("tree", "part", "cells"))):
                found = np.frombuffer(cells, kind).reshape(offered, -1, bins, classes)
                if (tree, part) in sums:
                    sums[tree, part] += found
                else:
                    sums[tree, part] = found.astype(np.float64)
        for (tree, part), cells in sums.items():
            real = classes - weighted
            left = np.cumsum(cells, axis=2)
            whole = left[0, :, -1]
            right = whole[None, :, None] - left
            rows = [x[..., -1] if weighted else x.sum(axis=-1) for x in (left, right)]
            weight = [x[..., :real].sum(axis=-1) for x in (left, right)]
            total = whole[:, :real].sum(axis=-1)
            share = [w / np.maximum(total, 1e-300)[None, :, None] for w in weight]
            gain = impurity(whole[:, :real], total)[None, :, None] - share[0] * impurity(left[..., :real], weight[0]) - share[1] * impurity(right[..., :real], weight[1])
            allowed = (np.minimum(*rows) >= max(least[0], 1)) & (np.minimum(*weight) >= least[1])
            gain = np.where(allowed, gain, -np.inf).transpose(1, 0, 2)
            best = gain.reshape(len(gain), -1).argmax(axis=1)
            place, bound = np.divmod(best, bins)
            at = np.arange(len(gain))
            out = np.concatenate([np.stack([place, bound, gain[at, place, bound]], axis=1), whole, left[place, at, bound]], axis=1)
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "part": pa.array([part], pa.int32()), "best": pa.array([out.tobytes()], pa.binary())})
    return run


def _grow(blocks: DataFrame, learner: RandomForestClassifier, shape: tuple[int, int, int], total: float, weighted: bool) -> dict[str, np.ndarray]:
    """The nodes of all trees, level by level, so children come after their parents; the first nodes are the roots, and a leaf is its own left child.

    A pass counts as many nodes as fit ``maxMemoryInMB`` in a task. The driver keeps the nodes and gets one row of numbers for each.
    """
    seed, n_trees, depth = learner.getSeed() & (2 ** 63 - 1), learner.getNumTrees(), learner.getMaxDepth()
    size, bins, counts = shape
    k = _subset(learner.getFeatureSubsetStrategy(), size, n_trees)
    bag = _bag(learner.getSubsamplingRate(), learner.getBootstrap())
    least = (learner.getMinInstancesPerNode(), learner.getMinWeightFractionPerNode() * total)
    task = _splits(shape, k, weighted, learner.getImpurity() == "entropy", least)
    at_once = max(1, int(learner.getMaxMemoryInMB() * 2 ** 20 / (8 * k * bins * counts)))
    at = np.arange(n_trees)
    nodes = {"tree": at.copy(), "level": at * 0, "feature": at * 0, "bin": at * 0 + NEVER, "left": at.copy(), "gain": np.zeros(n_trees), "stats": np.zeros((n_trees, counts))}
    active = at  # counted at this level, in the order of the trees
    for level in range(max(depth, 1)):
        offered = np.random.default_rng([seed, level]).random((len(active), size)).argsort(axis=1)[:, :k]
        found = np.zeros((len(active), 3 + 2 * counts))
        for start in range(0, len(active), at_once):
            now = active[start:start + at_once]
            place = np.full(len(nodes["tree"]), -1, np.int64)
            place[now] = np.arange(len(now))
            trees, first = np.unique(nodes["tree"][now], return_index=True)
            ranges = {int(t): (int(a), int(b)) for t, a, b in zip(trees, first, [*first[1:], len(now)])}
            walk = (nodes["feature"], nodes["bin"], nodes["left"], place)
            counted = blocks.mapInArrow(_counts(walk, level, ranges, offered[start:start + at_once], seed, bag, shape, weighted), "tree int, part int, cells binary")
            for r in counted.repartition("tree", "part").mapInArrow(task, "tree int, part int, best binary").collect():
                a, b = ranges[r["tree"]]
                rows = slice(start + a + r["part"] * NODES, start + min(b, a + (r["part"] + 1) * NODES))
                found[rows] = np.frombuffer(r["best"]).reshape(-1, found.shape[1])
        gain, whole, less = found[:, 2], found[:, 3:3 + counts], found[:, 3 + counts:]
        if level == 0:
            nodes["stats"] = whole
        split = (gain > 0) & (gain >= learner.getMinInfoGain()) & (level < depth)
        parents, n = active[split], int(split.sum())
        if not n:
            break
        nodes["feature"][parents] = offered[split][np.arange(n), found[split, 0].astype(int)]
        nodes["bin"][parents], nodes["gain"][parents] = found[split, 1].astype(int), gain[split]
        nodes["left"][parents] = len(nodes["tree"]) + 2 * np.arange(n)
        own = len(nodes["tree"]) + np.arange(2 * n)
        stats = np.stack([less[split], whole[split] - less[split]], axis=1).reshape(-1, counts)
        made = {"tree": nodes["tree"][parents].repeat(2), "level": own * 0 + level + 1, "feature": own * 0, "bin": own * 0 + NEVER, "left": own.copy(),
                "gain": np.zeros(2 * n), "stats": stats}
        nodes = {name: np.concatenate([values, made[name]]) for name, values in nodes.items()}
        mixed = (stats[:, :counts - weighted] > 0).sum(axis=1) > 1
        active = own[mixed & (level + 1 < depth)]
        if not len(active):
            break
    stats = nodes["stats"]
    return nodes | {"rows": stats[:, -1] if weighted else stats.sum(axis=1), "stats": stats[:, :counts - weighted]}


def _pruned(nodes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The trees as MLlib leaves them: splits into two leaves of one prediction become leaves, from the bottom up. Trees stand one after the other.

    ``left`` is a number within the tree, -1 at leaves; the right child follows the left one.
    """
    best = nodes["stats"].argmax(axis=1)
    left = np.where(nodes["left"] == np.arange(len(best)), -1, nodes["left"])
    levels = [np.flatnonzero(nodes["level"] == i) for i in range(nodes["level"].max() + 1)]
    for at in levels[::-1]:
        at = at[left[at] >= 0]
        one, two = left[at], left[at] + 1
        left[at[(left[one] < 0) & (left[two] < 0) & (best[one] == best[two])]] = -1
    kept = nodes["level"] == 0
    for at in levels:
        at = at[kept[at] & (left[at] >= 0)]
        kept[left[at]] = kept[left[at] + 1] = True
    order = np.flatnonzero(kept)
    order = order[np.argsort(nodes["tree"][order], kind="stable")]
    tree = nodes["tree"][order]
    number = np.zeros(len(best), np.int64)
    number[order] = np.arange(len(order)) - np.searchsorted(tree, tree)
    out = {name: values[order] for name, values in nodes.items()}
    return out | {"id": number[order], "left": np.where(left[order] < 0, -1, number[left[order]])}


def _impurity(counts: np.ndarray, entropy: bool) -> np.ndarray:
    p = counts / np.maximum(counts.sum(axis=-1), 1e-300)[..., None]
    return -np.sum(p * np.log2(np.where(p > 0, p, 1)), axis=-1) if entropy else 1 - np.sum(p * p, axis=-1)


def _model(spark: SparkSession, learner: RandomForestClassifier, nodes: dict[str, np.ndarray], bounds: list[np.ndarray],
           classes: int) -> RandomForestClassificationModel:
    """MLlib's model of the trees, read from files in the form that it saves and loads."""
    def facts(kind: str, uid: str, given: dict, **more) -> str:
        usual = {p.name: v for p, v in learner._defaultParamMap.items() if kind.startswith("Random") or p.name not in FOREST_ONLY}
        return json.dumps({"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                           "paramMap": given, "defaultParamMap": usual, **more})
    given = {p.name: v for p, v in learner._paramMap.items()}
    of_tree = {name: v for name, v in given.items() if name in ("featuresCol", "labelCol", "maxDepth", "seed")}
    leaf, n_trees = nodes["left"] < 0, learner.getNumTrees()
    bound = [[] if end else [float(bounds[f][b])] for end, f, b in zip(leaf, nodes["feature"], nodes["bin"])]
    table = pa.table({
        "treeID": pa.array(nodes["tree"], pa.int32()), "id": pa.array(nodes["id"], pa.int32()), "prediction": nodes["stats"].argmax(axis=1).astype(float),
        "impurity": _impurity(nodes["stats"], learner.getImpurity() == "entropy"), "impurityStats": pa.array(list(nodes["stats"]), pa.list_(pa.float64())),
        "rawCount": np.rint(nodes["rows"]).astype(np.int64), "gain": np.where(leaf, -1.0, nodes["gain"]), "leftChild": pa.array(nodes["left"], pa.int32()),
        "rightChild": pa.array(np.where(leaf, -1, nodes["left"] + 1), pa.int32()), "featureIndex": pa.array(np.where(leaf, -1, nodes["feature"]), pa.int32()),
        "leftCategoriesOrThreshold": pa.array(bound, pa.list_(pa.float64())), "numCategories": pa.array(np.full(len(leaf), -1), pa.int32())})
    names = table.column_names
    path = run_folder(spark, "forest")
    split = F.struct(*names[9:]).alias("split")
    try:
        spark.createDataFrame(table).select("treeID", F.struct(*names[1:9], split).alias("nodeData")).write.parquet(f"{path}/data")
        trees = [(t, facts("DecisionTreeClassificationModel", f"dtc_{uuid.uuid4().hex[:12]}", of_tree), 1.0) for t in range(n_trees)]
        spark.createDataFrame(trees, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
        whole = facts("RandomForestClassificationModel", learner.uid, given, numFeatures=len(bounds), numClasses=classes, numTrees=n_trees)
        spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        return RandomForestClassificationModel.load(path)
    finally:
        remove(spark, path)
