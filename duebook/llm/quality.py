"""Quality of documents by hierarchical empirical Bayes: evidence of the text, prior of its path, prior of its host, global prior."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import ship, slices, whole_text
from duebook.session import materialise

#: Labelled rows that the text classifier is fitted on at most, chosen by a hash of ``doc_id``.
SAMPLE = 20_000
#: Words that speak against a document: at most so many, each in at least so many documents of the sample, with at least this share of bad ones.
LEXICON, LEAST_SEEN, BAD_SHARE = 5_000, 8, 0.6

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "!#$%&*+<=>@[]\\^_`{|}~"]] = True


def features(text: str, lexicon: frozenset[str]) -> list[float]:
    """Shares of symbols, capitals, digits, repeated words and repeated lines, sizes, and words of the lexicon."""
    counts = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    size = max(1, int(counts.sum()))
    capitals, small = int(counts[65:91].sum()), int(counts[97:123].sum())
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    different = len(set(words))
    hits = len(lexicon.intersection(_WORD.findall(text.lower())))
    n = max(1, len(words))
    symbols = float(counts[_SYMBOLS].sum()) / size
    repeats = 1 - different / n if words else 0.0
    expected = 0.09 * max(0.0, math.log(n) - 3)  # texts repeat more words the longer they are
    return [symbols, math.sqrt(symbols), capitals / max(1, capitals + small), float(counts[48:58].sum()) / size,
            repeats, max(0.0, repeats - expected - 0.2), 1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(words)),
            math.log1p(size / n), math.log1p(hits), min(1.0, 5.0 * hits / max(1, different))]


@dataclass(frozen=True)
class Model:
    """Word list, standardisation and weights of the text classifier; ``base`` is the log-odds of good among the rows of the fit."""

    lexicon: frozenset[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float

    def evidence(self, text: str) -> float:
        """Log likelihood ratio of good against bad, between -12 and 12."""
        x = (np.array(features(text, self.lexicon)) - self.mean) / self.scale
        return float(np.clip(x @ self.weights[1:] + self.weights[0] - self.base, -12, 12))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    rows = np.hstack([np.ones((len(x), 1)), x])
    weights, penalty = np.zeros(rows.shape[1]), np.full(rows.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + np.diag(penalty), rows.T @ (y - p) - penalty * weights)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The text classifier. A labelled document is good if its quality is 1 and it is not toxic; rows without a quality label are left out.

    At most ``sample`` labelled rows, an id and a number each, are sent to the tasks that read the texts. One half finds the words, the other the weights, so that words are not weighed where they were
    found. Without both kinds of rows all evidence is 0.
    """
    ship(documents.sparkSession)
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(good.cast("int")).alias("good")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select("doc_id", whole_text().alias("text"))
    one_each = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = materialise(one_each.select("doc_id", "text", "good", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)).alias("half")), "labelled")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [(w, 1 - g) for text, g in zip(part.column("text").to_pylist(), part.column("good").to_pylist(), strict=True)
                     for w in set(_WORD.findall(text.lower()))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())],
                                                 names=["word", "bad"])
    share = rows.where("half = 0").agg(F.avg(1 - F.col("good"))).first()[0] or 0.0
    seen = rows.where("half = 0").select("text", "good").mapInArrow(words, "word string, bad int").groupBy("word").agg(
        F.sum("bad").alias("bad"), F.count("*").alias("n"))
    strength = (F.col("bad") + 5 * share) / (F.col("n") + 5)
    lexicon = frozenset(r["word"] for r in seen.where((F.col("n") >= LEAST_SEEN) & (strength >= BAD_SHARE) & (F.length("word") <= 64))
                        .orderBy(F.desc(strength * F.log1p("n")), "word").limit(LEXICON).collect())

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values = [features(text, lexicon) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("good"), pa.array(values, pa.list_(pa.float64()))], names=["good", "x"])
    got = rows.where("half = 1").select("text", "good").mapInArrow(described, "good int, x array<double>").toPandas()
    y = got["good"].to_numpy(dtype=float) if len(got) else np.zeros(0)
    if not len(y) or y.min() == y.max():
        size = len(features("", frozenset()))
        return Model(lexicon, np.zeros(size), np.ones(size), np.zeros(size + 1), 0.0)
    x = np.array(got["x"].tolist())
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    return Model(lexicon, mean, scale, _fitted((x - mean) / scale, y), _logit(y.mean()))


def _evidence(documents: DataFrame, model: Model):
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def evidence(text: pd.Series) -> pd.Series:
        return text.map(sent.value.evidence)
    return evidence(whole_text())


def _strength(rates: DataFrame, rate: Column, mean: Column) -> float:
    """Rows that a prior is worth: what the rates of groups differ from their mean beyond chance tells how alike groups are."""
    spread = rates.agg(F.avg((rate - mean) ** 2).alias("seen"), F.avg(mean * (1 - mean) / F.col("n")).alias("chance"),
                       F.avg(mean * (1 - mean)).alias("whole")).first()
    if spread["seen"] is None:
        return 1.0
    between = max(spread["seen"] - spread["chance"], 1e-6)
    return float(min(max(spread["whole"] / between - 1, 1.0), 10_000.0))


def priors(evidence: DataFrame) -> tuple[DataFrame, float, float]:
    """``host, path, k, n, host_k, host_n`` and the rows that the global prior and a host's prior are worth.

    ``evidence`` has ``host, path, share``, the chance that the row is good. All sums are grouped aggregates.
    """
    paths = evidence.groupBy("host", "path").agg(F.sum("share").alias("k"), F.count("*").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("k").alias("host_k"), F.sum("n").alias("host_n"))
    both = materialise(paths.join(hosts, "host"), "priors")
    total = both.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    mean = (total["k"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    per_host = both.select("host", "host_k", "host_n").distinct().withColumn("n", F.col("host_n"))
    worth = _strength(per_host, F.col("host_k") / F.col("host_n"), F.lit(mean))
    posterior = (F.col("host_k") + F.lit(worth * mean)) / (F.col("host_n") + F.lit(worth))
    path_worth = _strength(both, F.col("k") / F.col("n"), posterior)
    return both.withColumn("mean", F.lit(mean)), worth, path_worth


def classify(documents: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, keep_at: float = 0.5,
             sample: int = SAMPLE) -> DataFrame:
    """All columns of the input, and ``quality_evidence, quality_host, quality_path, quality_score, quality_keep``.

    The classifier gives each text a log likelihood ratio. Turned into a chance, it counts for the document's host and path; a path is shrunk toward its
    host and a host toward all documents, by as many rows as the differences between groups warrant. A document's prior leaves out its
    own share. The score is the chance from the path's posterior and the document's evidence; ``quality_keep`` is score >= ``keep_at``.
    ``host`` defaults to ``source``, ``path`` to ``lang`` below it; null hosts and paths are groups of their own. Null text is empty;
    repeated rows are classified one by one; an empty table gives an empty result. The five columns take the place of input columns of their names. Where rows
    share a labelled ``doc_id``, one of them is fitted.
    """
    ship(documents.sparkSession)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit(documents, labels, sample)
    added = ("quality_evidence", "quality_host", "quality_path", "quality_score", "quality_keep")
    names = [c for c in documents.columns if c not in added]

    def key(column: Column) -> Column:
        return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), column.cast("string")))
    read = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key(host).alias("host"), key(path).alias("path"),
                            _evidence(documents, model).alias("evidence"))
    base = 1 / (1 + math.exp(-model.base))
    shares = materialise(read.select("host", "path", "evidence"), "evidence").withColumn(
        "share", 1 / (1 + F.exp(-(F.col("evidence") + F.lit(_logit(base))))))
    table, worth, path_worth = priors(shares)
    share = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(_logit(base)))))
    of_host = (F.col("host_k") - share + F.lit(worth) * F.col("mean")) / (F.col("host_n") - 1 + F.lit(worth))
    of_path = (F.col("k") - share + F.lit(path_worth) * F.col("of_host")) / (F.col("n") - 1 + F.lit(path_worth))
    safe = F.least(F.greatest(F.col("of_path"), F.lit(1e-4)), F.lit(1 - 1e-4))
    joined = read.join(table, ["host", "path"]).withColumn("of_host", of_host).withColumn("of_path", of_path)
    score = 1 / (1 + F.exp(-(F.log(safe / (1 - safe)) + F.col("evidence"))))
    return joined.withColumn("score", score).select(
        "row.*", F.col("evidence").alias("quality_evidence"), F.col("of_host").alias("quality_host"), F.col("of_path").alias("quality_path"),
        F.col("score").alias("quality_score"), (F.col("score") >= keep_at).alias("quality_keep"))
