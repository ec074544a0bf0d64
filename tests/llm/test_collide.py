"""Search by counted collisions against all inner products."""

import math

import numpy as np
import pytest

from duebook.llm import collide
from duebook.llm.common import numbered
from duebook.llm.queries import op13_near_vectors
from duebook.session import materialise

SCHEMA = "vec_id long, embedding array<double>, row long, norm string"


def searched(df, k, where="id % 20 = 0"):
    vectors = materialise(numbered(collide.usable(df), "id", "v", "norm"), "vectors")
    return collide.nearest(vectors, vectors.where(where), k)


def good(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def exact(rows, k):
    """For each query row, in order, the best (score, id)."""
    rows = [(i, np.array(v, dtype=float)) for i, v, *_ in rows if good(v)]
    found = []
    for n, (i, v) in enumerate(rows):
        if i is not None and i % 20 == 0:
            scored = [(-float(v @ w), math.inf if j is None else j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v)]
            found.append((i, sorted(scored)[:k]))
    return found


def recall(got, rows, k):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = total = 0
    for i, best in exact(rows, k):
        found = by.get(i, {})
        assert len(found) == len(best)
        for score, j in best:
            total += 1
            if j in found:
                hits += 1
                assert found[j] == pytest.approx(-score, rel=1e-12, abs=1e-12)
    return hits / max(total, 1)


@pytest.mark.parametrize("spread", [False, True])
def test_recall_over_several_blocks(spark, monkeypatch, spread):
    monkeypatch.setattr(collide, "BLOCK", 400)
    monkeypatch.setattr(collide, "GROUP", 30)
    rng = np.random.default_rng(2)
    data = rng.standard_normal((2500, 24)) * (np.exp(rng.standard_normal((2500, 1))) if spread else 1)
    rows = [(i, v.tolist(), i, "clash") for i, v in enumerate(data)]
    got = searched(spark.createDataFrame(rows, SCHEMA), 20).collect()
    assert recall(got, rows, 20) >= 0.95
    for query in {r["query_id"] for r in got}:
        own = sorted((r["rank"], r["score"]) for r in got if r["query_id"] == query)
        assert [r for r, _ in own] == list(range(1, 21)) and all(a >= b for (_, a), (_, b) in zip(own, own[1:]))


def test_query_on_the_small_table(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert recall(op13_near_vectors(spark, folder).collect(), rows, 20) >= 0.95


def test_odd_rows(spark):
    rows = [(i, [float(i % 7), 1.0, -2.0], i, "x") for i in range(60)]
    rows += [(100, None, 0, ""), (120, [1.0, None, 2.0], 0, ""), (140, [float("nan"), 1.0, 1.0], 0, ""), (160, [0.0, 0.0, 0.0], 0, ""),
             (180, [float("inf"), 0.0, 0.0], 0, ""), (200, [], 0, ""), (220, [1.0, 2.0], 0, ""), (None, [9.0, 9.0, -9.0], 0, ""), (20, [6.0, 1.0, -2.0], 0, "")]
    got = searched(spark.createDataFrame(rows, SCHEMA), 5).collect()
    want = exact(rows, 5)
    assert len(got) == sum(len(best) for _, best in want)
    assert not [r for r in got if r["query_id"] == 220]  # no other vector of two dimensions
    for query in (0, 40):
        own = sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == query)
        best = next(b for i, b in want if i == query)
        assert [(s, math.inf if j is None else j) for _, s, j in own] == [(-s, j) for s, j in best]
    assert sum(r["query_id"] == 20 for r in got) == 10  # both rows of the repeated id ask
    assert searched(spark.createDataFrame([], SCHEMA), 5).count() == 0


def test_fewer_candidates_than_asked_for(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist(), 0, "") for i in range(12)]
    got = searched(spark.createDataFrame(rows, SCHEMA), 20).collect()
    assert recall(got, rows, 20) == 1.0


def test_copies_of_one_vector_give_the_least_ids(spark, monkeypatch):
    monkeypatch.setattr(collide, "BLOCK", 100)
    rows = [(i, [1.0, 2.0, 3.0], 0, "") for i in range(600, 0, -1)]
    got = searched(spark.createDataFrame(rows, SCHEMA), 20, "id = 20").collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(i + 1, v, 14.0) for i, v in enumerate([v for v in range(1, 22) if v != 20])]
