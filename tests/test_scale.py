"""The parts written for large and skewed data, forced onto their large-data paths, and the shape of plans."""

import math
import os
import random
import subprocess
import sys

import numpy as np
import pyspark
import pytest
from pyspark.sql import functions as F

from duebook.operators import forecast as FC
from duebook.operators import joins as J
from duebook.operators import queue as Q
from duebook.operators import snapshots as S
from duebook.operators.quantiles import Quantile, exact_quantiles
from duebook.operators.retrieval import knn_join, unit_vectors
from duebook.sources import adapter as A


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    rnd = random.Random(3)
    keys = ["hot"] * 300 + ["warm"] * 100 + [None] * 150 + [rnd.choice("abcdef") for _ in range(200)]
    left = spark.createDataFrame([(k, i % 7) for i, k in enumerate(keys)], "k string, x int")
    right = spark.createDataFrame([("hot", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), (None, 5.0)], "k string, y double")
    salted = J.salted_join(left, right, ["k"], how, rows_per_task=20)
    assert "_salt" in salted._jdf.queryExecution().logical().toString()
    def norm(df):
        return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    assert norm(salted) == norm(left.join(right, ["k"], how))


def test_salted_join_rejects_right(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        J.salted_join(df, df, ["id"], "full")


def test_salted_join_spreads_a_hot_key(spark):
    left = spark.range(4000).select(F.lit("hot").alias("k"), F.lit(1).alias("x"))
    right = spark.createDataFrame([("hot", 1.0)], "k string, y double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = J.salted_join(left, right, ["k"], rows_per_task=200)
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 3000


@pytest.mark.parametrize("bins", [2, 50, 4096])
def test_exact_quantiles(spark, bins):
    rnd = np.random.default_rng(5)
    values = np.concatenate([rnd.normal(size=1500), np.full(900, 0.25), rnd.integers(0, 5, 300)]).round(3)
    df = spark.createDataFrame([(float(v), None if i % 3 else float(v) * 2) for i, v in enumerate(values)], "a double, b double")
    b = np.array([v * 2 for i, v in enumerate(values) if i % 3 == 0])
    wanted = [Quantile(f"a{p}", F.col("a"), p) for p in (0.0, 0.33, 0.5, 0.66, 0.999, 1.0)] + [Quantile("b", F.col("b"), 0.5)]
    got = exact_quantiles(df.repartition(7), wanted, bins).first()
    for q in wanted[:-1]:
        assert got[q.name] == pytest.approx(np.quantile(values, q.probability), abs=1e-12)
    assert got["b"] == pytest.approx(np.quantile(b, 0.5), abs=1e-12)


def test_quantiles_far_apart(spark):
    values = [-1.7e308, -1.0, 0.0, 5e-324, 1.0, 1.0, 1.0, 2.0, 1.7e308]
    df = spark.createDataFrame([(v,) for v in values] + [(float("nan"),), (None,)], "a double")
    got = exact_quantiles(df, [Quantile(str(i), F.col("a"), i / 8) for i in range(9)]).first()
    assert [got[str(i)] for i in range(9)] == values


def test_quantiles_read_the_input_twice(spark, monkeypatch):
    """Ten decades of amounts: two passes over the input, and what the second leaves to search is small."""
    from duebook.operators import quantiles
    rnd = np.random.default_rng(8)
    values = np.exp(rnd.uniform(-12, 12, 40_000))
    df = spark.createDataFrame([(float(v),) for v in values], "a double").repartition(4)
    passes, held = [], []
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x
    keep = quantiles.materialise
    monkeypatch.setattr(quantiles, "materialise", lambda t, name: held.append(keep(t, name)) or held[-1])
    once = df.select(counted.asNondeterministic()("a").alias("a"))
    got = exact_quantiles(once, [Quantile(f"p{p}", F.col("a"), p / 100) for p in (1, 33, 50, 99)]).first()
    for p in (1, 33, 50, 99):
        assert got[f"p{p}"] == pytest.approx(np.quantile(values, p / 100), rel=1e-12)
    assert seen.value == 2 * 40_000
    assert held[0].count() < 0.05 * 40_000


def test_a_rank_beside_its_bracket_is_found_still(spark, monkeypatch):
    from duebook.operators import quantiles
    monkeypatch.setattr(quantiles, "_brackets", lambda df, values, asked: [{"n": 100, "low": 0.0, "high": 99.0, "spans": [[10.0, 20.0]]}])
    got = exact_quantiles(spark.range(100).select(F.col("id").cast("double").alias("a")), [Quantile("m", F.col("a"), 0.5)]).first()
    assert got["m"] == 49.5


def test_sketches_of_batches_merge(spark):
    from duebook.operators import sketches as SK
    rows = spark.range(20_000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 700).cast("string").alias("k"), (F.col("id") % 3).alias("b"))
    odd = spark.createDataFrame([(None, None, 0), (float("nan"), "x", 1)], "v double, k string, b long")
    both = rows.unionByName(odd)
    merged = SK.merged_sketches(SK.batch_sketches(both, ["v"], ["k"], F.col("b")))
    facts = {r["column_name"]: r for r in SK.approximate_distinct(merged).collect()}
    assert facts["v"]["present"] == 20_000 and facts["v"]["rows"] == 20_002 and facts["k"]["present"] == 20_001
    assert abs(facts["v"]["distinct_values"] - 20_000) < 0.04 * 20_000 and abs(facts["k"]["distinct_values"] - 701) < 15
    got = {r["probability"]: r["value"] for r in SK.approximate_quantiles(merged, (0.0, 0.25, 0.5, 1.0)).collect()}
    assert got[0.0] == 0.0 and got[1.0] == 19_999.0 and abs(got[0.5] - 10_000) < 200 and abs(got[0.25] - 5000) < 200
    nothing = SK.merged_sketches(SK.batch_sketches(odd.where("false"), ["v"], ["k"], F.col("b")))
    assert nothing.count() == 0
    empty = SK.merged_sketches(SK.batch_sketches(odd, ["v"], [], F.lit(1)))
    assert SK.approximate_quantiles(empty, (0.5,)).count() == 0 and SK.approximate_distinct(empty).first()["distinct_values"] == 0


def test_many_hot_keys_and_a_map_column(spark):
    """3 000 keys above the bound are all split, nulls too, and a column of a type without hash is carried."""
    left = spark.range(60_000).select((F.col("id") % 3001).alias("k"), F.create_map(F.lit("x"), "id").alias("m")) \
        .withColumn("k", F.when(F.col("k") < 3000, F.col("k")))
    right = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    assert J.hot_keys(left, ["k"], 10).count() == 3001
    joined = J.salted_join(left, right, ["k"], rows_per_task=10)
    assert joined.count() == 60_000
    assert joined.where("y is not null and y <> k * 2").count() == 0 and joined.where("y is null").count() == left.where("k is null").count()


def test_quantile_of_few_and_no_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (4.0, None)], "a double, b double")
    got = exact_quantiles(df, [Quantile("a", F.col("a"), 0.5), Quantile("b", F.col("b"), 0.5)]).first()
    assert got["a"] == 2.5 and got["b"] is None


def brute(q, s, k, same=lambda a, b: True):
    out = set()
    for qi, (ql, qv) in q.items():
        d = sorted((sum((x - y) ** 2 for x, y in zip(qv, sv)), si) for si, (sl, sv) in s.items() if same(ql, sl))
        out |= {(qi, si, n + 1) for n, (_, si) in enumerate(d[:k])}
    return out


@pytest.mark.parametrize("fan, block_rows, query_rows", [(1, 1000, 1000), (3, 20, 10), (9, 7, 3), (None, 50, 9)])
@pytest.mark.parametrize("by", [None, "label"])
def test_knn_equals_brute_force(spark, fan, block_rows, query_rows, by):
    rnd = random.Random(7)
    def point(centre):
        return [float(round(centre + rnd.gauss(0, 0.5), 2)) for _ in range(3)]
    s = {i: (rnd.choice("ab"), point(rnd.choice([0, 5, 9]))) for i in range(150)}
    for i in range(150, 230):
        s[i] = ("a", [5.0, 5.0, 5.0])
    s[230] = ("rare", [1.0, 1.0, 1.0])
    q = {i: (rnd.choice(["a", "b", "rare", "none"]), point(rnd.choice([0, 5, 12]))) for i in range(40)}
    q[40] = ("a", [5.0, 5.0, 5.0])
    store = spark.createDataFrame([(i, v, lab) for i, (lab, v) in s.items()], "id long, vector array<double>, label string")
    queries = spark.createDataFrame([(i, v, lab) for i, (lab, v) in q.items()], "query_id long, vector array<double>, label string")
    got = knn_join(queries, store, 4, by=by, fan=fan, block_rows=block_rows, query_rows=query_rows)
    same = (lambda a, b: True) if by is None else (lambda a, b: a == b)
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == brute(q, s, 4, same)


def test_task_functions_need_no_package(spark):
    """Executors may lack the package: the functions sent to them must not refer to it."""
    from pyspark import cloudpickle
    from duebook.operators import retrieval
    for function in (retrieval._nearest_in_block(3), retrieval._centre_distances(np.zeros((2, 2))).func,
                     retrieval._to_cells(["id"]), retrieval._reached(True)):
        code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read()); print('duebook' in sys.modules)"
        done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(function), capture_output=True, cwd="/",
                              env={**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(pyspark.__file__))})
        assert done.returncode == 0 and done.stdout.strip() == b"False", done.stderr


def test_queries_see_few_cells(spark):
    """Clustered vectors: the true distance in the nearest cell leaves a query few other cells, and the count of cells follows the root of the store."""
    from duebook.operators import retrieval
    rnd = np.random.default_rng(3)
    centres = rnd.uniform(-50, 50, (25, 6))
    points = [(i, (centres[i % 25] + rnd.normal(0, 0.5, 6)).tolist()) for i in range(4000)]
    store = spark.createDataFrame(points, "id long, vector array<double>").withColumn("by", F.lit(0))
    queries = spark.createDataFrame([(i, (centres[i % 25] + rnd.normal(0, 0.5, 6)).tolist()) for i in range(200)],
                                    "query_id long, vector array<double>").withColumn("by", F.lit(0))
    cells = retrieval.store_cells(store, 8, 4, 500)
    held = cells.inner.count()
    assert 32 <= held <= 64 and cells.rows.count() == 4000
    home = retrieval.home_cells(queries, cells, 50)
    assert home.count() == 200 and home.select("query_id").distinct().count() == 200
    first = retrieval._in_cells(home, cells.rows, ["by", "outer", "inner"], 4, 500, 50)
    rest = retrieval.other_cells(home, first, cells, 4, 50)
    assert rest.count() <= 200 * held / 8  # of all cells, few lie within reach
    got = knn_join(queries.drop("by"), store.drop("by"), 4, fan=8, block_rows=500, query_rows=50)
    s, q = ({i: ("", v) for i, v in side} for side in (points, [(r["query_id"], r["vector"]) for r in queries.collect()]))
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == brute(q, s, 4)


def test_knn_without_store(spark):
    empty = spark.createDataFrame([], "id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    assert knn_join(queries, empty).count() == 0


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "vector array<double>")
    assert [r["vector"] for r in unit_vectors(df).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_snapshot_plan(spark, folder):
    text = plan(S.snapshot_open_invoices(A.invoices(spark, folder)))
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text and "Join" not in text


def test_feature_plan(spark, folder):
    text = plan(S.build_snapshots(A.invoices(spark, folder)))
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_forecast_plan_has_one_grouping_by_date(spark, folder):
    s = A.scored(S.snapshot_open_invoices(A.invoices(spark, folder)))
    text = plan(FC.forecast_per_reference_date(s))
    assert text.count("Exchange hashpartitioning(reference_date") == 1 and "Python" not in text


def test_top_n_plan(spark, folder):
    s = A.scored(A.invoices(spark, folder, only_paid=False))
    text = plan(Q.top_n_priority(Q.risk_table(s, A.as_of())))
    assert "TakeOrderedAndProject" in text


def test_scan_reads_what_it_needs(spark, folder):
    orders = A.table(spark, folder, "orders")
    text = plan(orders.where("o_totalprice > 10").select("o_custkey"))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,10.0)]" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in text
    assert math.isfinite(orders.count())


def test_scratch_tables_go(spark):
    from duebook.session import materialise, scratch
    with scratch(spark):
        table = materialise(spark.range(10).withColumn("k", F.col("id") % 2), "scratch", partition_by="k")
        assert table.where("k = 1").count() == 5 and sorted(table.columns) == ["id", "k"]
        files = table.inputFiles()
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
