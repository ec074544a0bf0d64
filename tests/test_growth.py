"""Work that must not grow faster than the input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duebook.operators import retrieval


def nearest(queries, store, k):
    q, s = (np.array([v for _, v in side]) for side in (queries, store))
    ids = np.array([i for i, _ in store])
    d = ((q[:, None, :] - s[None, :, :]) ** 2).sum(axis=2)
    return {(queries[i][0], int(ids[j]), n + 1) for i in range(len(q)) for n, j in enumerate(np.lexsort((ids, d[i]))[:k])}


@pytest.mark.parametrize("most", [8, 32])
def test_queries_without_clusters_are_copied_to_few_places(spark, monkeypatch, most):
    """Where balls rule out nothing, a query meets the store by blocks and is not sent to every cell."""
    rnd = np.random.default_rng(5)
    store = [(i, v.tolist()) for i, v in enumerate(rnd.normal(0, 1, (1500, 24)))]
    near_one = [(100 + i, (np.array(store[0][1]) + 1e-3 * rnd.normal(0, 1, 24)).tolist()) for i in range(3)]
    store += [(2000 + i, (np.array(store[0][1]) + 1e-4 * rnd.normal(0, 1, 24)).tolist()) for i in range(30)]
    queries = [(i, v.tolist()) for i, v in enumerate(rnd.normal(0, 1, (60, 24)))] + near_one
    written, keep = {}, retrieval.materialise

    def watched(df, purpose, *rest):
        out = keep(df, purpose, *rest)
        written[purpose] = out.count()
        return out
    monkeypatch.setattr(retrieval, "materialise", watched)
    got = retrieval.knn_join(spark.createDataFrame(queries, "query_id long, vector array<double>"),
                             spark.createDataFrame(store, "id long, vector array<double>"), 4, fan=8, block_rows=500, query_rows=20, cells_a_query=most)
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == nearest(queries, store, 4)
    assert written["knn-rest"] <= most * len(queries) / 4


def test_copies_of_a_vector_do_not_pile_up(spark):
    """Equal vectors at the limit: the least ids win, also among many copies."""
    rnd = random.Random(3)
    points = [[float(rnd.randint(0, 3)) for _ in range(2)] for _ in range(6)]
    store = [(i, points[rnd.randrange(6)]) for i in range(400)]
    queries = [(i, [rnd.random() * 3, rnd.random() * 3]) for i in range(10)]
    for fan in (1, 3):
        got = retrieval.knn_join(spark.createDataFrame(queries, "query_id long, vector array<double>"),
                                 spark.createDataFrame(store, "id long, vector array<double>"), 4, fan=fan, block_rows=150, query_rows=4)
        assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == nearest(queries, store, 4)


def test_prompts_of_many_questions_search_blocks(spark, monkeypatch):
    """Questions are not sent to every cell of the store of chunks, and every invoice keeps its four chunks."""
    from duebook.plans import scripts
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    chunks = spark.createDataFrame([(i, "s", "h", " ".join(rnd.choices([*words, "invoice", "amount", "days"], k=12))) for i in range(600)],
                                   "id long, source string, section_h2 string, text string")
    model = retrieval.text_model(chunks, size=32)
    asked = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("c").alias("cust_number"), (F.col("id") * 10.5).alias("total_open_amount"),
                                   F.lit("2020-01-01").cast("date").alias("due_in_date"), F.col("id").cast("int").alias("days_past_due"))
    copies, keep, join = [], retrieval.materialise, scripts.knn_join

    def watched(df, purpose, *rest):
        out = keep(df, purpose, *rest)
        copies.append((purpose, out.count()))
        return out
    monkeypatch.setattr(retrieval, "materialise", watched)
    monkeypatch.setattr(scripts, "knn_join", lambda q, s, k: join(q, s, k, fan=8, block_rows=300, query_rows=20, cells_a_query=8))
    got = scripts.prepare_prompts(asked, retrieval.embed_text(model, chunks), model)
    assert [len(r["retrieved_sections"]) for r in got.collect()] == [4] * 40
    assert dict(copies)["knn-rest"] <= 8 * 40


def test_a_few_queries_tell_that_balls_do_not_help(spark, monkeypatch):
    """Where they rule out nothing for a trial, the other queries are not sent to cells first."""
    rnd = np.random.default_rng(7)
    store, queries = ([(i, v.tolist()) for i, v in enumerate(rnd.normal(0, 1, (n, 24)))] for n in (900, 80))
    homes, keep = [], retrieval.materialise

    def watched(df, purpose, *rest):
        out = keep(df, purpose, *rest)
        homes.append(out.count() if purpose == "knn-home" else 0)
        return out
    monkeypatch.setattr(retrieval, "materialise", watched)
    got = retrieval.knn_join(spark.createDataFrame(queries, "query_id long, vector array<double>"),
                             spark.createDataFrame(store, "id long, vector array<double>"), 4, fan=8, block_rows=300, query_rows=20, cells_a_query=8, trial_rows=10)
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == nearest(queries, store, 4)
    assert sum(homes) == 10


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e-120, 1e6])
@pytest.mark.parametrize("outlier", [1.0, 1e5])
def test_single_precision_loses_no_neighbour(scale, outlier):
    """Rows that differ by less than single precision tells, and one row far longer than the others."""
    import pandas as pd
    rnd = np.random.default_rng(8)
    s = 1 + 1e-9 * rnd.integers(0, 4, (2500, 16)) + (rnd.random((2500, 1)) < 0.5) * rnd.normal(0, 1, (2500, 16))
    s[7] *= outlier
    s, q = s * scale, np.vstack([1 + 1e-9 * rnd.random((20, 16)), rnd.normal(0, 1, (280, 16))]) * scale
    got = retrieval._nearest_in_block(4)(pd.DataFrame({"query_id": range(300), "vector": list(q)}), pd.DataFrame({"id": range(2500), "vector": list(s)}))
    d = ((q[:, None, :] - s[None, :, :]) ** 2).sum(axis=2)
    want = [(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(2500), d[i]))[:4]]
    assert list(zip(got["query_id"], got["id"])) == want


def test_questions_with_the_same_chunks_share_one_text(spark):
    """The texts of chunks are moved once for each list of chunks that is found, not once for each question."""
    from duebook.plans import scripts
    chunks = spark.createDataFrame([(i, "s", f"h{i}", f"word{i} invoice amount") for i in range(4)], "id long, source string, section_h2 string, text string")
    model = retrieval.text_model(chunks, size=32)
    asked = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("c").alias("cust_number"), (F.col("id") * 10.5).alias("total_open_amount"),
                                   F.lit("2020-01-01").cast("date").alias("due_in_date"), F.col("id").cast("int").alias("days_past_due"))
    seen, keep = [], scripts.build_context
    scripts.build_context = lambda hits: seen.append(hits.count()) or keep(hits)
    try:
        got = scripts.prepare_prompts(asked, retrieval.embed_text(model, chunks), model).collect()
    finally:
        scripts.build_context = keep
    lists = {tuple(r["retrieved_sections"]) for r in got}
    assert len(got) == 30 and all(r["context"].count("[s") == 4 for r in got) and seen == [4 * len(lists)] and len(lists) < 30


def test_medians_read_a_written_table(spark, folder):
    """The medians and the result read snapshots that were written; none of them joins the history anew."""
    from duebook import catalog
    plan = catalog.load()[0]["impute_median"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_training_table_has_what_is_read(spark, folder):
    """Columns that no fit, score or forecast reads are not moved and written with the snapshots."""
    from duebook import schema
    from duebook.catalog import learning
    got = learning.table(spark, folder)
    assert set(got.columns) == {"doc_id", "reference_date", "total_open_amount", "invoice_sent", "invoice_paid", "week_bucket", *schema.MODEL_FEATURES}


def test_forest_keeps_the_node_of_a_row(spark):
    """A level does not walk every row down all trees from the root; the model is the same."""
    from pyspark.ml.feature import VectorAssembler
    from duebook.operators import models as ML
    rnd = random.Random(6)
    rows = [(float(rnd.randint(0, 2)), rnd.random(), rnd.random()) for _ in range(300)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "week_bucket double, a double, b double").coalesce(1))
    learner = ML.forest(trees=5, depth=4)
    assert learner.getCacheNodeIds()
    assert learner.fit(df).toDebugString.split("\n")[1:] == learner.copy().setCacheNodeIds(False).fit(df).toDebugString.split("\n")[1:]


def test_uploads_are_written_by_many_tasks(spark, folder):
    """No task reads all arriving rows to write one file; the later upload still wins."""
    from duebook.catalog import tables
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        _, batch = tables.arrivals(spark, folder)
        assert len(batch.inputFiles()) > 2
        from duebook.operators.history import arrived_last
        first = batch.groupBy("doc_id").agg(F.max("total_open_amount").alias("last"))
        assert arrived_last(batch).join(first, "doc_id").where("total_open_amount <> last").isEmpty()
    finally:
        spark.conf.set(name, "true")


def model_rows(spark, n):
    from duebook import schema
    columns = {c: (F.col("id") % (7 + i)).cast("double") for i, c in enumerate(schema.MODEL_FEATURES)}
    return spark.range(n).select(F.col("id").alias("doc_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("reference_date"),
                                 (F.col("id") % 5).cast("int").alias("week_bucket"), *[v.alias(c) for c, v in columns.items()])


def test_searches_in_closed_form_share_counts(spark, monkeypatch):
    """Rows alike to all candidates are counted once a fold instead of written and read by each; the scores are those of the rows."""
    from duebook.operators import search as SE
    from duebook.operators import shares as SH
    from duebook.operators.models import score
    from duebook.operators.metrics import model_metrics
    df, written, keep = model_rows(spark, 600), [], SE.materialise

    def watched(part, purpose, *rest):
        out = keep(part, purpose, *rest)
        written.append(out.count())
        return out
    monkeypatch.setattr(SE, "materialise", watched)
    fold = (df.where("doc_id < 400"), df.where("doc_id >= 400"))
    got = SE.search([fold], [{"w": 3.0}, {"w": 5.0}], lambda w: SH.cell_shares(10, invoice_age_days=w))
    assert max(written) < 200
    for r in got:
        [(train, valid)] = SE.prepared([fold])
        whole = score(SH.cell_shares(10, invoice_age_days=r["w"]).fit(train), valid)
        assert abs(model_metrics(whole).first()["log_loss"] - r["score"]) < 1e-9


@pytest.mark.parametrize("twice", [False, True])
def test_folds_number_only_the_columns_of_the_order(spark, monkeypatch, twice):
    """Rows are not dealt out to learn their fold, unless equal ones lie on both sides of a border."""
    from duebook.operators import splits as SP
    df = model_rows(spark, 100)
    df = df.unionByName(df.where("doc_id % 2 = 0")) if twice else df
    dealt, keep = [], SP.with_positions
    monkeypatch.setattr(SP, "with_positions", lambda rows, *rest: dealt.append(rows.columns) or keep(rows, *rest))
    got = [r["test_fold"] for r in SP.time_series_rows(df, ["reference_date", "doc_id"]).orderBy("reference_date", "doc_id", "test_fold").collect()]
    n = len(got)
    first = n - 5 * (n // 6)
    assert got == [0 if i < first else (i - first) // (n // 6) + 1 for i in range(n)]
    assert dealt[0] == ["reference_date", "doc_id"] and (twice or len(dealt) == 1)


def test_permutation_deals_out_written_rows(spark, monkeypatch):
    """Dealing out by ranges reads its rows twice, so they are written first."""
    from duebook.operators import models as ML
    plans, keep = [], ML.with_positions
    monkeypatch.setattr(ML, "with_positions", lambda rows, *rest: plans.append(rows.inputFiles()) or keep(rows, *rest))
    moved = ML.permuted(model_rows(spark, 50), ["doc_id", "reference_date"], ["invoice_age_days"], 2)
    assert plans[0] and moved.select("repeat", "position").distinct().count() == 100
