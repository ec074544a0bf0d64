"""Mixing, top-k search, WARC, quality, pipeline."""

import gzip
import json
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from duebook.llm import mixing, quality, queries, topk, warc
from duebook.llm.common import numbered
from duebook.session import materialise, run_folder

PYTHON_NODES = ("Python", "Arrow", "Pandas")


def naive_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(documents, near):
    rows = documents.collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    targets = naive_targets(sizes)
    mixed = documents.select("doc_id", "source").distinct()
    got = mixing.mix(documents)
    assert not any(n in got._jdf.queryExecution().toString() for n in PYTHON_NODES)
    found = got.collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        source = min((s for s in targets if math.isclose(targets[s], r["target"], rel_tol=1e-9, abs_tol=1e-9) and sizes[s] == r["source_size"]),
                     key=str)
        by[source] = by.get(source, 0) + r["taken"]
    for source, taken in by.items():
        assert abs(taken - targets[source]) <= near(targets[source]), (source, taken, targets[source])
    again = sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in mixing.mix(documents.repartition(3)).collect())
    assert again == sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in found)
    return mixed


def test_mix_of_the_small_tables(spark, folder):
    check_mix(spark.read.parquet(f"{folder}/documents.parquet"), lambda t: 0.05 * t)


def test_mix_of_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 1)
    check_mix(odd, lambda t: 3000)  # one text is nearly all of its source
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd.where("text IS NULL OR trim(text) = ''")).agg({"taken": "sum"}).first()[0] == 0


def test_large_cells_lose_no_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 50)
    monkeypatch.setattr(mixing, "REPEATS", 300)
    text = "w " * 10
    rows = [(None if i % 3 else i, text, "a") for i in range(3000)] + [(10_000 + i // 2, text, "b") for i in range(5316)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(documents).groupBy("source_size", "target").agg({"taken": "sum", "copies": "min", "*": "count"}).collect()
    assert {(r["source_size"], r["count(1)"]) for r in found} == {(30_000, 3000), (53_160, 5316)}
    for r in found:
        assert abs(r["sum(taken)"] - r["target"]) <= 5


def test_targets_stop_at_the_bound(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300, "ä": 40}
    cells = spark.createDataFrame([("n" if s is None else "a" + s, n, 1) for s, n in sizes.items()], "key string, size long, n long")
    got = {r["key"]: r["target"] for r in mixing.source_targets(cells).collect()}
    expected = naive_targets(sizes)
    assert all(math.isclose(got["n" if s is None else "a" + s], expected[s]) for s in sizes)


def test_balance_solves_the_dual(spark):
    draw = random.Random(1)
    sizes = {("a" + k): [draw.randint(1, 900) for _ in range(40)] for k in "xyz"}
    cells = spark.createDataFrame([(k, s, 1) for k, v in sizes.items() for s in v], "key string, size long, n long").groupBy("key", "size").agg({"n": "sum"}) \
        .withColumnRenamed("sum(n)", "n")
    wanted = {"ax": 0.2, "ay": 2.9, "az": 3.0}
    targets = spark.createDataFrame([(k, sum(v), wanted[k] * sum(v)) for k, v in sizes.items()], "key string, source_size long, target double")
    for r in mixing.balance(cells, targets).collect():
        rates = [min(3.0, math.exp(r["tilt"] * s / r["mean"])) for s in sizes[r["key"]]]
        assert math.isclose(sum(s * x for s, x in zip(sizes[r["key"]], rates, strict=True)), r["target"], rel_tol=1e-6)


def test_apply_mix(odd):
    mixed = mixing.mix(odd)
    out = mixing.apply_mix(odd, mixed)
    assert out.columns == odd.columns
    assert out.count() == mixed.agg({"copies": "sum"}).first()[0]


LAST = 2 ** 63 - 1


def naive_top(rows, k, scale=64):
    """Every row whose id is divisible by 20 against every other row; null ids come last among equals."""
    kept = [(n, i, [math.floor(scale * x) for x in v]) for n, (i, v) in enumerate(rows)
            if v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    out = []
    for n, q, a in kept:
        if q is not None and q % 20 == 0:
            scored = sorted((-max(-LAST, min(LAST, sum(x * y for x, y in zip(a, v, strict=True)))), math.inf if i is None else i)
                            for m, i, v in kept if m != n and len(v) == len(a))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def top_of(spark, rows, where, k=20):
    vectors = materialise(numbered(topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "id", "v"), "vectors")
    found = topk.top_k(vectors, vectors.where(where), k).collect()
    return sorted((r["query_id"], r["rank"], math.inf if r["vec_id"] is None else r["vec_id"], r["score"]) for r in found)


@pytest.mark.parametrize("spread", [1.0, 3000.0, 1e6, 1e12])
def test_top_k(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    monkeypatch.setattr(topk, "QUERIES", 4)
    draw = random.Random(7)
    rows = [(i, [draw.gauss(0, spread) if i % 7 else float(i % 3) for _ in range(24)]) for i in range(200)]
    rows += [(900, None), (901, [None] * 24), (902, [float("nan")] * 24), (903, [float("inf")] * 24), (None, [1.0] * 24), (920, [1.0, 2.0]), (921, [2.0, 1.0]),
             (940, []), (55, rows[55][1]), (60, rows[60][1]), (40, rows[41][1]), (40, [9.0 * spread] * 24), (None, rows[60][1])]
    assert top_of(spark, rows, "id % 20 = 0") == naive_top(rows, 20)


def test_top_k_of_few_or_none(spark):
    assert top_of(spark, [(0, [1.0]), (1, [2.0]), (2, [-2.0])], "id = 0") == [(0, 1, 1, 8192), (0, 2, 2, -8192)]
    assert top_of(spark, [(0, [1.0])], "false") == [] and top_of(spark, [], "true") == []
    repeated = [(20, [1.0]), (20, [3.0]), (None, [9.0])]
    assert top_of(spark, repeated, "id % 20 = 0") == naive_top(repeated, 20) and len(naive_top(repeated, 20)) == 4


def test_columns_of_any_name(spark, odd):
    """Columns that an operator adds take the place of such columns; all others stay."""
    documents = spark.createDataFrame([(i, "good words here " * (i % 5 + 1), "en", "s", i * 3) for i in range(40)],
                                      "doc_id long, text string, lang string, source string, x long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    clashing = documents.selectExpr("*", "x AS quality_score", "x AS quality_keep", "x AS host", "x AS share", "x AS row")
    got = quality.classify(clashing, labels)
    assert sorted(got.columns) == sorted(set(got.columns)) and {r["host"] for r in got.collect()} == {3 * i for i in range(40)}
    plain = {r["doc_id"]: r["quality_score"] for r in quality.classify(documents, labels).collect()}
    assert {r["doc_id"]: r["quality_score"] for r in got.collect()} == plain
    mixed = mixing.mix(documents)
    named = documents.selectExpr("*", "x AS _m", "x AS _id", "x AS _n", "x AS copies", "x AS row", "x AS own")
    out = mixing.apply_mix(named, mixed)
    assert out.columns == named.columns and out.count() == mixing.apply_mix(documents, mixed).count()
    assert all(r["_m"] == r["copies"] == 3 * r["doc_id"] for r in out.collect())


def test_many_rows_of_one_labelled_id_are_one_sample(spark):
    rows = [(1, f"junk {i}") for i in range(300)] + [(i, "fine words " * 3 if i % 2 else "junk " * 4) for i in range(2, 42)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 42)], "doc_id long, quality int, toxic int")
    once = quality.fit(documents.dropDuplicates(["doc_id"]), labels)
    assert quality.fit(documents, labels).base == pytest.approx(once.base, abs=0.2)


PAGE = """<html lang=en><head><title>A &amp; B</title><base href='http://x.org/d/'><meta name="k" content="v"><style>p{}</style>
<script>var t="</p>";</script></head><body><h1>Head  line</h1><!-- <p>no</p> --><p>one<b> two</b><br>three &lt;x&gt;
<a href="/r">r</a> <a href='s?q=1&amp;p=2'>s</a><img src="//y.org/i.png"></body></html>"""


def test_extract():
    got = warc.extract(PAGE, "http://x.org/p")
    assert (got["title"], got["lang"], got["metas"]) == ("A & B", "en", [{"name": "k", "content": "v"}])
    assert got["text"] == "A & B\nHead line\none two\nthree <x> r s"
    assert [x["url"] for x in got["links"]] == ["http://x.org/r", "http://x.org/d/s?q=1&p=2", "http://y.org/i.png"]
    assert warc.extract("")["text"] == "" and warc.extract("<p")["text"] == "<p" and warc.extract("<!-- open")["text"] == ""


def test_derivatives(spark):
    rows = [(1, "http://x.org/p", PAGE, 1), (2, None, None, 1), (2, None, None, 1), (None, "http://[bad", "<a href='http://[x'>é</a>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block long")
    sources = {r["record_id"]: r for r in warc.responses(pages).collect()}
    derived = warc.build_derivatives(pages).collect()
    assert len(derived) == 8
    for r in derived:
        source, headers = sources[r["refers_to"]], r["headers"]
        payload = warc.split_http(bytes(source["block"]))[2]
        assert headers["WARC-Source-Payload-Digest"] == warc.digest(payload) == source["headers"]["WARC-Payload-Digest"]
        assert headers["WARC-Block-Digest"] == warc.digest(bytes(r["block"]))
        assert (r["uri"], r["date"]) == (source["uri"], source["date"])
        if r["type"] == "metadata":
            facts = json.loads(bytes(r["block"]))["Envelope"]
            assert facts["WARC-Header-Metadata"]["WARC-Record-ID"] == r["refers_to"] and facts["Payload-Metadata"]["Digest-Valid"]
            assert dict(facts["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"])["Content-Type"] == "text/html; charset=utf-8"
        else:
            assert headers["WARC-Concurrent-To"] in {x["record_id"] for x in derived if x["type"] == "metadata"}
    assert warc.build_derivatives(pages.where("false")).count() == 0
    assert warc.derive(warc.responses(pages).withColumn("type", warc.F.lit("request"))).count() == 0


def test_warc_files(spark):
    pages = spark.createDataFrame([(i, f"http://x.org/{i}", PAGE * (i % 3)) for i in range(20)], "page_id long, url string, html string")
    records = warc.responses(pages)
    files = warc.write_warc(records.repartition(3), run_folder(spark, "warc"))
    assert files.agg({"records": "sum"}).first()[0] == 20
    fs, path = warc.file_system(files.first()["file"])
    with fs.open_input_stream(path, compression=None) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.0\r\nWARC-Type: response\r\n")
    back = {r["record_id"]: r for r in warc.read_warc(spark, files).collect()}
    for r in records.collect():
        assert bytes(back[r["record_id"]]["block"]) == bytes(r["block"]) and back[r["record_id"]]["headers"] == r["headers"]
    derived = {r["record_id"] for r in warc.derive(warc.read_warc(spark, files)).collect()}
    assert derived == {r["record_id"] for r in warc.build_derivatives(pages).collect()}


def test_quality_holds_out(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.classify(documents, labels.where("doc_id % 2 = 0"))
    held = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "toxic", "quality_keep").collect()
    good = [r["quality_keep"] for r in held if r["quality"] == 1 and not r["toxic"]]
    bad = [r["quality_keep"] for r in held if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_priors_shrink_sparse_sites(spark):
    draw = random.Random(5)
    rows = [(f"h{h}", f"p{p}", float(draw.random() < h / 10)) for h in range(1, 10) for p in range(3) for _ in range(200)] + [("new", "p", 0.0)]
    table, worth, path_worth = quality.priors(spark.createDataFrame(rows, "host string, path string, share double"))
    assert worth < 20 and path_worth > 20  # hosts differ, paths below them do not
    new = table.where("host = 'new'").first()
    posterior = (new["host_k"] + worth * new["mean"]) / (new["host_n"] + worth)
    assert 0.2 < posterior < new["mean"]


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(10)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels)
    assert got.columns[:len(odd.columns)] == odd.columns and got.count() == odd.count()
    assert all(0 <= r["quality_score"] <= 1 for r in got.collect())
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(odd, labels.where("false")).count() == odd.count()


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), name)
        assert docs.columns == seen
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count()
    by_stage = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, by_stage.select("doc_id", "n_tokens").collect())) == sorted(map(str, last.select("doc_id", "n_tokens").collect()))
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, folder)
    assert none.count() == 0


def test_all_are_registered():
    import __spark_entry__
    numbers = {int(n.split("_")[0][2:]) for n in queries.QUERIES}
    assert numbers == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_numpy_is_the_only_order(spark):
    ids, score = np.array([5, 3, 9]), np.array([[1, 1, 2]])
    q, found, scores = topk.search(np.array([[1]]), ids, np.array([7, 8, 1]), score, np.array([1]), np.array([-np.inf]), 2)
    assert (q.tolist(), ids[found].tolist(), scores.tolist()) == ([0, 0], [3, 5], [1, 1])
