"""The stored history: which runs an upsert touches, order of files, versions, failures."""

import os
import time

import pytest
from pyspark.sql import functions as F

from duebook.operators import history as H
from duebook.session import run_folder
from duebook.sources import readers as RD
from duebook.sources.arrival import with_arrival
from duebook.sources.ledger import Ledger
from duebook.streaming import arrivals as X

SCHEMA = "doc_id long, name string, amount double"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def contents(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or ("doc_id", "name", "amount"))).collect())


def new_ledger(spark, rows, buckets=8, schema=SCHEMA):
    ledger = Ledger(spark, run_folder(spark, "ledger"), buckets=buckets)
    ledger.create(table(spark, rows, schema))
    return ledger


def files(ledger):
    root = f"{ledger.root}/runs".removeprefix("file:")
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


@pytest.mark.parametrize("larger", [0, 1])
def test_the_later_file_wins_whatever_its_size(spark, tmp_path, larger):
    header = "business_code,doc_id,total_open_amount\n"
    for place, name in enumerate(["b.csv", "a.csv"]):  # the name says the opposite of the time
        more = "".join(f"x,{100 + i},1\n" for i in range(5000 if place == larger else 3))
        (tmp_path / name).write_text(f"{header}x,1,{10 * (place + 1)}\n{more}x,2,{place}\nx,2,{place + 5}\n")
        os.utime(tmp_path / name, (1000 + place, 1000 + place))
    batch = RD.read_uploaded_batch(spark, str(tmp_path))
    history = batch.where("doc_id = 1").limit(0)
    columns = ["doc_id", "total_open_amount"]
    for got in (H.upsert_history(history, batch), H.upsert_history(history, batch.where("doc_id < 100"))):
        assert [r for r in contents(got, *columns) if r[0] < 100] == [(1, 20.0), (2, 6.0)]
    ledger = Ledger(spark, run_folder(spark, "ledger"), buckets=4)
    ledger.create(batch)
    assert [r for r in contents(ledger.read(), *columns) if r[0] < 100] == [(1, 20.0), (2, 6.0)]
    root, checkpoint = run_folder(spark, "history"), run_folder(spark, "checkpoint")
    source = X.landing(spark, str(tmp_path), batch.select("business_code", *columns).schema, fmt="csv", header=True)
    X.stream_upsert_history(source, root, checkpoint).awaitTermination()
    read = X.read_upserted_history(spark, history.select("business_code", *columns), root)
    assert [r for r in contents(read, *columns) if r[0] < 100] == [(1, 20.0), (2, 6.0)]


def test_equal_times_go_by_path(spark, tmp_path):
    for name, amount in (("b.csv", 2), ("a.csv", 1)):
        (tmp_path / name).write_text(f"doc_id,total_open_amount\n1,{amount}\n" + "2,0\n" * (4000 if name == "a.csv" else 1))
        os.utime(tmp_path / name, (1000, 1000))
    batch = RD.read_uploaded_batch(spark, str(tmp_path))
    assert ("place" in with_arrival(batch).schema["_arrival"].dataType.fieldNames())
    assert contents(H.upsert_history(batch.limit(0), batch), "doc_id", "total_open_amount")[0] == (1, 2.0)


def test_only_runs_with_arriving_ids_are_read_and_written(spark):
    ledger = new_ledger(spark, [(i, "old", float(i)) for i in range(4000)])
    before, time_ns = files(ledger), time.time_ns()
    entries = ledger.manifest()
    assert len(before) == 8 and len(entries) == 9
    batch = table(spark, [(17, "new", 1.0), (17, "newer", 2.0)]).coalesce(1)
    changes = ledger.upsert(batch)
    assert len(changes.read) <= 2 and len(changes.written) == len(changes.read)  # the one that holds 17, and one more if a filter errs
    after = files(ledger)
    assert {f: t for f, t in after.items() if f in before} == before  # nothing was changed in place
    assert all(t >= time_ns for f, t in after.items() if f not in before)
    plan = ledger._kept(changes.read, table(spark, [(17, "x", 0.0)]))
    assert {f.split("run=")[1].split("/")[0] for f in plan.inputFiles()} == set(changes.read)
    assert contents(ledger.read()) == [(i, "newer" if i == 17 else "old", 2.0 if i == 17 else float(i)) for i in range(4000)]
    assert contents(ledger.read(version=0))[17] == (17, "old", 17.0)
    assert {r["run"] for r in ledger.manifest()} == {e["run"] for e in entries} - set(changes.read) | set(changes.written)


def test_new_ids_read_next_to_nothing(spark):
    ledger = new_ledger(spark, [(i, "old", 0.0) for i in range(20_000)])
    changes = ledger.upsert(table(spark, [(1_000_000 + i, "new", 1.0) for i in range(5)]))
    assert len(changes.read) <= 2 and ledger.read().count() == 20_005


def test_filters_miss_no_id_and_pass_few_others(spark):
    ledger = new_ledger(spark, [(i, "old", 0.0) for i in range(2000)], buckets=1)
    known = spark.createDataFrame([(e["run"], e["bits"]) for e in ledger.manifest() if e["run"]], "run string, bits long")
    filters = spark.read.parquet(f"{ledger.root}/filters").select("run", "word", F.col("bits").alias("set"))

    def passed(ids):
        asked = ledger._probes(ids.select(F.col("id").alias("key")).crossJoin(known)).join(filters, ["run", "word"])
        return asked.where(F.col("set").bitwiseAND(F.col("bit")) != 0).groupBy("key").count().where("count = 4").count()
    assert passed(spark.range(2000)) == 2000
    assert passed(spark.range(10_000, 30_000)) < 0.03 * 20_000


def test_features_new_columns_and_null_ids(spark):
    ledger = new_ledger(spark, [(1, "a", 1.0), (2, "b", 2.0), (None, "c", 3.0)])
    features = spark.createDataFrame([(2, 0.5), (3, 0.7)], "doc_id long, score double")
    ledger.upsert(table(spark, [(2, 20.0, "x"), (3, 30.0, "y"), (None, 40.0, "z")], "doc_id long, amount double, `odd name` string"), features)
    got = {r["doc_id"]: (r["name"], r["amount"], r["odd name"], r["score"]) for r in ledger.read().collect()}
    assert got == {1: ("a", 1.0, None, None), 2: (None, 20.0, "x", 0.5), 3: (None, 30.0, "y", 0.7), None: (None, 40.0, "z", None)}
    want = H.upsert_history(table(spark, [(1, "a", 1.0), (2, "b", 2.0), (None, "c", 3.0)]),
                            table(spark, [(2, 20.0, "x"), (3, 30.0, "y"), (None, 40.0, "z")], "doc_id long, amount double, `odd name` string"), features)
    assert got == {r["doc_id"]: (r["name"], r["amount"], r["odd name"], r["score"]) for r in want.collect()}


def test_empty_tables_and_batches(spark):
    ledger = new_ledger(spark, [])
    assert ledger.read().count() == 0 and ledger.read().columns == ["doc_id", "name", "amount"]
    assert ledger.upsert(table(spark, [])).written == [] and ledger.version() == 1
    ledger.upsert(table(spark, [(5, "a", 1.0)]))
    assert contents(ledger.read()) == [(5, "a", 1.0)]
    with pytest.raises(FileExistsError):
        ledger.create(table(spark, []))
    with pytest.raises(FileNotFoundError):
        Ledger(spark, run_folder(spark, "none")).read()


def test_a_failed_upsert_leaves_the_version(spark, monkeypatch):
    ledger = new_ledger(spark, [(1, "a", 1.0), (2, "b", 2.0)])
    with monkeypatch.context() as m:
        m.setattr(Ledger, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ledger.upsert(table(spark, [(1, "new", 9.0)]))
    assert ledger.version() == 0 and contents(ledger.read()) == [(1, "a", 1.0), (2, "b", 2.0)]
    ledger.upsert(table(spark, [(1, "new", 9.0)]))
    assert contents(ledger.read()) == [(1, "new", 9.0), (2, "b", 2.0)]
    gone = ledger.vacuum()
    assert gone and contents(ledger.read()) == [(1, "new", 9.0), (2, "b", 2.0)]
    assert ledger.upsert(table(spark, [(2, "c", 3.0)])).read and contents(ledger.read())[1] == (2, "c", 3.0)


def test_compact_merges_buckets_with_many_runs(spark):
    ledger = new_ledger(spark, [(i, "a", 0.0) for i in range(100)], buckets=2)
    for part in range(1, 4):
        ledger.upsert(table(spark, [(i + 1000 * part, "b", 0.0) for i in range(100)]))
    want = contents(ledger.read())
    runs = len(ledger.manifest()) - 1
    changes = ledger.compact(runs=1)
    assert runs > 2 and len(changes.written) <= 2 and len(ledger.manifest()) == 3
    assert contents(ledger.read()) == want and ledger.compact(runs=1).written == []


def test_a_repeated_batch_of_a_stream_changes_nothing(spark):
    ledger = new_ledger(spark, [(1, "a", 1.0)])
    assert ledger.upsert(table(spark, [(1, "b", 2.0)]), applied=0).version == 1
    assert ledger.upsert(table(spark, [(1, "zzz", 3.0)]), applied=0).written == []
    assert ledger.upsert(table(spark, [(2, "c", 3.0)]), applied=1).version == 2
    assert contents(ledger.read()) == [(1, "b", 2.0), (2, "c", 3.0)]
