"""Edge cases of parsing, filters, duplicates and features, with values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duebook import schema
from duebook.functions import dates as D
from duebook.functions import invoice as I
from duebook.functions import probability as P
from duebook.functions import risk as R
from duebook.functions.numbers import round_even
from duebook.operators import cleaning as C
from duebook.operators import history as H
from duebook.operators import joins as J
from duebook.operators import queue as Q

DAY = dt.date


def values(df, column):
    return [r[column] for r in df.collect()]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


RAW = dict(business_code="U001", cust_number="0200", name_customer="A", clear_date="2020-03-01 00:00:00", buisness_year=2020.0,
           doc_id=1.0, posting_date=None, document_create_date=None, due_in_date=20200210.0, invoice_currency="USD",
           posting_id=1.0, area_business=None, total_open_amount=100.0, baseline_create_date=20200201.0,
           cust_payment_terms="NAH4", invoice_id=1.0, isOpen=0)


def raw(spark, *changes):
    rows = []
    for change in changes:
        row = {**RAW, "document_create_date.1": None, "document type": "RV", **change}
        rows.append(tuple(row[f.name] for f in schema.RAW_INVOICE.fields))
    return spark.createDataFrame(rows, schema.RAW_INVOICE)


@pytest.mark.parametrize("text, expected", [
    ("20200210", DAY(2020, 2, 10)), ("20200210.0", DAY(2020, 2, 10)), ("20201345", None), ("abc", None), ("", None),
    ("2020", None), (None, None), ("20200230", None)])
def test_parse_yyyymmdd(spark, text, expected):
    assert one(spark, D.parse_yyyymmdd(F.lit(text).cast("string"))) == expected


def test_parse_yyyymmdd_number(spark):
    assert one(spark, D.parse_yyyymmdd(F.lit(20200210.0))) == DAY(2020, 2, 10)


def test_parse_timestamp(spark):
    assert one(spark, D.parse_timestamp(F.lit("2020-02-11 10:30:00"))) == dt.datetime(2020, 2, 11, 10, 30)
    assert one(spark, D.parse_timestamp(F.lit("next week"))) is None


def test_clean_drops_duplicates_and_bad_ids(spark):
    df = raw(spark, {}, {}, {"doc_id": 2.0, "invoice_id": None}, {"doc_id": 3.0, "clear_date": None},
             {"doc_id": 1.0, "total_open_amount": 7.0}, {"doc_id": 4.0, "due_in_date": 20201345.0})
    every = C.clean_invoices(df, only_paid=False)
    assert sorted(values(every, "doc_id")) == [1, 1, 3, 4]
    assert sorted(values(C.clean_invoices(df), "doc_id")) == [1, 1, 4]
    assert every.where("doc_id = 4").first()["due_in_date"] is None
    assert every.columns == [f.name for f in schema.CLEAN_INVOICE.fields]


def test_text_ids(spark):
    df = spark.createDataFrame([("1",), ("abc",), (None,), ("2.0",)], "invoice_id string")
    assert values(C.drop_invalid_ids(df), "invoice_id") == ["1", "2.0"]


@pytest.mark.parametrize("currency, year, expected", [
    ("USD", 2018, 100.0), (" cad ", 2018, 77.1), ("CAD", 2019, 75.4), ("Cad", 2020, 74.5), ("CAD", 2021, 75.0), ("EUR", 2020, 100.0)])
def test_to_usd(spark, currency, year, expected):
    assert one(spark, I.to_usd(F.lit(100.0), F.lit(currency), F.lit(year))) == pytest.approx(expected)


def test_raw_amounts_stay(spark):
    df = raw(spark, {"invoice_currency": "CAD"})
    assert C.clean_invoices(df, amount_source="raw").first()["total_open_amount"] == 100.0
    assert C.clean_invoices(df).first()["total_open_amount"] == pytest.approx(74.5)
    with pytest.raises(ValueError):
        C.clean_invoices(df, amount_source="eur")


@pytest.mark.parametrize("days, floor0, ceil1", [
    (1, 0, 1), (6, 0, 1), (7, 1, 1), (8, 1, 2), (41, 5, 6), (42, 6, 6), (43, 6, 7), (-3, 0, 1), (400, 6, 7), (None, None, None)])
def test_week_bucket(spark, days, floor0, ceil1):
    d = F.lit(days).cast("int")
    assert one(spark, I.week_bucket(d)) == floor0
    assert one(spark, I.week_bucket(d, "ceil1")) == ceil1


@pytest.mark.parametrize("amount, size, log", [
    (-5.0, "small", 0.0), (0.0, "small", 0.0), (10000.0, "small", 9.21044036697651), (10000.01, "medium", 9.210441366876523),
    (100000.0, "medium", 11.512935464920229), (100000.01, "large", 11.51293556491922), (None, None, None)])
def test_amounts(spark, amount, size, log):
    a = F.lit(amount).cast("double")
    assert one(spark, I.size_category_fixed(a)) == size
    assert one(spark, I.amount_log(a)) == (None if log is None else pytest.approx(log, abs=1e-9))


@pytest.mark.parametrize("code, days", [("NAH4", 4), ("NA10", 10), ("NAA8", 8), ("B0X1", 1), ("NONE", 0), (None, 0)])
def test_terms(spark, code, days):
    assert one(spark, I.extract_terms_days(F.lit(code).cast("string"))) == days


def test_days_past_due_open(spark):
    at = F.lit(DAY(2020, 2, 10))
    due, late, none = F.lit(DAY(2020, 2, 5)), F.lit(DAY(2020, 2, 11)), F.lit(None).cast("date")
    assert one(spark, I.days_past_due_open(due, none, at)) == 5
    assert one(spark, I.days_past_due_open(due, late, at)) == 5
    assert one(spark, I.days_past_due_open(due, F.lit(DAY(2020, 2, 10)), at)) == 0
    assert one(spark, I.days_past_due_open(none, none, at)) == 0


@pytest.mark.parametrize("score, category", [(0.1999, "Low"), (0.20, "Medium"), (0.4999, "Medium"), (0.50, "High")])
def test_risk_category(spark, score, category):
    assert one(spark, R.risk_category(F.lit(score))) == category


@pytest.mark.parametrize("days, factor", [(0, 1.0), (1, 1.2), (6, 1.2), (7, 1.5), (29, 1.5), (30, 2.0)])
def test_overdue_multiplier(spark, days, factor):
    assert one(spark, R.overdue_multiplier(F.lit(days))) == factor


@pytest.mark.parametrize("ratio, tier", [(0.1, "low"), (0.2, "medium"), (0.59, "medium"), (0.6, "high")])
def test_customer_tier(spark, ratio, tier):
    assert one(spark, R.customer_tier(F.lit(ratio))) == tier


def test_round_even(spark):
    assert one(spark, round_even(F.lit(0.125), 2)) == 0.12
    assert one(spark, round_even(F.lit(0.375), 2)) == 0.38


def array(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_probabilities(spark):
    p = array(0, .2, .3, .3, .1, .1, 0)
    assert one(spark, P.predicted_class(p)) == 2
    sharp = one(spark, P.sharpen(p, 0.8))
    assert sum(sharp) == pytest.approx(1) and sharp[0] > 0
    assert one(spark, P.tilt(array(*[0] * 7), array(*[1] * 7))) == [0.0] * 7
    assert sum(one(spark, P.tilt(p, array(2, 1, 1, 1, 1, 1, 1)))) == pytest.approx(1)
    assert one(spark, P.in_top_k(p, F.lit(2), 2)) is True
    assert one(spark, P.in_top_k(p, F.lit(1), 2)) is False
    assert one(spark, P.valid(p)) is True
    assert one(spark, P.valid(array(.5, .5))) is False
    assert one(spark, P.pad_classes(array(.7, .3), F.array(F.lit(1), F.lit(5)))) == [0, .7, 0, 0, 0, .3, 0]
    assert one(spark, P.soft_vote([p, array(1, 0, 0, 0, 0, 0, 0)], [F.lit(3.0), F.lit(1.0)]))[0] == pytest.approx(.25)


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 5, "c"), (1, 9, "d")], "doc_id long, seq int, x string")
    assert {r["doc_id"]: r["x"] for r in C.keep_first(df, "doc_id", "seq").collect()} == {1: "d", 2: "c"}
    assert {r["doc_id"]: r["x"] for r in C.keep_last(df, "doc_id", "seq").collect()} == {1: "b", 2: "c"}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "doc_id long, amount double")
    new = spark.createDataFrame([(2, 5.0), (3, 3.0)], "doc_id long, amount double")
    features = spark.createDataFrame([(2, "f"), (2, "f"), (3, "g")], "doc_id long, feature string")
    once = H.upsert_history(old, new, features)
    expected = {(1, 1.0, None), (2, 5.0, "f"), (3, 3.0, "g")}
    assert {tuple(r) for r in once.select("doc_id", "amount", "feature").collect()} == expected
    assert {tuple(r) for r in H.upsert_history(once, new, features).select("doc_id", "amount", "feature").collect()} == expected


def test_fx_lookup_unknown_year(spark):
    rates = spark.createDataFrame([(2018, .772), (2018, .772)], "business_year long, cad_usd_rate double")
    inv = spark.createDataFrame([(1, 2018, "CAD", 10.0), (2, 1999, "CAD", 10.0), (3, 1999, "USD", 10.0)],
                                "doc_id long, business_year long, invoice_currency string, invoice_amount double")
    got = {r["doc_id"]: r["amount_usd"] for r in J.fx_lookup_join(inv, rates).collect()}
    assert got == {1: pytest.approx(7.72), 2: None, 3: 10.0}


def test_expectations_stop_the_job(spark):
    df = spark.createDataFrame([(1, -100.0, DAY(2020, 1, 1), [.1, .1, .1, .1, .2, .2, .2])],
                               "doc_id long, total_open_amount double, due_in_date date, probabilities array<double>")
    risk = Q.risk_table(df, F.lit(DAY(2020, 2, 1)))
    checked = Q.expectations(risk)
    assert checked.first()["negative_priority"] == 1
    with pytest.raises(Exception, match="negative_priority=1"):
        Q.enforce(checked).collect()
    assert values(Q.quarantine(risk), "doc_id") == [1]


def test_equal_priorities_rank_by_id(spark):
    df = spark.createDataFrame([(i, 5.0) for i in (9, 3, 7)] + [(1, None), (2, 6.0)], "doc_id long, priority_score double")
    assert values(Q.collections_rank(df, 3).orderBy("collections_rank"), "doc_id") == [2, 3, 7]


def test_required_columns_and_fields(spark):
    df = spark.createDataFrame([(1, None)], "` doc_id` long, x string")
    assert Q.required_columns(df, ["doc_id", "y", "x"]) == ["y"]
    assert Q.required_fields(df.toDF("doc_id", "x"), ["doc_id", "x", "z"]).first()["missing_fields"] == ["x", "z"]


def test_reasons(spark):
    def reasons(label, days, ratio, amount, rank):
        return one(spark, R.reason_badges(F.lit(label), F.lit(days), F.lit(ratio), F.lit(amount), F.lit(rank), F.lit(3)))
    assert reasons("Medium", 30, .5, 50000.0, 4) == ["Medium risk · week 3"]
    assert reasons("Critical", 1234, .58, 50000.5, 3) == [
        "Critical risk", "1,234 days overdue", "58% historical late rate", "High invoice value", "Priority rank #3"]


def test_readable_ids_and_dates(spark):
    assert one(spark, R.format_id(F.lit("1930438491.0"))) == "1930438491"
    assert one(spark, R.format_id(F.lit("INV-1"))) == "INV-1"
    assert one(spark, R.format_date(F.lit("20200210.0"))) == "2020-02-10"
    assert one(spark, R.format_date(F.lit("soon"))) == "soon"
    assert one(spark, R.format_date(F.lit("123"))) == "123"


def test_ids_that_are_not_numbers(spark):
    rows = [("NaN",), ("nan",), ("2",), ("x",), (None,), ("1e3",)]
    got = C.drop_invalid_ids(spark.createDataFrame(rows, "invoice_id string"))
    assert sorted(r["invoice_id"] for r in got.collect()) == ["1e3", "2"]


def test_open_invoices_are_no_cash(spark):
    from duebook.operators.forecast import weekly_actual_cash
    rows = [("2020-01-06", None, 100.0), ("2020-01-06", "2020-01-07", 5.0), ("2020-01-06", "2020-01-01", 2.0)]
    df = spark.createDataFrame(rows, "reference_date string, invoice_paid string, total_open_amount double")
    df = df.withColumn("reference_date", F.to_date("reference_date")).withColumn("invoice_paid", F.to_date("invoice_paid"))
    got = {r["week_bucket"]: r["actual_cash"] for r in weekly_actual_cash(df).collect()}
    assert got == {1: 7.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}


def test_csv_files_of_different_order(spark):
    from duebook.session import run_folder
    from duebook.sources.readers import read_uploaded_batch
    folder = run_folder(spark, "uploads")
    a = spark.createDataFrame([(1.0, 10.0)], "doc_id double, total_open_amount double")
    a.coalesce(1).write.option("header", True).csv(folder)
    a.select((F.col("total_open_amount") * 2).alias("total_open_amount"), (F.col("doc_id") + 1).alias(" doc_id ")) \
        .coalesce(1).write.mode("append").option("header", True).csv(folder)
    got = read_uploaded_batch(spark, folder).select(F.col("doc_id").cast("double"), "total_open_amount").collect()
    assert sorted(tuple(r) for r in got) == [(1.0, 10.0), (2.0, 20.0)]


def test_histogram_leaves_out_nan(spark):
    from duebook.operators.profiling import histogram
    df = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (None,)], "a double")
    assert sorted((r["bin"], r["n"]) for r in histogram(df, bins=2).collect()) == [(0, 1), (1, 1)]


def test_headers_are_read_file_by_file(spark, tmp_path):
    """A header per file although files are split, and next to none of the lines are read for them."""
    from duebook.sources import readers as RD
    rows = "".join(f"x,{i},1\n" for i in range(60_000))
    for n in range(6):
        (tmp_path / f"{n}.csv").write_text(("business_code, doc_id ,total_open_amount\n" if n < 4 else "doc_id,business_code\n") + (rows if n == 0 else "y,7,2\n" if n < 4 else "8,z\n"))
    (tmp_path / "empty.csv").write_text("")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        headers = {r["file"].rsplit("/", 1)[1]: r["header"] for r in RD.file_headers(spark, str(tmp_path)).collect()}
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "65536" and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
        assert headers == {f"{n}.csv": "business_code, doc_id ,total_open_amount" if n < 4 else "doc_id,business_code" for n in range(6)}
        batch = RD.read_uploaded_batch(spark, str(tmp_path))
        assert set(batch.columns) == {"business_code", "doc_id", "total_open_amount"}
        found = batch.groupBy("business_code").agg(F.count(F.lit(1)), F.max("doc_id"), F.sum("total_open_amount")).collect()
        assert {tuple(r) for r in found} == {("x", 60_000, 59_999, 60_000.0), ("y", 3, 7, 6.0), ("z", 2, 8, None)}
        assert batch.schema["doc_id"].dataType == schema.RAW_INVOICE["doc_id"].dataType
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_order_of_files_with_different_headers(spark, tmp_path):
    import os
    from duebook.sources import readers as RD
    for n, (name, text) in enumerate([("z.csv", "doc_id,total_open_amount\n1,10\n2,5\n"), ("a.csv", "total_open_amount,doc_id\n20,1\n30,1\n" + "0,3\n" * 3000)]):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (2000 + n, 2000 + n))
    batch = RD.read_uploaded_batch(spark, str(tmp_path), arrival=True)
    got = H.upsert_history(batch.drop("_arrival").limit(0), batch)
    assert sorted(tuple(r) for r in got.select("doc_id", "total_open_amount").collect()) == [(1, 30.0), (2, 5.0), (3, 0.0)]
    assert "_arrival" not in got.columns


def test_folder_of_empty_files(spark, tmp_path):
    from duebook.sources import readers as RD
    (tmp_path / "empty.csv").write_text("")
    assert RD.read_uploaded_batch(spark, str(tmp_path)).count() == 0
