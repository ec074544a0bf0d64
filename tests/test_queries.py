"""Every query with SQL against that SQL on the smallest tables; the others for rows.

Queries named SLOW fit several models. Their operators are tested in test_models, test_streams and test_scripts; as queries they are run by
tools/check.py only, those with SQL against it.
"""

import re

import pytest

import __spark_entry__ as entry
from check import rows
from duebook import catalog

QUERIES, SQL = catalog.load()
SLOW = {"compare_models", "random_search", "random_search_by_mape", "grid_search", "recursive_elimination", "train",
        "walk_forward_backtest", "walk_forward_cash_backtest", "score_forecast_and_queue", "save_and_load_model",
        "stream_score", "calibrate_sigmoid", "score_batch", "permutation_importance", "prepare_prompts", "grid_search_shares",
        "random_search_shares"}


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_equals_sql(spark, db, folder, name):
    df = QUERIES[name](spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert got == rows(result.columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.columns and df.count() > 0


def test_weight_grid_cleans_the_invoices_once(spark, folder):
    assert not any("orders.parquet" in f for f in QUERIES["weight_grid"](spark, folder).inputFiles())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 300 and "forecast_mae_weekly" in df.columns


def test_names():
    assert set(SQL) <= set(QUERIES)
    for name in QUERIES:
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name)
        assert "pipeline" not in name and not re.match(r"op\d", name)
