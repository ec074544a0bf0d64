"""Permutations of whole tables: draws, way back, and what is joined."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from duebook.operators import models as ML
from duebook.operators.numbering import shuffled_position


def by_rounds(position, rows, key, rounds=40):
    """The permutation as one expression of Spark, a round at a time."""
    def step(i, r):
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("shift"), key, r), F.lit(rows)) - i, F.lit(rows))
        swap = F.xxhash64(F.lit("swap"), key, r, F.greatest(i, partner)) % 2 == 0
        return F.when(swap, partner).otherwise(i)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), position.cast("long"), step)


@pytest.mark.parametrize("rows", [1, 2, 17, 500])
def test_batches_draw_what_sparks_hash_gives(spark, rows):
    for key in (F.lit(3), F.xxhash64(F.lit(42), F.col("id") % 3)):
        got = spark.range(rows).withColumn("key", key).withColumn("to", shuffled_position(F.col("id"), rows, F.col("key")))
        got = got.withColumn("back", shuffled_position(F.col("to"), rows, F.col("key"), back=True))
        assert got.where((F.col("to") != by_rounds(F.col("id"), rows, F.col("key"))) | (F.col("back") != F.col("id"))).count() == 0


def test_one_side_of_the_join_is_the_table_once(spark):
    """Copies for the repeats stand on one side only; on both, one of them was broadcast whatever its size."""
    df = spark.createDataFrame([(i, float(i), i % 3) for i in range(60)], "id long, a double, week_bucket int")
    moved = ML.permuted(df, ["id"], ["a"], 4)
    text = io.StringIO()
    with redirect_stdout(text):
        moved.explain()
    assert text.getvalue().count("Generate explode") == 1
    rows = moved.collect()
    assert len(rows) == 240 and all(sorted(r["_moved"]["a"] for r in rows if r["repeat"] == k) == [float(i) for i in range(60)] for k in range(1, 5))
