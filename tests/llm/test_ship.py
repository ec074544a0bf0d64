"""Executors need not have the package: operators send it along."""

import os
import subprocess
import sys

import pyspark

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = f"""
import sys, tempfile
sys.path.insert(0, {ROOT!r})
from duebook.session import build_session
spark = build_session("ship", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2",
                      spark__checkpoint__dir=tempfile.mkdtemp())
from duebook.llm import queries
print("rows", queries.op4_fingerprints(spark, "/root/testdata/sf0.001").count())
"""


def test_tasks_find_the_package():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.path.dirname(os.path.dirname(pyspark.__file__))}
    done = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, cwd="/", env=env, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    """Long texts side by side come in small batches; the session's bound on rows stays as it is."""
    import pyarrow as pa

    from duebook.llm.common import BATCH, ship
    ship(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]})
    found = spark.range(0, 60, 1, 1).selectExpr("repeat('word ', 40000) AS text").mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r["rows"] for r in found) == 60 and max(r["bytes"] for r in found) < BATCH + 500_000
