"""The invoice history as a stored table that takes upserts: buckets of runs, each run with a Bloom filter, versions by manifest.

An id belongs to a bucket by its hash. A bucket consists of runs, each a folder of its own. An upsert asks the filters which runs may hold an arriving id;
only those are read and merged with what has arrived into a new run of their bucket, all others stay as they are. A version is a list of runs,
written last, so a reader sees a whole version or none, and a job that fails leaves the table as it was.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook.operators.history import arrived_last, union_history
from duebook.session import materialise
from duebook.sources.readers import table_exists

#: Bits of a filter per row and the bits that an id sets; about 1 of 100 ids that a run does not hold passes.
BITS, PROBES = 10, 4
_RUN = re.compile(r"v(\d+)b(\d+)a(\w+)")
_MANIFEST = "run string, bucket int, rows long, bits long, schema string, applied long"


def _parts(run: str) -> tuple[str, str, str]:
    """Version, bucket and attempt of a run."""
    return _RUN.fullmatch(run).groups()


@dataclass(frozen=True)
class Changes:
    """What an upsert did: the new version, the runs it read, the runs it wrote."""
    version: int
    read: list[str]
    written: list[str]


@dataclass(frozen=True)
class Ledger:
    """A table under ``root`` with one row per ``key``; choose ``buckets`` so that one fits a task (about 1 GB each).

    One writer at a time: of two that make the same version, the second fails when it writes its manifest.
    """
    spark: SparkSession
    root: str
    key: str = "doc_id"
    buckets: int = 64

    # -- versions ----------------------------------------------------------------------------------------

    def version(self) -> int | None:
        """The last complete version, None before the first."""
        done = [int(n.removeprefix("version=")) for n, _ in self._folders("manifest") if table_exists(self.spark, f"{self.root}/manifest/{n}/_SUCCESS")]
        return max(done, default=None)

    def manifest(self, version: int | None = None) -> list[T.Row]:
        """The runs of a version, a few for each bucket; the first entry names none and holds the schema."""
        at = self.version() if version is None else version
        if at is None:
            raise FileNotFoundError(f"no ledger at {self.root}")
        return sorted(self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest/version={at}").collect(), key=lambda r: r["run"] or "")

    def read(self, version: int | None = None, runs: list[str] | None = None) -> DataFrame:
        """The rows of a version, the last one unless another is named; with ``runs``, of those only."""
        entries = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(entries[0]["schema"]))
        names = [e["run"] for e in entries if e["run"]] if runs is None else runs
        if not names:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/runs/run={n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths)

    def _commit(self, version: int, runs: list[dict], schema: T.StructType, applied: int | None) -> None:
        head = {"run": None, "bucket": None, "rows": None, "bits": None, "schema": schema.json(), "applied": applied}
        rows = [head, *({"schema": None, "applied": None} | r for r in runs)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{self.root}/manifest/version={version}")

    # -- filters -----------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(7), f"`{self.key}`"), F.lit(self.buckets)).cast("int")

    def _probes(self, keys: DataFrame) -> DataFrame:
        """One row for each bit that an id sets in a run of ``bits`` bits: ``run, key, word, bit``."""
        hashes = F.array(*[F.pmod(F.xxhash64(F.lit(i), "key"), F.col("bits")) for i in range(PROBES)])
        at = keys.select("run", "key", F.explode(hashes).alias("at"))
        return at.select("run", "key", F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bit"))

    def runs_with(self, keys: DataFrame, entries: list[T.Row]) -> list[str]:
        """Runs that may hold one of the ids, a column ``key`` beside its ``bucket``; at most as many names as there are runs."""
        runs = [(e["run"], e["bucket"], e["bits"]) for e in entries if e["run"]]
        if not runs:
            return []
        known = self.spark.createDataFrame(runs, "run string, bucket int, bits long")
        paths = sorted({"{0}/filters/version={1}/attempt={3}".format(self.root, *_parts(r[0])) for r in runs})
        filters = self.spark.read.schema("run string, word long, bits long").parquet(*paths).withColumnRenamed("bits", "set")
        asked = self._probes(keys.join(F.broadcast(known), "bucket"))
        seen = asked.join(filters, ["run", "word"]).where(F.col("set").bitwiseAND(F.col("bit")) != 0)
        # An id whose bits fall on each other has as many rows as bits either way.
        hit = seen.groupBy("run", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == PROBES)
        return sorted(r["run"] for r in hit.select("run").distinct().collect())

    def _write(self, version: int, rows: DataFrame) -> list[dict]:
        """Rows with their ``_bucket`` as the runs of a version, and the filters of the runs. Names are new for every attempt, so what a failed one has
        left is never read."""
        attempt, folder = uuid.uuid4().hex[:12], f"{self.root}/runs"
        run = F.concat(F.lit(f"v{version}b"), F.col("_bucket"), F.lit(f"a{attempt}"))
        rows.withColumn("run", run).drop("_bucket").repartition("run").write.partitionBy("run").mode("append").parquet(folder)
        written = [n.removeprefix("run=") for n, _ in self._folders("runs") if n.endswith(f"a{attempt}")]
        if not written:
            return []
        keys = self.spark.read.option("basePath", folder).parquet(*[f"{folder}/run={n}" for n in written]).select("run", F.col(f"`{self.key}`").alias("key"))
        sizes = {r["run"]: r["rows"] for r in keys.groupBy("run").agg(F.count(F.lit(1)).alias("rows")).collect()}
        runs = [{"run": n, "bucket": int(_parts(n)[1]), "rows": sizes[n], "bits": max(64, BITS * sizes[n])} for n in sorted(sizes)]
        known = self.spark.createDataFrame([(r["run"], r["bits"]) for r in runs], "run string, bits long")
        bits = self._probes(keys.join(F.broadcast(known), "run")).groupBy("run", "word").agg(F.bit_or("bit").alias("bits"))
        bits.write.parquet(f"{self.root}/filters/version={version}/attempt={attempt}")
        return runs

    def _folders(self, name: str) -> list[tuple[str, object]]:
        """Names and paths of the folders in a folder of the table."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []

    # -- changes -----------------------------------------------------------------------------------------

    def create(self, rows: DataFrame) -> Changes:
        """The first version: the last row of each id in order of arrival."""
        if self.version() is not None:
            raise FileExistsError(f"there is a ledger at {self.root}")
        last = arrived_last(rows, self.key)
        runs = self._write(0, last.withColumn("_bucket", self._bucket()))
        self._commit(0, runs, last.schema, None)
        return Changes(0, [], [r["run"] for r in runs])

    def upsert(self, batch: DataFrame, features: DataFrame | None = None, batch_order: str | None = None, applied: int | None = None) -> Changes:
        """Replace or add the rows of a batch, as ``upsert_history`` does, with the last row of each id in order of arrival.

        ``features`` adds columns by id. Columns that the table or the batch lacks are null. ``applied`` numbers the batches of a stream: one that was
        applied before changes nothing.
        """
        at = self.version()
        entries = self.manifest(at)
        if applied is not None and entries[0]["applied"] is not None and applied <= entries[0]["applied"]:
            return Changes(at, [], [])
        last = arrived_last(batch, self.key, batch_order, features)
        arrived = materialise(last.withColumn("_bucket", self._bucket()), "arrived")
        hit = self.runs_with(arrived.select(F.col("_bucket").alias("bucket"), F.col(f"`{self.key}`").alias("key")), entries)
        stay = self._kept(hit, arrived) if hit else self.read(at, [])
        merged = union_history(stay.withColumn("_bucket", self._bucket()), arrived)
        runs = self._write(at + 1, merged)
        others = [{c: e[c] for c in ("run", "bucket", "rows", "bits")} for e in entries if e["run"] and e["run"] not in hit]
        self._commit(at + 1, others + runs, merged.drop("_bucket").schema, entries[0]["applied"] if applied is None else applied)
        return Changes(at + 1, hit, [r["run"] for r in runs])

    def _kept(self, hit: list[str], arrived: DataFrame) -> DataFrame:
        """Rows of the runs that are rewritten, without the ids that have arrived."""
        old, new = self.read(runs=hit), arrived.select(F.col(f"`{self.key}`").alias("_new"))
        return old.join(new, old[f"`{self.key}`"].eqNullSafe(F.col("_new")), "left_anti")

    def compact(self, runs: int = 4) -> Changes:
        """Merge the runs of buckets that have more than ``runs`` of them; the others are not touched."""
        at = self.version()
        entries = self.manifest(at)
        by: dict[int, list[str]] = {}
        for e in entries:
            if e["run"]:
                by.setdefault(e["bucket"], []).append(e["run"])
        many = sorted(n for names in by.values() if len(names) > runs for n in names)
        if not many:
            return Changes(at, [], [])
        rows = self.read(at, many)
        written = self._write(at + 1, rows.withColumn("_bucket", self._bucket()))
        others = [{c: e[c] for c in ("run", "bucket", "rows", "bits")} for e in entries if e["run"] and e["run"] not in many]
        self._commit(at + 1, others + written, rows.schema, entries[0]["applied"])
        return Changes(at + 1, many, [r["run"] for r in written])

    def vacuum(self) -> list[str]:
        """Remove the runs that the last version does not have, with the versions before it; readers of those must have ended."""
        at = self.version()
        alive = {e["run"] for e in self.manifest(at) if e["run"]}
        used = {_parts(n)[0] for n in alive}
        gone = [(n.removeprefix("run="), path) for n, path in self._folders("runs") if n.removeprefix("run=") not in alive]
        old = [path for n, path in self._folders("filters") if n.removeprefix("version=") not in used]
        old += [path for n, path in self._folders("manifest") if int(n.removeprefix("version=")) < at]
        for path in [path for _, path in gone] + old:
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return sorted(n for n, _ in gone)
