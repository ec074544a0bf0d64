"""Exact top-k search by inner product: branch and bound over dimension blocks in vertical layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duebook.llm.common import ship
from duebook.session import materialise

#: Rows of a block of candidates and of queries: one pair of blocks is one unit of work.
CANDIDATES, QUERIES = 4096, 1024
#: Dimensions of one step of the search, and pairs that one product of survivors takes.
STEP, PART = 8, 1 << 18
#: Below these bounds on a score, sums in single and in double precision are exact.
SINGLE, DOUBLE = 2 ** 24, 2 ** 53
#: Scores beyond this bound, the largest long, count as the bound.
LAST = 2 ** 63 - 1


def quantised(vectors: DataFrame, scale: int = 64, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id, v``: floor(scale * x) of every component; vectors that are null or hold null or non-finite components are left out."""
    whole = F.transform(F.col(embedding), lambda x: x.cast("double"))
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(key).alias("id"), whole.alias("x")).where(F.col("x").isNotNull() & finite).select(
        "id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _matrix(scalar: pa.ListScalar) -> np.ndarray:
    rows = scalar.values
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), -1 if len(rows.flatten()) else 0)


def search(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, vertical: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple:
    """Top k of one block of candidates for each query: ``(query places, candidate places, scores)``; ties go to the smaller id, then row.

    ``rows`` tells the candidates apart, ``own`` is the row of each query, which is none of its candidates.

    ``vertical`` holds one row per dimension. The block's queries visit the dimensions in one order, those that weigh most with them first,
    ``STEP`` at a time, and add up the scores of all candidates. What the dimensions still to come can add is at most the product of the
    remaining norms. ``floor`` is a score that a query's k-th best is known to reach: a pair whose sum and bound stay below it is dropped. As soon as
    few pairs survive they are compacted, and only they go on. Sums are exact: single or double precision where every sum fits, else integers.
    """
    dims = len(vertical)
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vertical).max(initial=0)) * max(dims, 1)
    if largest >= DOUBLE:
        sums = queries.astype(object) @ vertical.astype(object) if dims else np.zeros((len(queries), len(ids)), dtype=object)
        return _best([(q, c, sums[q, c]) for q in range(len(own)) for c in range(len(ids)) if rows[c] != own[q]], ids, rows, k)
    kind = np.float32 if largest < SINGLE else np.float64
    order = np.argsort(-np.abs(queries).sum(0), kind="stable")
    columns, asked = vertical[order].astype(kind), np.ascontiguousarray(queries[:, order].astype(kind))
    rest, left = (columns.astype(np.float64) ** 2).sum(0), (asked.astype(np.float64) ** 2).sum(1)
    least = floor.astype(kind) - kind(1) - np.abs(floor.astype(kind)) * kind(1e-6)
    sums, at, pairs = np.zeros((len(own), len(ids)), dtype=kind), 0, None
    sums[own[:, None] == rows[None, :]] = -np.inf
    while at < dims and pairs is None:
        some = slice(at, at + STEP)
        sums += asked[:, some] @ columns[some]
        rest -= (columns[some].astype(np.float64) ** 2).sum(0)
        left -= (asked[:, some].astype(np.float64) ** 2).sum(1)
        at += STEP
        if at < dims and np.isfinite(floor).all() and 2 * at >= dims:
            alive = sums + (np.sqrt(np.maximum(left, 0)) * 1.00001).astype(kind)[:, None] * np.sqrt(np.maximum(rest, 0)).astype(kind) >= least[:, None]
            if 4 * np.count_nonzero(alive) < alive.size:
                q, c = np.nonzero(alive)
                pairs = q, c, sums[q, c]
    if pairs is None:
        if len(ids) > k:
            kth = np.partition(sums, len(ids) - k, axis=1)[:, len(ids) - k]
            least = np.maximum(np.where(np.isfinite(floor), floor, -np.inf), kth)
        q, c = np.nonzero((sums >= least[:, None]) & np.isfinite(sums))
        pairs = q, c, sums[q, c]
    turned = np.ascontiguousarray(columns.T)
    while at < dims:
        some, (q, c, score) = slice(at, at + STEP), pairs
        score = score + np.concatenate([np.einsum("ij,ij->i", asked[q[i:i + PART], some], turned[c[i:i + PART], some]) for i in range(0, len(q), PART)] or [score])
        rest -= (columns[some].astype(np.float64) ** 2).sum(0)
        left -= (asked[:, some].astype(np.float64) ** 2).sum(1)
        at += STEP
        bound = (np.sqrt(np.maximum(left, 0)) * 1.00001).astype(kind)[q] * np.sqrt(np.maximum(rest, 0)).astype(kind)[c] if at < dims else kind(0)
        keep = np.flatnonzero(score + bound >= least[q])
        pairs = q[keep], c[keep], score[keep]
    q, c, score = pairs
    order = np.lexsort((rows[c], ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], c[keep], score[keep].astype(np.int64)


def _best(pairs: list[tuple], ids: np.ndarray, rows: np.ndarray, k: int) -> tuple:
    by: dict[int, list] = {}
    for q, c, score in pairs:
        by.setdefault(q, []).append((-max(-LAST, min(LAST, int(score))), int(ids[c]), int(rows[c]), c))
    top = [(q, c, -score) for q, found in by.items() for score, _, _, c in sorted(found)[:k]]
    return tuple(np.array([x[i] for x in top], dtype=np.int64) for i in range(3))


def _pairs(k: int):
    """Task function: a row is a block of queries with a block of candidates."""
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("vec_row", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_rows, rows = (batch.column(c)[i].values.to_numpy() for c in ("q_rows", "rows"))
                q_ids, ids = (batch.column(c)[i].values for c in ("q_ids", "ids"))
                ties = pc.fill_null(ids, LAST).to_numpy()
                floors = np.array([-np.inf if x is None else x for x in batch.column("floors")[i].as_py()], dtype=np.float64)
                queries, candidates = _matrix(batch.column("q")[i]), _matrix(batch.column("v")[i])
                at, found, scores = search(queries, ties, rows, np.ascontiguousarray(candidates.T), q_rows, floors, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_rows[at]), q_ids.take(pa.array(at)), ids.take(pa.array(found)), pa.array(rows[found]),
                                                  pa.array(scores)], schema=schema)
    return run


def _blocks(rows: DataFrame, blocks: int, size: int, *columns: str) -> DataFrame:
    """Rows packed into blocks of one dimension count each, dealt by a hash of the row's number; a block that grows too large is cut."""
    dealt = rows.withColumn("dims", F.size("v")).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    place = F.row_number().over(Window.partitionBy("dims", "block").orderBy("row")) - 1
    return dealt.withColumn("cut", F.floor(place / (2 * size))).groupBy("dims", "block", "cut").agg(
        F.collect_list(F.struct(*columns)).alias("rows"))


def _top(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "vec_row"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, pilot: int = CANDIDATES) -> DataFrame:
    """The ``k`` highest inner products of every query: ``query_id, rank, vec_id, score``; ties go to the smaller id.

    Both sides are rows of one table with ``id, v`` as ``quantised`` makes them and ``row``, a number written with the table. Queries meet candidates in blocks: a block of queries is sent to each block of candidates,
    and a pair of blocks is one row of work with bounded memory. A first round over a bounded pilot of candidates gives each query
    a score that its k-th best is sure to reach, so that the blocks of the second round, which cover all candidates, send back
    little. A query's own row is no candidate; other rows with its id are, and each of them asks for itself. Null ids stay and come last among equals.
    Vectors meet only vectors of as many dimensions, and zero dimensions score 0. Empty sides give an empty result.
    """
    ship(candidates.sparkSession)
    spark = candidates.sparkSession
    n, m = max(1, -(-candidates.count() // CANDIDATES)), max(1, -(-queries.count() // QUERIES))
    packed = materialise(_blocks(candidates, n, CANDIDATES, "row", "id", "v").select(
        "dims", "block", "cut", F.col("rows.row").alias("rows"), F.col("rows.id").alias("ids"), F.col("rows.v").alias("v")), "candidates")

    def joined(floors: DataFrame, blocks: DataFrame, upto: int) -> DataFrame:
        known = queries.join(floors, "row", "left").select("row", "id", "v", "floor")
        asking = _blocks(known, m, QUERIES, "row", "id", "v", "floor").select(
            "dims", F.col("rows.row").alias("q_rows"), F.col("rows.id").alias("q_ids"), F.col("rows.v").alias("q"), F.col("rows.floor").alias("floors"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(upto).cast("long"))).alias("block"))
        pairs = asking.join(blocks, ["dims", "block"]).select("q_rows", "q_ids", "q", "floors", "rows", "ids", "v")
        return pairs.mapInArrow(_pairs(k), "row long, query_id long, vec_id long, vec_row long, score long")

    none = spark.range(0).select(F.col("id").alias("row"), F.lit(0.0).alias("floor"))
    first = packed.where("block = 0 AND cut = 0").withColumns({c: F.slice(c, 1, pilot) for c in ("rows", "ids", "v")})
    seen = joined(none, first, 0).groupBy("row").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor"))
    floors = materialise(seen.where(F.col("n") >= k).select("row", "floor"), "floors")
    return _top(joined(floors, packed, n - 1), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
