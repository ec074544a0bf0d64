"""Approximate nearest neighbours by inner product: hashing that counts collisions.

Each vector is projected onto a few random lines. A block of candidates keeps its projections as one sorted array per line. Around a query's
own projection a window opens in every array; windows of all lines grow together from level to level, which stands for hashing anew with wider
buckets. A candidate that lies in the windows of enough lines is verified by its inner product. A query is done with a block when its windows
reach the distance of its k-th best vector so far times a factor: a vector as near as that collides on enough lines with high probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duebook.llm.common import ship
from duebook.session import materialise

#: Lines, half-width of the last window over the distance of the k-th best, and collisions that have a vector verified. A vector at that distance
#: lies in a window with probability 0.683, so it has 22 collisions of 40 with probability 0.973, nearer ones with more.
LINES, REACH, COLLISIONS = 40, 1.0, 22
#: A window's half-width grows by this factor from level to level.
GROWTH = 1.3
#: Vectors of a block, components of a row that carries some of them, queries that meet a block in one unit of work, steps of length in an octave.
BLOCK, TILE, GROUP, STEPS = 8192, 4096, 2048, 4
SEED = 20


def lines(dims: int, count: int = LINES, seed: int = SEED) -> np.ndarray:
    """``count`` random lines for vectors of ``dims`` dimensions and the one added to them; the same in every task."""
    return np.random.Generator(np.random.PCG64([seed, dims])).standard_normal((count, dims + 1))


def usable(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id, v, norm`` of the vectors that take part: not null, without null or non-finite components, not all zeros."""
    whole = F.transform(F.col(embedding), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # Divided by the largest component, squares neither overflow nor vanish.
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    norm = F.col("largest") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("largest")) * (x / F.col("largest"))))
    return vectors.select(F.col(key).cast("long").alias("id"), whole.alias("v")).where(F.col("v").isNotNull() & finite) \
        .withColumn("largest", largest).where("largest > 0").select("id", "v", norm.alias("norm"))


class Block:
    """Candidates with one sorted array of projections per line."""

    def __init__(self, rows: np.ndarray, ids: pa.Array, vectors: np.ndarray):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.ties = pc.fill_null(ids, 2 ** 63 - 1).to_numpy()
        self.scale = float(np.abs(vectors).max(initial=0)) or 1.0
        unit = vectors / self.scale
        squares = (unit ** 2).sum(1)
        self.longest = float(np.sqrt(squares.max(initial=0))) or 1.0
        # One more component makes all vectors equally long, so that the largest inner product is the least distance.
        added = np.sqrt(np.maximum(self.longest ** 2 - squares, 0)) / self.longest
        self.axes = lines(vectors.shape[1])
        projected = (np.column_stack([unit / self.longest, added]) @ self.axes.T).T
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, 1)

    def search(self, queries: np.ndarray, rows: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and scores of the best ``k`` vectors found for each query, ties to the smaller id; none below the query's ``floor``, a score that
        its k-th best reaches, or not a number where none is known: then windows grow until ``k`` are found or all are seen."""
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.abs(queries).max(1)
            unit = queries / size[:, None]
            length = np.sqrt((unit ** 2).sum(1))
            most = size * length * self.scale * self.longest
            per_score = np.divide(1.0, most, out=np.zeros(len(most)), where=most > 0)
            at = (unit / length[:, None]) @ self.axes[:, :-1].T
        known = ~np.isnan(floors)
        last = np.where(known, REACH * np.sqrt(np.maximum(0, 2 - 2 * np.minimum(1, np.where(known, floors, 0) * per_score))), np.inf)
        width = np.where(known, np.maximum(last / GROWTH ** 2, 1e-3), 0.3)
        floors = np.where(known, floors, -np.inf)
        low, high = np.zeros((2, len(queries), LINES), dtype=np.int64)
        counts = [np.zeros(len(self.rows), dtype=np.int64) for _ in queries]
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in queries]
        active, opened = np.flatnonzero(floors * per_score <= 1 + 1e-9), False
        while len(active):
            width[active] = np.minimum(width[active], last[active])
            edges = at[active] - width[active, None], at[active] + width[active, None]
            new_low = np.column_stack([s.searchsorted(x, "left") for s, x in zip(self.sorted, edges[0].T)])
            new_high = np.column_stack([s.searchsorted(x, "right") for s, x in zip(self.sorted, edges[1].T)])
            ended = []
            for i, q in enumerate(active):
                if opened:
                    runs = [o[a:b] for o, a, b in zip(self.order, new_low[i], low[q])] + [o[a:b] for o, a, b in zip(self.order, high[q], new_high[i])]
                else:
                    runs = [o[a:b] for o, a, b in zip(self.order, new_low[i], new_high[i])]
                more = np.bincount(np.concatenate(runs), minlength=len(self.rows))
                fresh = np.flatnonzero((counts[q] < COLLISIONS) & (counts[q] + more >= COLLISIONS) & (self.rows != rows[q]))
                counts[q] += more
                scored = np.einsum("ij,j->i", self.vectors[fresh], queries[q])
                keep = scored >= floors[q]
                places, scores = np.concatenate([found[q][0], fresh[keep]]), np.concatenate([found[q][1], scored[keep]])
                if len(scores) >= k:
                    best = np.partition(scores, len(scores) - k)[len(scores) - k]
                    places, scores = places[scores >= best], scores[scores >= best]
                    if len(scores) > k:
                        first = np.lexsort((self.rows[places], self.ties[places], -scores))[:k]
                        places, scores = places[first], scores[first]
                    last[q] = min(last[q], REACH * np.sqrt(max(0.0, 2 - 2 * min(1.0, best * per_score[q]))))
                found[q] = places, scores
                if width[q] >= last[q] or (new_high[i] - new_low[i]).min() == len(self.rows):
                    ended.append(q)
            low[active], high[active] = new_low, new_high
            width[active] *= GROWTH
            opened, active = True, np.setdiff1d(active, ended)
        return found


_FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("vec_row", pa.int64()), ("score", pa.float64())])
FOUND = "row long, query_id long, vec_id long, vec_row long, score double"


def _matrix(scalar: pa.ListScalar) -> np.ndarray:
    rows = scalar.values
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _search(k: int):
    """Task function: of each unit first the rows that carry its block, then those that carry queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, tiles, block = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                this = batch.column("unit")[i].as_py(), batch.column("group")[i].as_py()
                if unit != this:
                    unit, tiles, block = this, [], None
                rows, ids, vectors = batch.column("rows")[i].values.to_numpy(), batch.column("ids")[i].values, _matrix(batch.column("v")[i])
                if not batch.column("asks")[i].as_py():
                    tiles.append((rows, ids, vectors))
                    continue
                if block is None:
                    block = Block(np.concatenate([t[0] for t in tiles]), pa.concat_arrays([t[1] for t in tiles]), np.concatenate([t[2] for t in tiles]))
                    tiles = []
                found = block.search(vectors, rows, batch.column("floors")[i].values.to_numpy(zero_copy_only=False).astype(np.float64), k)
                n = [len(places) for places, _ in found]
                places = np.concatenate([places for places, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, n)), ids.take(pa.array(np.repeat(np.arange(len(rows)), n))),
                                                  block.ids.take(pa.array(places)), pa.array(block.rows[places]),
                                                  pa.array(np.concatenate([scores for _, scores in found]))], schema=_FOUND)
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every query; ties go to the smaller id, null ids last, then to the earlier row."""
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "vec_row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _tiles(rows: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """Vectors of a group in rows of ``TILE`` components or one vector."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("row")) - 1
    tile = F.floor(place / F.greatest(F.lit(1), F.floor(TILE / F.greatest(F.col("dims"), F.lit(1)))))
    return rows.withColumn("tile", tile).groupBy(*by, "tile").agg(F.collect_list(F.struct("row", "id", *columns)).alias("x"))


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for every query, largest first; ties go to the smaller id.

    Both sides are rows of one table with ``id, v, norm`` as ``usable`` makes them and ``row``, a number written with the table; a query's own row is no
    candidate, other rows with its id are. Candidates are put in order of length, so that a block holds vectors of like length: it is passed over
    where its longest vector cannot reach the score that a first round over one block gave the query. A block's index holds every row.
    What is found is approximate, its scores are exact; all candidates within reach of their query are found with probability 0.973 or more each.

    Fewer than ``k`` candidates are all returned. Vectors meet vectors of as many dimensions only. Repeated rows count one by one, null ids stay and come
    last among equals. Empty sides give an empty result. Each unit of work holds one block and one tile of queries at a time.
    """
    spark = candidates.sparkSession
    ship(spark)
    # Lengths in steps of a part of an octave, each dealt over as many blocks as its vectors fill.
    step = F.floor(F.log2("norm") * STEPS + 0.5).cast("long")
    rows = candidates.withColumn("dims", F.size("v")).withColumn("step", step)
    fill = rows.groupBy("dims", "step").agg(F.count("*").alias("filled"), F.max("norm").alias("longest")) \
        .withColumn("blocks", F.ceil(F.col("filled") / BLOCK).cast("long"))
    blocks = materialise(fill.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn(
        "unit", F.monotonically_increasing_id()), "blocks")
    named = blocks.where("block = 0").select("dims", "step", "blocks")
    dealt = rows.join(named, ["dims", "step"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    units = blocks.select("dims", "step", "block", "unit")
    packed = materialise(_tiles(dealt, ["dims", "step", "block"], "v").join(units, ["dims", "step", "block"]).select(
        "unit", F.lit(False).alias("asks"), "tile", F.col("x.row").alias("rows"), F.col("x.id").alias("ids"), F.col("x.v").alias("v"),
        F.lit(None).cast("array<double>").alias("floors")), "tiles")
    groups = max(1, -(-queries.count() // GROUP))

    def met(asked: DataFrame, reached: DataFrame) -> DataFrame:
        """What the queries find in the blocks that are reached."""
        dealt = asked.withColumn("dims", F.size("v")).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
        tiles = _tiles(dealt, ["dims", "group"], "v", "norm", "floor").withColumn(
            "least", F.array_min(F.transform("x", lambda q: F.coalesce(q["floor"] / q["norm"], F.lit(float("-inf"))))))
        asking = tiles.join(reached.select("dims", "unit", "longest"), "dims").where(F.col("longest") * 1.000001 >= F.col("least")).select(
            "unit", "group", F.lit(True).alias("asks"), "tile", F.col("x.row").alias("rows"), F.col("x.id").alias("ids"), F.col("x.v").alias("v"),
            F.transform("x", lambda q: F.coalesce(q["floor"], F.lit(float("nan")))).alias("floors"))
        asked_of = asking.select("unit", "group").distinct()
        both = packed.join(asked_of, "unit").select(*asking.columns).unionByName(asking)
        in_order = both.repartitionByRange("unit", "group").sortWithinPartitions("unit", "group", "asks", "tile")
        return in_order.drop("tile").mapInArrow(_search(k), FOUND)

    # The first round meets the block of each dimension count that is dealt from the fullest step.
    first = blocks.groupBy("dims").agg(F.max_by("unit", F.struct("filled", "step", "block")).alias("unit")).select("unit")
    pilot = materialise(_best(met(queries.withColumn("floor", F.lit(None).cast("double")), blocks.join(first, "unit", "left_semi")), k), "pilot")
    floors = pilot.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("row", "floor")
    found = met(queries.join(floors, "row", "left"), blocks.join(first, "unit", "left_anti"))
    best = _best(found.unionByName(pilot.select(*found.columns)), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
