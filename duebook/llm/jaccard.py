"""Similarity join on word shingles: MinHash bands propose, Bayesian pruning drops, exact set overlap decides."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import bitmap, marked, ship, slices, whole_text
from duebook.llm.graph import components
from duebook.session import materialise

#: Words of a shingle and the least similarity of a link.
WORDS, THRESHOLD = 5, 0.8
#: MinHash values: BANDS of ROWS. A pair at the threshold shares no band with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
#: MinHash values compared at a time, and the posterior probability of reaching the threshold below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6
#: Members of a block: larger buckets and clusters are compared block against block.
BLOCK = 512

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(size, base, dtype=np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes, in order, of all runs of ``words`` words; a shorter text is one run, one without words has none.

    Words are what blanks, tabs and line ends separate.
    """
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    n = len(data)
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.diff(inside)
    start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    powers, inverse = _powers(1 << max(16, n.bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(data.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64)])
    each = _mixed((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
    size = min(words, len(each))
    runs = np.full(len(each) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        runs = _mixed(runs + each[k:len(each) - size + 1 + k])
    return np.unique(runs)


@lru_cache(maxsize=1)
def _permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mixed(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(_BASE))
    return (seeds[:size] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[size:] >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values of a set that is not empty."""
    factor, shift = _permutations(size)
    values, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(values), 512):
        least = np.minimum(least, (values[at:at + 512, None] * factor + shift).min(0))
    return least


def least_matches(threshold: float, tolerance: float, size: int) -> list[int]:
    """For n values compared, the matches below which P(similarity >= threshold) < tolerance, starting from a uniform prior.

    The posterior is Beta(m + 1, n - m + 1); its upper tail at t is the chance of at most m successes in n + 1 draws of chance t.
    """
    t, out = Fraction(str(threshold)), []
    for n in range(size + 1):
        tail, m = Fraction(0), -1
        while tail < Fraction(str(tolerance)) and m < n:
            m += 1
            tail += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def promising(left: np.ndarray, right: np.ndarray | None, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signatures that no step of the comparison drops; within ``left`` if there is no ``right``."""
    other = left if right is None else right
    rows, columns = [], []
    for at in range(0, len(left), 64):
        part = left[at:at + 64]
        same = np.zeros((len(part), len(other)), dtype=np.int16)
        for k in range(STEP):
            same += part[:, k, None] == other[None, :, k]
        a, b = np.nonzero(same >= least[STEP])
        a = a + at
        if right is None:
            a, b = a[a < b], b[a < b]
        count = same[a - at, b].astype(np.int64)
        for start in range(STEP, left.shape[1], STEP):
            count = count + (left[a, start:start + STEP] == other[b, start:start + STEP]).sum(1)
            keep = count >= least[min(start + STEP, left.shape[1])]
            a, b, count = a[keep], b[keep], count[keep]
        rows.append(a)
        columns.append(b)
    return np.concatenate(rows), np.concatenate(columns)


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Common elements of every pair of sets, as products of membership matrices over the elements that several sets hold."""
    sets = left + (right or [])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    number = np.full(len(values), -1, dtype=np.int64)
    number[shared] = np.arange(len(shared))
    element, owner = number[place], np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    known = element >= 0
    element, owner = element[known], owner[known]
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    cut, total = len(left), np.zeros((len(left), len(right or left)), dtype=np.float64)
    for at in range(0, len(shared), 4096):
        low, high = np.searchsorted(element, [at, at + 4096])
        member = np.zeros((len(sets), min(4096, len(shared) - at)), dtype=np.float32)
        member[owner[low:high], element[low:high] - at] = 1
        total += member[:cut] @ (member[:cut] if right is None else member[cut:]).T
    return total.astype(np.int64)


def _stars(a: np.ndarray, b: np.ndarray, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """What the given edges connect, as edges from the least id of each component to its other members."""
    order = np.argsort(np.array(ids))
    label = np.empty(len(ids), dtype=np.int64)
    label[order] = np.arange(len(ids))
    own = label.copy()
    while True:
        near = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, near)
        np.minimum.at(new, b, near)
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    members, values = np.flatnonzero(label != own), np.array(ids)
    return values[order[label[members]]], values[members]


def _blocked(members: DataFrame, group: str, count: str) -> DataFrame:
    """Members of a group dealt to blocks, and every pair of blocks of a group as ``group, one, two`` with its members."""
    blocks = F.ceil(F.col(count) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("s1", F.lit(3)), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other")) \
        .repartition(group, "one", "two").sortWithinPartitions(group, "one", "two", "own")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """Members of both blocks of one pair after the other; the second list is empty for a block with itself."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if row[:3] != key and held:
                yield [r for r in held if r[3] == key[1]], [r for r in held if r[3] != key[1]]
                held = []
            key = row[:3]
            held.append(row)
    if held:
        yield [r for r in held if r[3] == key[1]], [r for r in held if r[3] != key[1]]


def _candidates(members: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect all pairs of a bucket that pruning leaves."""
    least = least_matches(THRESHOLD, TOLERANCE, BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _groups(batches, ["bucket", "one", "two", "own", "s1", "signature"]):
            if not left or (not right and left[0][1] != left[0][2]):
                continue
            values = [np.array([r[5] for r in side], dtype=np.int32) for side in (left, right) if side]
            a, b = promising(values[0], values[1] if right else None, least)
            ids = [r[4] for r in left] + [r[4] for r in right]
            roots, others = _stars(a, b + (len(left) if right else 0), ids)
            if len(roots):
                yield pa.RecordBatch.from_pydict({"a": roots, "b": others}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    return _blocked(members, "bucket", "n_members").select("bucket", "one", "two", "own", "s1", "signature").mapInArrow(run, "a long, b long")


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """``s1, links, b``: links of a class inside one pair of blocks, and edges that connect all linked classes (``links`` 0)."""
    level = Fraction(str(threshold))
    up, down = level.numerator, level.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _groups(batches, ["cluster", "one", "two", "own", "s1", "copies", "elements"]):
            if not left or (not right and left[0][1] != left[0][2]):
                continue
            sides = [[np.frombuffer(r[6], dtype="<u8") for r in side] for side in (left, right)]
            common = overlaps(sides[0], sides[1] if right else None)
            sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in sides]
            union = sizes[0][:, None] + (sizes[1] if right else sizes[0])[None, :] - common
            linked = common * down >= union * up
            copies = [np.array([r[5] for r in side], dtype=np.int64) for side in (left, right)]
            if right:
                sums = [linked @ copies[1], copies[0] @ linked]
            else:
                np.fill_diagonal(linked, False)
                sums = [linked @ copies[0], np.zeros(0, dtype=np.int64)]
            ids = [r[4] for r in left] + [r[4] for r in right]
            a, b = np.nonzero(linked)
            roots, others = _stars(a, b + (len(left) if right else 0), ids)
            total = np.concatenate(sums)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict(
                {"s1": [ids[i] for i in some] + roots.tolist(), "links": [*total[some].tolist(), *[0] * len(roots)],
                 "b": [*[None] * len(some), *others.tolist()]},
                schema=pa.schema([("s1", pa.int64()), ("links", pa.int64()), ("b", pa.int64())]))
    ready = _blocked(members, "cluster", "n_members").select("cluster", "one", "two", "own", "s1", "copies", "elements")
    return ready.mapInArrow(run, "s1 long, links long, b long")


def _set_id(found: np.ndarray) -> int:
    """Identifier of a set: a hash over its elements."""
    import xxhash
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def signatures(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, text_key, s1, n_shingles, signature``: a hash of the text; identifier, size and MinHash values of its shingle set.

    Identifier and values are null for texts without words.
    """
    ship(documents.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, sizes, values = [], [], []
            for text in part.column("text").to_pylist():
                found = shingles(text, words)
                ids.append(_set_id(found) if len(found) else None)
                sizes.append(len(found))
                values.append(signature(found).view(np.int32) if len(found) else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                                              pa.array(values, pa.list_(pa.int32()))], names=["doc_id", "text_key", "s1", "n_shingles", "signature"])
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, s1 long, n_shingles long, signature array<int>")


def _elements(documents: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``s1, elements``: the shingle sets of the wanted classes, one row each. A bitmap of fixed size drops most others before the join decides."""
    sent = bitmap(wanted, "s1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, sets = [], []
            for text in part.column(0).to_pylist():
                found = shingles(text, words)
                if not len(found):
                    continue
                s1 = _set_id(found)
                if not marked(sent.value, np.array([s1]))[0]:
                    continue
                ids.append(s1)
                sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["s1", "elements"])
    rows = documents.select(whole_text()).mapInArrow(run, "s1 long, elements binary")
    return rows.join(wanted.select("s1"), "s1", "left_semi").groupBy("s1").agg(F.first("elements").alias("elements"))


def similarity_join(documents: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text_key, class_id, copy_id, n_links, n_shingles`` for every row.

    Two documents are linked if the Jaccard similarity of their sets of word shingles is ``threshold`` or more. ``n_links`` counts the other
    documents that a document is linked to, ``copy_id`` is the least ``doc_id`` of those with the same set, ``class_id`` the least of all that
    links connect. Texts without words (null, empty, blank) have no links and a class of their own; texts shorter than a shingle are one
    shingle; repeated rows are linked copies.

    Documents with equal sets count as one class until the end. Classes that share a band of MinHash values meet in a bucket; buckets with the
    same members are one. Pairs of a bucket are compared value by value and dropped when they can no longer be similar; what is
    left only connects classes to clusters, inside which all pairs are decided by exact overlap. Buckets and clusters of over
    ``BLOCK`` members are dealt over pairs of blocks; a task passes on sums and stars of what is connected, not pairs.
    """
    return _classes(documents, words, threshold).drop("class_key")


def _classes(documents: DataFrame, words: int, threshold: float) -> DataFrame:
    """The columns of ``similarity_join`` and ``class_key``, which tells classes apart whatever their ids; null for texts without words."""
    ship(documents.sparkSession)
    signed = materialise(signatures(documents, words), "signatures")
    known = signed.where("s1 IS NOT NULL")
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.element_at("signature", b * ROWS + r + 1) for r in range(ROWS)]) for b in range(BANDS)])
    keys = known.select("s1", F.explode(bands).alias("bucket"))
    shared = materialise(keys.groupBy("bucket").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low < high").select("bucket"), "buckets")
    entries = materialise(keys.join(shared, "bucket").distinct(), "entries")
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n_members"), F.sum(F.xxhash64("s1").cast("decimal(38,0)")).alias("members"),
                                          F.sum(F.xxhash64("s1", F.lit(5)).cast("decimal(38,0)")).alias("again"))
    distinct = sizes.groupBy("n_members", "members", "again").agg(F.min("bucket").alias("bucket")).select("bucket", "n_members")
    classes = known.join(entries.select("s1").distinct(), "s1", "left_semi").groupBy("s1").agg(F.first("signature").alias("signature"))
    proposed = _candidates(entries.join(distinct, "bucket").join(classes, "s1"))
    clusters = materialise(components(materialise(proposed, "proposed")).withColumnsRenamed({"id": "s1", "label": "cluster"}), "clusters")
    copies = materialise(known.groupBy("s1").agg(F.count("*").alias("copies"), F.min("doc_id").alias("copy_id")), "copies")
    members = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("n_members")), "cluster").join(copies, "s1") \
        .join(_elements(documents, clusters, words), "s1")
    checked = materialise(_verified(members, threshold), "links")
    links = checked.where("b IS NULL").groupBy("s1").agg(F.sum("links").alias("links"))
    joined = components(checked.where("b IS NOT NULL").select(F.col("s1").alias("a"), "b")).withColumnsRenamed({"id": "s1"})
    least = joined.join(copies, "s1").groupBy("label").agg(F.min("copy_id").alias("class_id"))
    facts = copies.join(links, "s1", "left").join(joined.join(least, "label").select("s1", "label", "class_id"), "s1", "left").select(
        "s1", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("label", "s1").alias("class_key"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "text_key", "s1", "n_shingles").join(facts, "s1", "left").select(
        "doc_id", "text_key", F.when(F.col("s1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("s1").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles", "class_key")


def one_of_each(documents: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near duplicates: of all that links connect, the row of least ``doc_id`` stays, the least text hash deciding ties.

    Rows equal in ``doc_id`` and text count as one. Texts without words and rows without any ``doc_id`` in their class stay.
    """
    found = _classes(documents, words, threshold)
    with_id = found.where("class_key IS NOT NULL AND doc_id IS NOT NULL")
    kept = with_id.groupBy("class_key").agg(F.min(F.struct("doc_id", "text_key")).alias("best")).select("best.*")
    kept = kept.unionByName(found.where("class_key IS NULL OR class_id IS NULL").select("doc_id", "text_key").distinct())
    kept = kept.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").alias("own"), F.xxhash64("text").alias("text_key"))
    same = rows["own"].eqNullSafe(kept["_id"]) & (rows["text_key"] == kept["_key"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["own", "text_key"]).select("row.*")
