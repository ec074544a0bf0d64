"""Document fingerprints by winnowing, and how alike they are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import ship, whole_text

#: Characters of a gram and grams of a window: texts that share GRAM + WINDOW - 1 characters share a selected gram.
GRAM, WINDOW = 20, 61
#: Rows of one range of ids; there are at most ``RANGES`` ranges, whose lower ends are sent to all tasks (8 bytes each).
RANGE_ROWS, RANGES = 4096, 1_000_000

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_BITS = 24  # of a key that hold the place; the others hold the hash
_LEFT = (1 << _BITS) - 1


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(size, base, dtype=np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def gram_hashes(text: str, gram: int = GRAM) -> np.ndarray:
    """A hash of every run of ``gram`` characters; a shorter text is one gram, an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    n = len(codes)
    if not n:
        return codes
    gram = min(gram, n)
    size = 1 << max(14, (n - 1).bit_length())
    powers, inverse = _powers(size)
    codes = (codes + np.uint64(1)) * np.uint64(_MIX)
    codes ^= codes >> np.uint64(31)
    sums = np.cumsum(codes * powers[:n], dtype=np.uint64)
    sums[gram:] -= sums[:n - gram].copy()
    hashes = sums[gram - 1:] * inverse[:n - gram + 1]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(_MIX)
    hashes ^= hashes >> np.uint64(32)
    return hashes


def _selected(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every window, the rightmost of equals; fewer hashes than a window make one window."""
    n = len(hashes)
    least = (hashes & np.uint64((1 << 64) - 1 - _LEFT)) | (np.uint64(_LEFT) - np.arange(n, dtype=np.uint64))
    done = 1
    window = min(window, n)
    while done < window:
        step = min(done, window - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    keys = least[np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))]
    return np.uint64(_LEFT) - (keys & np.uint64(_LEFT))


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (40 bits) of the selected grams and their places, in order of place."""
    hashes = gram_hashes(text, gram)
    parts, step = [], _LEFT - window
    for start in range(0, max(1, len(hashes) - window + 1), step):
        part = hashes[start:start + step + window - 1]
        if len(part):
            parts.append(_selected(part, window).astype(np.int64) + start)
    places = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    return hashes[places] >> np.uint64(_BITS), places


def written(hashes: np.ndarray, places: np.ndarray) -> str:
    """A fingerprint as text: ``hash@place`` for every selected gram."""
    return " ".join([f"{h:010x}@{p}" for h, p in zip(hashes.tolist(), places.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of distinct hashes that two fingerprints have in common, of all they have; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def range_starts(documents: DataFrame, rows: int = RANGE_ROWS) -> list[int]:
    """Lower ends of id ranges of about ``rows`` rows, all of them ids that occur; null counts as the least id."""
    ids = documents.select(_order().alias("id"))
    ranges = min(RANGES, max(1, -(-ids.count() // rows)))
    ends = ids.repartitionByRange(ranges, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("id"))
    return sorted(r["id"] for r in ends.collect())


def _order():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def with_next(documents: DataFrame) -> DataFrame:
    """``bucket, copy, doc_id, text``: every range of ids with the first document of the next range as a copy behind it.

    The last range gets the first document of all. Texts move once; only the lower ends of the ranges reach the driver.
    """
    ship(documents.sparkSession)
    starts = range_starts(documents)
    spark = documents.sparkSession
    ends = spark.sparkContext.broadcast(np.array(starts, dtype=np.int64))

    @F.pandas_udf("long")
    def bucket(ids):
        import pandas as pd
        return pd.Series(np.searchsorted(ends.value, ids.to_numpy(), side="right") - 1)

    @F.pandas_udf("boolean")
    def first(ids):
        import pandas as pd
        return pd.Series(np.isin(ids.to_numpy(), ends.value))
    rows = documents.select("doc_id", whole_text().alias("text")).withColumn("id", _order())
    placed = rows.withColumn("own", bucket("id")).withColumn("first", first("id"))
    before = F.pmod(F.col("own") - 1, F.lit(max(1, len(starts))).cast("long"))
    places = F.when(F.col("first"), F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("copy")),
                                            F.struct(before.alias("bucket"), F.lit(True).alias("copy")))) \
        .otherwise(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("copy"))))
    return placed.select(F.explode(places).alias("place"), "id", "doc_id", "text").select(
        "place.bucket", "place.copy", "id", "doc_id", "text")


def fingerprints(documents: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    The edited text has the last floor(n / 2) of its n characters replaced by the first as many (or all) of the next document, in order of
    ``doc_id``, after the last the first. Null text is empty, an empty text has an empty fingerprint. A null id comes before all
    others; rows of equal id follow each other in order of text. Fingerprints list ``hash@place``; a text shorter than a gram is one
    gram, one with fewer grams than a window is one window. Documents of a range are read in order, one after the other.
    """
    ship(documents.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, id, text, fingerprint of the document before

        def finished(doc_id, text, own, after, print_after):
            half = len(text) // 2
            edited = text[:len(text) - half] + after[:half]
            other = winnow(edited, gram, window)
            mine, theirs, following = (np.unique(x[0]) for x in (own, other, print_after))
            return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
                    "fingerprint": written(*own), "edited_fingerprint": written(*other),
                    "near_edited": likeness(mine, theirs), "near_next": likeness(mine, following)}

        for batch in batches:
            out = []
            for bucket, copy, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "copy", "doc_id", "text")), strict=True):
                seen_last = held is not None and held[0] == bucket and held[4]
                if seen_last:
                    continue  # a further copy of the next range's first document
                own = winnow(text, gram, window)
                if held is not None and held[0] == bucket:
                    out.append(finished(held[1], held[2], held[3], text, own))
                held = (bucket, doc_id, text, own, copy)
                if len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    text = pa.string()
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", text), ("fingerprint", text),
                        ("edited_fingerprint", text), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    ordered = with_next(documents).repartition("bucket").sortWithinPartitions("bucket", "copy", "id", "text")
    return ordered.select("bucket", "copy", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
