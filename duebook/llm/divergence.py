"""Divergence of the sources of a language: which words set each source apart, and from which other source how far.

Gustavson's row-by-row product: the index lists for each term the sources that have it. A source goes through its own terms, and each term's list is
scattered into one dense accumulator with a cell per peer. Terms that a source lacks still have a probability, the baseline of zero
occurrences; their share is added in closed form for whole blocks of terms, and what is listed is corrected by what the baseline counted for it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duebook.llm.common import ship, whole_text
from duebook.session import materialise

#: Probabilities are whole numbers of this unit.
UNIT = 1_000_000_000
#: A task hands on its counts after this many entries or bytes of text, cuts longer texts at a blank, and expands so many postings at once.
ENTRIES, READ, CHUNK = 300_000, 32 << 20, 1 << 20
#: Postings of a block of the index: one block is one unit of work.
POSTINGS = 400_000

#: Each byte as terms see it: A-Z lower-cased, letters and all bytes beyond ASCII as they are, the rest a blank.
_FOLD = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("d", pa.int64())])
_SUMS = "lang string, source string, item string, value long"


def _parts(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Terms of a text, of long ones part by part."""
    folded, at = text.translate(_FOLD), 0
    while len(folded) - at > size:
        cut = folded.rfind(b" ", at, at + size)
        cut = cut if cut >= 0 else folded.find(b" ", at + size)
        if cut < 0:
            break
        yield folded[at:cut].split()
        at = cut + 1
    yield (folded[at:] if at else folded).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences ``n`` and documents ``d`` of each term in what a task has read of a source; the empty term marks the source."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    read = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = [b"", *n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                 pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[t] for t in n)], pa.int64())], schema=_COUNTED)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in _parts(text, READ // 8):
                n.update(terms)
                seen.update(terms)
            d.update(seen)
            read += len(text)
            if read > READ:
                yield from given()
                read = 0
        if sum(len(n) for n, _ in held.values()) > ENTRIES:
            yield from given()
            read = 0
    yield from given()


def term_index(documents: DataFrame, min_docs: int = 3, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, term, peers``: the sources that have a term and how often; terms in fewer than ``min_docs`` documents of the language are left out.

    The empty term of a language lists all its sources, those without terms too. Counts are summed in each task before they move.
    """
    ship(documents.sparkSession)
    read = documents.select(whole_text(lang).cast("string").alias("lang"), whole_text(source).cast("string").alias("source"),
                            whole_text(text).cast("binary").alias("text"))
    counted = read.mapInArrow(_count, "lang string, source string, term binary, n long, d long")
    per_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    listed = per_source.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("peers"))
    return listed.where((F.col("d") >= min_docs) | (F.octet_length("term") == 0)).select("lang", F.col("term").cast("string").alias("term"), "peers")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), by long division in steps of a thousand, so that totals up to 9 * 10**15 stay exact."""
    left, whole = count + 1, np.zeros(np.broadcast(count, total).shape, dtype=np.int64)
    for _ in range(3):
        left = left * 1000
        whole = whole * 1000 + left // total
        left = left % total
    return whole + 1


def _share(count: Column, total: Column) -> Column:
    """``shares`` as a column."""
    left, whole = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        whole = whole * 1000 + F.call_function("div", left, total)
        left = left % total
    return whole + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _from_each(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of several runs, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def row_products(term: np.ndarray, peer: np.ndarray, p: np.ndarray, base: np.ndarray, terms: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each source, its divergence from every peer, summed over the terms of a block.

    ``term, peer, p`` are the postings, by term; ``base`` is each source's probability of a term that it lacks.
    """
    first = np.searchsorted(term, np.arange(terms + 1))
    length = np.diff(first)
    by_peer = np.lexsort((p, peer))
    changes = np.flatnonzero(np.r_[True, (np.diff(peer[by_peer]) != 0) | (np.diff(p[by_peer]) != 0)]) if len(peer) else np.zeros(0, dtype=np.int64)
    kind, value, times = peer[by_peer][changes], p[by_peer][changes], np.diff(np.r_[changes, len(peer)])
    has = np.bincount(peer, minlength=len(base))
    bounds = np.searchsorted(kind, np.arange(len(base) + 1))
    rows = np.searchsorted(peer[by_peer], np.arange(len(base) + 1))
    for g in range(len(base)):
        zero = _apart(base[g], base)
        sums = zero * (terms - has[g] - has)
        np.add.at(sums, kind, times * _apart(base[g], value))
        own, own_times = value[bounds[g]:bounds[g + 1]], times[bounds[g]:bounds[g + 1]]
        for at in range(0, len(own), step := max(1, CHUNK // len(base))):
            sums += (own_times[at:at + step, None] * _apart(own[at:at + step, None], base[None, :])).sum(0)
        postings = by_peer[rows[g]:rows[g + 1]]
        for some in np.array_split(postings, max(1, -(-int(length[term[postings]].sum()) // CHUNK))):
            mine = np.repeat(p[some], length[term[some]])
            there = _from_each(first[term[some]], length[term[some]])
            to, q = peer[there], p[there]
            np.add.at(sums, to, _apart(mine, q) - _apart(mine, base[to]) - _apart(base[g], q) + zero[to])
        yield g, sums


def _block(block: pa.Table) -> pa.Table:
    """All pairs of sources over a block of the index. Rows without a term are the sources, with the sums of their counts."""
    head = block.filter(pc.field("head"))
    lang, kept = head["lang"][0].as_py(), head["kept"][0].as_py()
    sources = head["peers"].combine_chunks().flatten()
    names, total = sources.field("source"), sources.field("n").to_numpy(zero_copy_only=False) + kept
    listed = block.filter(~pc.field("head"))["peers"].combine_chunks()
    postings = listed.flatten()
    peer = pc.index_in(postings.field("source"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    term = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
    if kept:
        p = shares(postings.field("n").to_numpy(zero_copy_only=False), total[peer])
        sums = row_products(term, peer, p, shares(np.zeros(len(total), dtype=np.int64), total), len(listed))
    else:
        sums = ((g, np.zeros(len(total), dtype=np.int64)) for g in range(len(total)))
    found = []
    for g, value in sums:
        others = np.delete(np.arange(len(value)), g)
        found.append(pa.table({"lang": pa.array([lang] * len(others), pa.string()), "source": pa.array([names[g].as_py()] * len(others), pa.string()),
                               "item": names.take(pa.array(others)), "value": pa.array(value[others])}))
    return pa.concat_tables(found)


def source_divergence(documents: DataFrame, min_docs: int = 3, top: int = 200, text: str = "text", lang: str = "lang",
                      source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: what sets each source apart from the other sources of its language.

    Terms are runs of letters and of characters beyond ASCII; A-Z are lower-cased. A kept term that stands ``count`` times in a source with
    ``N`` kept occurrences has the probability ``p = 1 + floor(10**9 * (count + 1) / (N + V))``, where the language keeps ``V`` terms. Part ``pair``
    holds for each other source the sum over all kept terms of ``floor((p - q)**2 / q)``, part ``term`` the ``top`` terms of the source that are more
    likely there than in the whole language, with the same measure. Ranks go by value, ties by the bytes of the item. All numbers are exact.

    Null texts, languages and sources count as empty strings. Sources without terms take part with baselines only; a language that keeps no term has
    pairs of value 0. A language with one source has no pairs. Repeated rows count each time. Other columns are not read, so their names may clash;
    an empty table gives an empty result. Blocks of the index are dealt by a hash of the term, so a frequent source or term is spread, and a
    block sends one sum per pair of sources.
    """
    index = materialise(term_index(documents, min_docs, text, lang, source), "terms")
    named, postings = F.col("term") != "", index.select("lang", "term", F.explode("peers").alias("peer")).select("lang", "term", "peer.*")
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = index.groupBy("lang").agg(F.count_if(named).alias("kept"), F.sum(F.when(named, F.size("peers")).otherwise(0)).alias("postings")) \
        .withColumn("blocks", F.ceil((F.col("postings") + 1) / POSTINGS).cast("long"))
    sizes = materialise(totals.join(kept, "lang"), "sources")

    heads = sizes.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("head"), "kept",
                         F.array(F.struct("source", F.col("total").alias("n"))).alias("peers"))
    terms = index.where(named).join(kept.select("lang", "kept", "blocks"), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), F.lit(False).alias("head"), "kept", "peers")
    sums = heads.unionByName(terms).groupBy("lang", "block").applyInArrow(_block, _SUMS)
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    whole = sizes.groupBy("lang").agg((F.sum("total") + F.max("kept")).alias("all"))
    listed = index.where(named).select("lang", "term", F.aggregate("peers", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("count"),
                                       F.explode("peers").alias("peer"))
    likely = listed.select("lang", "term", "count", "peer.*").join(
        sizes.select("lang", "source", (F.col("total") + F.col("kept")).alias("size")), ["lang", "source"]).join(whole, "lang").select(
        "lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("size")).alias("p"), _share(F.col("count"), F.col("all")).alias("q"))
    above = likely.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(
        above.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term")))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
