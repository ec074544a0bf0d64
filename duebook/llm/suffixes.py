"""Removal of repeated passages: interval expansion on the Burrows-Wheeler transform, over the texts that can repeat.

A string of ``length`` bytes is found by its anchor, the ``GRAM``-byte run with the least hash in it, which depends on the string alone. Strings
are told apart by the place of the anchor in them, in ``RANGES`` ranges; all strings of one range share a core of bytes. Strings can
only be equal if their cores are, so cores that occur once are dropped after one aggregate. Where all places of a core have the
same bytes around it, all strings in it repeat. Elsewhere the bytes on both sides, with one symbol for the core between
them, go into a Burrows-Wheeler transform, and the expansion says which strings occur twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import WORD, bitmap, marked, ship, slices, whole_text
from duebook.session import materialise

#: Ranges of anchor places, and the part of the length that an anchor has.
RANGES, GRAM_PART = 4, 8
#: Different surroundings of one core that go into one transform; cores with more are split into finer ones.
SURROUNDINGS = 20_000
#: Symbols of one transform.
SYMBOLS = 1 << 18

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = 0xBF58476D1CE4E5B9
_BITS = 24
_LOW = (1 << _BITS) - 1
_WORD = re.compile(WORD.encode())


# ---- the transform -------------------------------------------------------------------------------------------------------------

def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the place of every suffix in that order; the prefixes compared double until all suffixes differ."""
    n = len(symbols)
    rank, done = symbols, 0
    while True:
        if done:
            key = rank * (n + 1)
            key[:n - done] += rank[done:] + 1
        else:
            key = symbols
        order = np.argsort(key)
        values = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (values[1:] != values[:-1]).astype(np.int64)]))
        if rank[order[-1]] == n - 1:
            return order, rank
        done = 2 * done or 1


def bounded_prefixes(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes and, for each, the symbols it shares with the one before, where these are fewer than ``least``.

    Breadth-first: the interval of a string w is extended backward by every symbol before its suffixes. The interval of cw ends where a suffix
    begins that does not start with cw, so the first time that end is reached its common prefix is the length of w. Lengths come in
    increasing order; an end reached before is not followed again; expansion stops at ``least``, and what is not reached by
    then shares at least so many symbols (-1).
    """
    n = len(symbols)
    order, place = suffix_order(symbols)
    before = np.where(order > 0, symbols[order - 1], -1 - np.int64(n))  # the transform; the first suffix has its own symbol
    target = place[order - 1]
    by = np.argsort(before, kind="stable")
    same = before[by][1:] == before[by][:-1]
    following, previous = np.full(n, n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    following[by[:-1][same]] = by[1:][same]
    previous[by[1:][same]] = by[:-1][same]
    shared = np.full(n + 1, -1, dtype=np.int64)
    shared[0] = shared[n] = 0
    lows, highs = np.array([0]), np.array([n - 1])
    for length in range(least):
        if not len(lows):
            break
        sizes = highs - lows + 1
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lows, sizes)
        low_of, high_of = np.repeat(lows, sizes), np.repeat(highs, sizes)
        there = order[within] > 0
        firsts = within[there & (previous[within] < low_of)]
        lasts = within[there & (following[within] > high_of)]
        # Intervals of one length do not overlap, so in order of place the first and the last of each stand side by side.
        low, high = np.sort(target[firsts]), np.sort(target[lasts])
        new = shared[high + 1] < 0
        shared[high[new] + 1] = length
        lows, highs = low[new], high[new]
    return order, shared[:n]


def repeated(symbols: np.ndarray, least: int) -> np.ndarray:
    """Whether the ``least`` symbols from each place on also start anywhere else."""
    order, shared = bounded_prefixes(symbols, least)
    with_before = shared < 0
    found = with_before.copy()
    found[:-1] |= with_before[1:]
    out = np.zeros(len(symbols), dtype=bool)
    out[order] = found
    return out


# ---- strings that can repeat ---------------------------------------------------------------------------------------------------

class Cutter:
    """Finds the anchors of a text and describes, for every range of places, the core and what surrounds it."""

    def __init__(self, length: int):
        self.length, self.gram = length, max(1, length // GRAM_PART)
        self.window = length - self.gram + 1
        self.spread = -(-self.window // RANGES)  # places of one range
        self.size, self.powers, self.inverse = 0, (), ()

    def _grow(self, size: int) -> None:
        if size > self.size:
            self.size = 1 << max(16, (size - 1).bit_length())
            steps = []
            for base in (*_BASES, *(pow(b, -1, 1 << 64) for b in _BASES)):
                powers = np.full(self.size, base, dtype=np.uint64)
                powers[0] = 1
                steps.append(np.multiply.accumulate(powers))
            self.powers, self.inverse = steps[:2], steps[2:]

    def sums(self, data: bytes) -> list[np.ndarray]:
        """Running sums of the bytes' codes under both bases, from which ``_sum`` has the hash of any stretch."""
        n = len(data)
        self._grow(n + 1)
        codes = (np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
        codes ^= codes >> np.uint64(31)
        return [np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * p[:n], dtype=np.uint64)]) for p in self.powers]

    def _sum(self, sums: np.ndarray, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        hashes = (sums[stop] - sums[start]) * self.inverse[which][start]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(_MIX)
        return hashes ^ (hashes >> np.uint64(32))

    def anchors(self, hashes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of the least hash of every window, the rightmost of equals: distinct places and the first window of each."""
        places, firsts, step = [], [], _LOW - self.window
        for start in range(0, windows, step):
            part = hashes[start:start + step + self.window - 1]
            least = (part & np.uint64((1 << 64) - 1 - _LOW)) | (np.uint64(_LOW) - np.arange(len(part), dtype=np.uint64))
            done = 1
            while done < self.window:
                shift = min(done, self.window - done)
                least = np.minimum(least[:-shift], least[shift:])
                done += shift
            new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            places.append((np.uint64(_LOW) - (least[new] & np.uint64(_LOW))).astype(np.int64) + start)
            firsts.append(new + start)
        return np.concatenate(places), np.concatenate(firsts)

    def cut(self, data: bytes) -> tuple[np.ndarray, ...] | None:
        """``core hash, surroundings hash, start of the core, bytes on its left, bytes on its right`` of every range in use."""
        n, length = len(data), self.length
        if n < length:
            return None
        sums = self.sums(data)
        grams = (sums[0][self.gram:] - sums[0][:n - self.gram + 1]) * self.inverse[0][:n - self.gram + 1]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(_MIX)
        windows = n - length + 1
        places, firsts = self.anchors(grams[:windows + self.window - 1], windows)
        lasts = np.append(firsts[1:], windows) - 1
        low, high = (places - lasts) // self.spread, (places - firsts) // self.spread
        counts = high - low + 1
        place = np.repeat(places, counts)
        number = np.repeat(low, counts) + np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)
        more = self.spread - 1
        start = place - number * self.spread
        stop = start - more + length
        left, right = np.minimum(start, more), np.minimum(n - stop, more)
        core = self._sum(sums[0], 0, start, stop) + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASES[1])
        around = self._sum(sums[1], 1, start - left, stop + right) + (left * 65536 + right).astype(np.uint64) * np.uint64(_BASES[0])
        return core.view(np.int64), around.view(np.int64), start, left, right


def _keys(text: Column) -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]


def repeated_cores(texts: DataFrame, length: int) -> DataFrame:
    """``core, n, same`` of the cores that occur at two places or more; ``same`` says that all places have the same surroundings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(length)
        for part in slices(batches):
            found = [x[:2] for value in part.column(0).to_pylist() if (x := cutter.cut(value.encode())) is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["core", "around"])
    counts = texts.select("text").mapInArrow(run, "core long, around long").groupBy("core").agg(
        F.count("*").alias("n"), F.min("around").alias("least"), F.max("around").alias("most"))
    return counts.where("n > 1").select("core", "n", (F.col("least") == F.col("most")).alias("same"))


def places_of(texts: DataFrame, cores: DataFrame, length: int) -> DataFrame:
    """Every place of a repeated core: ``t1, t2, core, around, at, nl, nr, same, left, right``; bytes on the sides only where places differ.

    Bitmaps of fixed size let the tasks drop most other cores, and most bytes that are not needed, before the join decides.
    """
    repeated, differing = bitmap(cores, "core"), bitmap(cores.where("NOT same"), "core")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(length)
        for part in slices(batches):
            keep: list[list] = [[] for _ in range(9)]
            for t1, t2, value in zip(*(part.column(c).to_pylist() for c in ("t1", "t2", "text")), strict=True):
                data = value.encode()
                if (found := cutter.cut(data)) is None:
                    continue
                core, around, at, nl, nr = found
                known = np.flatnonzero(marked(repeated.value, core))
                if not len(known):
                    continue
                core, around, at, nl, nr = core[known], around[known], at[known], nl[known], nr[known]
                alike = ~marked(differing.value, core)
                width = length - cutter.spread + 1
                keep[0].append(np.full(len(core), t1))
                keep[1].append(np.full(len(core), t2))
                for k, column in enumerate((core, around, at, nl, nr), 2):
                    keep[k].append(column)
                for a, left, right, skip in zip(at.tolist(), nl.tolist(), nr.tolist(), alike.tolist(), strict=True):
                    keep[7].append(None if skip else data[a - left:a])
                    keep[8].append(None if skip else data[a + width:a + width + right])
            if keep[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in keep[:5]] + [pa.array(np.concatenate(x), pa.int32()) for x in keep[5:7]]
                    + [pa.array(x, pa.binary()) for x in keep[7:]], names=["t1", "t2", "core", "around", "at", "nl", "nr", "left", "right"])
    rows = texts.select("t1", "t2", "text").mapInArrow(
        run, "t1 long, t2 long, core long, around long, at long, nl int, nr int, left binary, right binary")
    return rows.join(cores.select("core", "same"), "core").select(
        "t1", "t2", "core", "around", "at", "nl", "nr", "same",
        *[F.when(~F.col("same"), F.col(c)).alias(c) for c in ("left", "right")])


def _transforms(pieces: DataFrame) -> DataFrame:
    """``key, piece, low, high``: places (bytes taken on the left of the core) of the strings that occur twice among the pieces of a key.

    ``pieces`` has ``key, piece, left, right, reach, n``; a string is ``a`` bytes of the left, the core, and ``reach - a`` bytes of the right. Whole keys
    are put into one transform up to ``SYMBOLS`` symbols.
    """
    def solve(rows: list[tuple]) -> Iterator[tuple]:
        reach = rows[0][4]
        lefts = np.array([len(r[2]) for r in rows])
        sizes = lefts + np.array([len(r[3]) for r in rows]) + 2
        ends = np.cumsum(sizes)
        cores = ends - sizes + lefts
        symbols = np.frombuffer(b"".join([b"%b\0%b\0" % (r[2], r[3]) for r in rows]), dtype=np.uint8).astype(np.int64)
        numbers: dict = {}
        symbols[cores] = [256 + numbers.setdefault(r[0], len(numbers)) for r in rows]
        symbols[ends - 1] = 256 + len(numbers) + np.arange(len(rows))
        twice = repeated(symbols, reach + 1)
        for row, core, left in zip(rows, cores.tolist(), lefts.tolist(), strict=True):
            flags = twice[core - left:core + 1][::-1]
            if row[5] > 1:
                flags = np.zeros(left + 1, dtype=bool)
                flags[max(0, reach - len(row[3])):] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
            for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                yield row[0], row[1], low, high - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("piece", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            found = list(zip(*solve(held), strict=True))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, schema.types, strict=True)], schema=schema)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "left", "right", "reach", "n")), strict=True):
                if held and (row[4] != held[-1][4] or size >= SYMBOLS and row[0] != held[-1][0]):
                    yield from out()
                    held, size = [], 0
                held.append(row)
                size += len(row[2]) + len(row[3]) + 2
        if held:
            yield from out()
    ordered = pieces.repartition("key").sortWithinPartitions("reach", "key")
    return ordered.select("key", "piece", "left", "right", "reach", "n").mapInArrow(run, "key string, piece long, low int, high int")


def _split(pieces: DataFrame) -> DataFrame:
    """Each piece as two, for the strings that take few and many bytes of its left; bytes that all strings of a half take join its core."""
    reach, half = F.col("reach"), F.floor(F.col("reach") / 2).cast("int")
    left, right = F.length("left"), F.length("right")

    def part(column: str, start: Column, size: Column) -> Column:
        return F.substring(F.col(column), start + 1, F.greatest(size, F.lit(0)))

    def key(mark: str, bytes_taken: Column) -> Column:
        return F.md5(F.concat(F.encode(F.concat("key", F.lit(mark)), "UTF-8"), bytes_taken))
    few = pieces.where(right >= reach - half).select(
        "core", "around", "n", "base", key("0", part("right", F.lit(0), reach - half)).alias("key"),
        part("left", F.greatest(left - half, F.lit(0)), half).alias("left"), part("right", reach - half, half).alias("right"), half.alias("reach"))
    rest = reach - half - 1
    many = pieces.where(left >= half + 1).select(
        "core", "around", "n", (F.col("base") + half + 1).alias("base"), key("1", part("left", left - half - 1, half + 1)).alias("key"),
        part("left", F.greatest(left - half - 1 - rest, F.lit(0)), F.least(rest, left - half - 1)).alias("left"),
        part("right", F.lit(0), rest).alias("right"), rest.alias("reach"))
    return few.unionByName(many).withColumn("piece", F.xxhash64("left", F.lit(0), "right"))


def _refined(pieces: DataFrame, most: int) -> DataFrame:
    """Repeated strings of cores with very many surroundings: ``core, around, low, high``, by halving ranges until every group is small."""
    done = None
    pieces = pieces.select("core", "around", "n", F.lit(0).alias("base"), F.col("core").cast("string").alias("key"), "left", "right", "reach")
    while True:
        pieces = materialise(_split(pieces), "pieces")
        kinds = pieces.groupBy("key", "piece").agg(F.sum("n").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"),
                                                   F.first("reach").alias("reach"))
        groups = materialise(kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1"), "groups")
        alike = kinds.join(groups.where("kinds = 1"), "key").select(
            "key", "piece", F.greatest(F.col("reach") - F.length("right"), F.lit(0)).cast("int").alias("low"), F.length("left").cast("int").alias("high")) \
            .where("low <= high")
        small = kinds.join(groups.where((F.col("kinds") > 1) & (F.col("kinds") <= most)).select("key"), "key")
        found = pieces.select("core", "around", "key", "piece", "base").join(alike.unionByName(_transforms(small)), ["key", "piece"]).select(
            "core", "around", (F.col("base") + F.col("low")).cast("int").alias("low"), (F.col("base") + F.col("high")).cast("int").alias("high"))
        found = materialise(found, "found")
        done = found if done is None else done.unionByName(found)
        large = groups.where(F.col("kinds") > most).select("key")
        if large.isEmpty():
            return done
        pieces = pieces.join(large, "key").drop("piece")


def repeated_spans(texts: DataFrame, length: int = 400, most: int | None = None) -> DataFrame:
    """``t1, t2, spans``: stretches of bytes of each text that lie in a string of ``length`` bytes that starts at another place too.

    ``texts`` has ``t1, t2, text``; equal texts are places of their own. Spans of a text may overlap.
    """
    ship(texts.sparkSession)
    most = SURROUNDINGS if most is None else most
    reach = Cutter(length).spread - 1
    cores = materialise(repeated_cores(texts, length), "cores")
    places = materialise(places_of(texts, cores, length), "places")
    around = places.where("NOT same").groupBy("core", "around").agg(
        F.first("left").alias("left"), F.first("right").alias("right"), F.count("*").alias("n")).withColumn("reach", F.lit(reach))
    hot = cores.where((F.col("n") > most) & ~F.col("same"))
    if hot.isEmpty():
        marks = _marks(around)
    else:
        around = materialise(around, "surroundings")
        crowded = materialise(around.groupBy("core").agg(F.count("*").alias("kinds")).where(F.col("kinds") > most).select("core"), "crowded")
        marks = _marks(around.join(crowded, "core", "left_anti")).unionByName(_refined(around.join(crowded, "core"), most))
    found = places.where("NOT same").select("t1", "t2", "core", "around", "at").join(marks, ["core", "around"]).select(
        "t1", "t2", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("stop"))
    alike = places.where("same").select("t1", "t2", (F.col("at") - F.col("nl")).alias("start"),
                                        (F.col("at") - F.greatest(F.lit(reach) - F.col("nr"), F.lit(0)) + length).alias("stop"))
    return found.unionByName(alike).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def _marks(around: DataFrame) -> DataFrame:
    pieces = around.select(F.col("core").cast("string").alias("key"), F.col("around").alias("piece"), "left", "right", "reach", "n")
    return _transforms(pieces).select(F.col("key").cast("long").alias("core"), F.col("piece").alias("around"), "low", "high")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def runs_of_words(data: bytes, spans: list[tuple[int, int]], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of every run of ``words`` whole words that lies in one of the spans, which are merged."""
    if sum(stop - start for start, stop in spans if stop - start >= 2 * words - 1) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ends = np.array([m.span() for m in _WORD.finditer(data)], dtype=np.int64).reshape(-1, 2)
    start, stop = ends[:max(0, len(ends) - words + 1), 0], ends[words - 1:, 1]
    lows, highs = np.array(spans, dtype=np.int64).T
    at = np.searchsorted(lows, start, side="right") - 1
    inside = (at >= 0) & (stop <= highs[at])
    return start[inside], stop[inside]


def repeated_words(texts: DataFrame, spans: DataFrame, words: int) -> DataFrame:
    """``t1, t2, spans``: the runs of ``words`` whole words that also stand at another place, looked for in the spans alone.

    A run that repeats is a string that repeats, so it lies in a span at all its places; a span can also come from several shorter
    strings, whose words do not repeat as one run.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(2 * words - 1)
        for part in slices(batches):
            for t1, t2, text, own in zip(*(part.column(c).to_pylist() for c in ("t1", "t2", "text", "spans")), strict=True):
                data = text.encode()
                start, stop = runs_of_words(data, merged([(s["start"], s["stop"]) for s in own]), words)
                if not len(start):
                    continue
                sums = cutter.sums(data)
                run = cutter._sum(sums[0], 0, start, stop) + (stop - start).astype(np.uint64) * np.uint64(_BASES[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(start), t1)), pa.array(np.full(len(start), t2)), pa.array(run.view(np.int64)), pa.array(start), pa.array(stop)],
                    names=["t1", "t2", "run", "start", "stop"])
    found = texts.join(spans, ["t1", "t2"]).select("t1", "t2", "text", "spans").mapInArrow(run, "t1 long, t2 long, run long, start long, stop long")
    found = materialise(found, "runs")
    twice = found.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run")
    return found.join(twice, "run", "left_semi").groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that they hold in part."""
    out = []
    for start, stop in spans:
        while start < stop and data[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        if start < stop:
            out.append((start, stop))
    return out


def remove_repeats(documents: DataFrame, length: int = 400, characters: bool = False, most: int | None = None, words: int | None = None) -> DataFrame:
    """All columns of the input, with ``kept`` (bytes left), ``removed`` (spans of bytes, in order) and ``left`` beside them.

    ``left`` is what is left as text, without the characters of which a part has gone. They take the place of input columns of these names.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another; overlapping strings
    count, and strings are judged on the input. Null text is empty; texts shorter than ``length`` stay as they are; copies of a
    text of at least ``length`` bytes all go whole. With ``characters``, characters that a span holds in part stay. With ``words``, a byte
    only goes if it lies in a run of so many whole words that starts anywhere else too; the least length of such a run is
    ``2 * words - 1`` bytes, and ``length`` must not be more.
    """
    ship(documents.sparkSession)
    names = [c for c in documents.columns if c not in ("kept", "removed", "left")]
    texts = documents.select(whole_text().alias("text")).select(*_keys(F.col("text")), "text")
    spans = repeated_spans(texts, length, most)
    if words is not None:
        if length > 2 * words - 1:
            raise ValueError(f"{words} words can take {2 * words - 1} bytes, fewer than {length}")
        spans = repeated_words(texts, spans, words)
    spans = spans.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "spans")
    # The text is carried once, in its row.
    text = F.coalesce(F.col("row.text"), F.lit(""))
    carried = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    keyed = carried.select("row", F.xxhash64(text).alias("_t1"), F.xxhash64(text, F.lit(1)).alias("_t2"))

    @F.arrow_udf("kept binary, removed array<struct<start:long,stop:long>>, left string")
    def cut(text: pa.Array, found: pa.Array) -> pa.Array:
        kept, removed, left = [], [], []
        for value, own in zip(text, found, strict=True):
            value = value.as_py()
            data = value.encode()
            gone = merged([(s["start"], s["stop"]) for s in own.as_py()]) if own.is_valid else []
            gone = whole_characters(data, gone) if characters else gone
            ends = [0, *[x for span in gone for x in span], len(data)]
            pieces = [data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]
            kept.append(b"".join(pieces))
            removed.append([{"start": a, "stop": b} for a, b in gone])
            left.append("".join(p.decode("utf-8", "ignore") for p in pieces) if gone else value)
        span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.list_(span)), pa.array(left, pa.string())], names=["kept", "removed", "left"])
    joined = keyed.join(spans, ["_t1", "_t2"], "left")
    return joined.select("row", cut(text, "spans").alias("cut")).select("row.*", "cut.kept", "cut.removed", "cut.left")

