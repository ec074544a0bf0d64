"""Token counts: pieces counted once per distinct pre-token, joined to the pre-token frequencies of each document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import numbered, ship, slices, whole_text
from duebook.llm.pieces import pieces
from duebook.session import materialise

#: Pre-tokens that are sent to all tasks: at most so many, each of at most so many characters.
FREQUENT, LONGEST = 131_072, 48
#: Distinct pre-tokens that a task counts before it passes them on.
HELD = 400_000


def pretoken_frequencies(documents: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``pretoken, n``: how often each pre-token stands in the table, added up in the tasks first."""
    ship(documents.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = pieces(tokenizer), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"pretoken": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
        for part in slices(batches, 512):
            runs: Counter = Counter()
            for value in part.column(0).to_pylist():
                runs.update(own.runs(value))
            for run, n in runs.items():
                for pretoken in own.pretokens(run):
                    counts[pretoken] += n
            if len(counts) >= HELD:
                yield out()
                counts = Counter()
        yield out()
    return documents.select(whole_text(text)).mapInArrow(run, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(frequencies: DataFrame, tokenizer: str) -> DataFrame:
    """``pretoken, n, pieces``: the model reads each distinct pre-token once; ids are not kept."""
    ship(frequencies.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(tokenizer)
        for part in slices(batches, 8192):
            counts = pa.array(map(own.count, part.column("pretoken").to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("pretoken"), part.column("n"), counts], names=["pretoken", "n", "pieces"])
    return frequencies.mapInArrow(run, "pretoken string, n long, pieces int")


def frequent_pieces(counted: DataFrame, most: int) -> DataFrame:
    """``pretoken, pieces`` of the pre-tokens of up to ``LONGEST`` characters above a frequency that at most ``most`` of them have.

    Frequencies are counted in 16 steps to an octave, at most 1 000 rows, of which whole steps are taken from the top; nothing is sorted.
    """
    short = counted.where(F.length("pretoken") <= LONGEST).withColumn("step", F.floor(F.log2(F.col("n").cast("double")) * 16))
    least, held = None, 0
    for row in sorted(short.groupBy("step").agg(F.count("*").alias("held")).collect(), key=lambda r: -r["step"]):
        held += row["held"]
        if held > most:
            break
        least = row["step"]
    return short.where(F.lit(False) if least is None else F.col("step") >= least).select("pretoken", "pieces")


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, as the tokenizers library counts without added tokens.

    Null text is empty and has no tokens; special strings inside a text count as the library takes them, one token each; repeated rows come out one by one.
    The frequencies of a document meet the piece counts in two ways: the most frequent pre-tokens, of bounded number and length, are sent
    to all tasks and summed where the document is read, all others are joined by a shuffle.
    """
    ship(documents.sparkSession)
    counted = materialise(piece_counts(pretoken_frequencies(documents, tokenizer, text), tokenizer), "pieces")
    frequent = documents.sparkSession.sparkContext.broadcast({r["pretoken"]: r["pieces"] for r in frequent_pieces(counted, FREQUENT).collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, runs = pieces(tokenizer), frequent.value, {}
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sum", pa.int64()),
                            ("pretokens", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])
        for part in slices(batches, 512):
            sums, rare, times = [], [], []
            for value in part.column("text").to_pylist():
                total, others = 0, {}
                for run, n in Counter(own.runs(value)).items():
                    got = runs.get(run)  # pieces of the frequent pre-tokens of a part, and its other pre-tokens
                    if got is None:
                        inside = own.pretokens(run)
                        got = sum(known.get(p, 0) for p in inside), [p for p in inside if p not in known]
                        if not got[1] and len(run) <= LONGEST:
                            if len(runs) >= HELD:
                                runs.clear()
                            runs[run] = got
                    total += n * got[0]
                    for pretoken in got[1]:
                        others[pretoken] = others.get(pretoken, 0) + n
                sums.append(total)
                rare.append(list(others.keys()))
                times.append(list(others.values()))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("n_bytes"), pa.array(sums, pa.int64()),
                                              pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], schema=schema)

    rows = numbered(documents, "doc_id", text).select("row", F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    read = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(
        run, "row long, doc_id long, n_bytes long, sum long, pretokens array<string>, times array<long>")
    read = materialise(read, "frequencies")
    pairs = read.select("row", F.explode(F.arrays_zip("pretokens", "times")).alias("p")).select("row", "p.pretokens", "p.times")
    joined = pairs.join(counted.select("pretoken", "pieces"), F.col("pretokens") == F.col("pretoken"))
    others = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    tokens = F.col("sum") + F.coalesce(F.col("more"), F.lit(0))
    return read.select("row", "doc_id", "n_bytes", "sum").join(others, "row", "left").select(
        "doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
