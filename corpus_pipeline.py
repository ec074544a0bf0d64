"""The corpus pipeline: five stages over the documents, each written as Parquet and read again for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.llm import bpe, jaccard, mixing, quality, suffixes
from duebook.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a passage that repeats, over 50, and the least bytes that they can take: a byte each and one between two.
PASSAGE_WORDS = 51
PASSAGE = 2 * PASSAGE_WORDS - 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs.select(*COLUMNS), labels).where("quality_keep").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each(docs.select(*COLUMNS))


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 whole words that also stand elsewhere; ``n_chars`` follows the text."""
    cut = suffixes.remove_repeats(docs.select(*COLUMNS), PASSAGE, characters=True, words=PASSAGE_WORDS)
    text = F.when(F.col("text").isNotNull(), F.decode("kept", "UTF-8"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    rows = docs.select(*COLUMNS)
    return mixing.apply_mix(rows, mixing.mix(rows))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    decoded = bpe.encode(docs.select("doc_id", "text"), TOKENIZER, decoded=True)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one_of_each),
    ("suffix_array_dedup", remove_passages),
    ("source_mixing", mix_sources),
    ("bpe_round_trip", encode_and_decode),
]

#: No SQL states the fitted classifier, the pruned join or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
