"""Prepare `documents` for training: every stage calls one operator of `foliary.llm`.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next stage's `docs`. All stages but the last return the columns of `documents`.

1. Documents that the toxicity classifier rejects go.
2. Lines that repeat an earlier line, or nearly, go; a document of which nothing is left goes.
3. Of documents whose word shingles are similar, the one with the smallest id stays.
4. Documents that contain a window of a benchmark item go.
5. Every text is encoded, and decoded again as a proof.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from foliary.llm.common import fold, table
from foliary.session import configure, materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier never learns from a fifth of the labels, so it can be judged on them."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(docs, drop_empty=True)
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def without_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The language and source stay beside the digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(docs, path, public_tokenizers.PATTERN, "lang", "source")


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_similar),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", tokens),
]

#: No SQL: the classifier and the tokenizer can't be written in it; tests use plain models instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1], 1):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
