"""The operators of this package as queries over the given tables: name to (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import (
    bpe,
    decontaminate,
    jaccard,
    language_model,
    line_dedup,
    main_text,
    merkle,
    negatives,
    neighbours,
    quality,
    secrets,
    shards,
    toxicity,
)
from foliary.llm.common import fold, table
from foliary.llm.oracle import SQL
from foliary.session import configure

__all__ = ["QUERIES", "SQL"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


@query
def op1_line_dedup(spark, sf):
    return line_dedup.report(table(spark, sf, "documents"))


@query
def op2_byte_bpe(spark, sf):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(table(spark, sf, "documents"), path, public_tokenizers.PATTERN)


@query
def op3_nearest_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return neighbours.search(vectors, "embedding", F.col("vec_id") % 20 == 0, 20)


@query
def op4_secret_scan(spark, sf):
    return secrets.report(table(spark, sf, "documents"), owner="source", repository="doc_id")


@query
def op5_main_text(spark, sf):
    return main_text.report(table(spark, sf, "pages"))


@query
def op6_toxicity(spark, sf):
    held_out = fold("doc_id", 5) == 0
    return toxicity.report(table(spark, sf, "documents"), table(spark, sf, "labels"), held_out)


@query
def op7_benchmark_windows(spark, sf):
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op8_jaccard_join(spark, sf):
    return jaccard.report(table(spark, sf, "documents"))


@query
def op9_language_model(spark, sf):
    part = language_model.split(fold("doc_id", 7), test=2, kept=3)
    return language_model.score(table(spark, sf, "documents"), part)


@query
def op10_shards(spark, sf):
    return shards.shard_documents(table(spark, sf, "documents"), [1.0] * 8, added=1.0)


@query
def op11_quality_rules(spark, sf):
    return quality.report(table(spark, sf, "documents"))


@query
def op12_merkle_manifest(spark, sf):
    return merkle.report(table(spark, sf, "documents"))


@query
def op13_hard_negatives(spark, sf):
    return negatives.report(table(spark, sf, "embeddings"))
