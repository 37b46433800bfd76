"""The text cache and the searchable corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions.objects import text_address
from foliary.schemas import CORPUS_COLUMNS
from foliary.settings import DEFAULTS


def cache_hits(registry: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Registry rows whose text is stored already."""
    return registry.join(sidecars.select("sha256"), "sha256", "left_semi")


def cache_misses(registry: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Registry rows whose text has yet to be extracted."""
    return registry.join(sidecars.select("sha256"), "sha256", "left_anti")


def sidecar_delta(
    extracted: DataFrame, sidecars: DataFrame, prefix: str = DEFAULTS.text_prefix
) -> DataFrame:
    """Stored-text rows to append: one per hash that has none yet, with its text address."""
    fresh = cache_misses(extracted, sidecars)
    return fresh.withColumn("text_s3_key", text_address(prefix, F.col("sha256")))


def keyword_fields(corpus: DataFrame, limit: int = DEFAULTS.keyword_max_chars) -> DataFrame:
    """The exact-value fields of the corpus; long filenames have no exact value."""
    return corpus.select(
        "sha256",
        "s3_bucket",
        "s3_key",
        "content_type",
        "size_bytes",
        "extractor_version",
        "extracted_at",
        "indexed_at",
        F.when(F.length("filename") <= limit, F.col("filename")).alias("filename_keyword"),
    )


def latest_per_hash(rows: DataFrame) -> DataFrame:
    """The row with the highest `seq` of every hash.

    Only (hash, seq) pairs are grouped; the wide rows then meet their winner on both columns,
    so many rows of one hash spread over the tasks.
    """
    winners = rows.groupBy("sha256").agg(F.max("seq").alias("seq"))
    return rows.join(winners, ["sha256", "seq"], "left_semi")


def corpus_upsert(corpus: DataFrame, writes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The corpus after a series of writes by hash; a later write replaces an earlier one.

    Writes without `content` take it from `texts` (sha256, content), and those without a text there
    do nothing. A text then moves once, whatever the number of writes of its hash.
    """
    newest = latest_per_hash(writes)
    if texts is not None:
        newest = newest.join(texts, "sha256")
        writes = writes.join(texts.select("sha256"), "sha256", "left_semi")
    newest = newest.select(*CORPUS_COLUMNS)
    kept = corpus.join(writes.select("sha256").distinct(), "sha256", "left_anti")
    return kept.select(*CORPUS_COLUMNS).unionByName(newest)


def rebuild(registry: DataFrame, sidecars: DataFrame, as_of) -> DataFrame:
    """The corpus from registry and stored texts alone; nothing is extracted."""
    ready = registry.filter(
        "status = 'indexed' AND text_s3_key IS NOT NULL AND extractor_version IS NOT NULL "
        "AND extracted_at IS NOT NULL"
    ).drop("indexed_at")
    return (
        ready.join(sidecars.select("sha256", F.col("text").alias("content")), "sha256")
        .withColumn("indexed_at", F.lit(as_of).cast("timestamp"))
        .select(*CORPUS_COLUMNS)
    )
