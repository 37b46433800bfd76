"""One ingest batch: jobs to registry, stored texts and corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions.objects import content_hash, content_type, stored_version, text_address
from foliary.operators.corpus import cache_misses, corpus_upsert
from foliary.operators.extract import (
    builtin_extractor,
    chars_per_page,
    low_text,
    outcome_class,
    outcome_message,
)
from foliary.operators.registry import (
    PLACE,
    apply_outcomes,
    apply_seen,
    retired,
    seen_states,
    surviving,
)
from foliary.schemas import CORPUS_COLUMNS, REGISTRY
from foliary.session import lookup_join, materialize, rows_within
from foliary.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class IngestResult:
    """What a batch changes, and the tables after it.

    A running store writes the changes only; `registry` and `corpus` are whole tables and cost
    a whole rewrite.
    """

    registry_rows: DataFrame
    retired: DataFrame
    new_sidecars: DataFrame
    corpus_rows: DataFrame
    missing: DataFrame
    registry: DataFrame
    corpus: DataFrame


def sightings(
    jobs: DataFrame, objects: DataFrame, as_of, settings: Settings = DEFAULTS
) -> DataFrame:
    """Sightings of a batch of jobs (s3_bucket, s3_key, seq) against the objects in the store.

    All jobs of one key see the same content, so its first and last job stand for all of them;
    a hot key shrinks to two rows before it is shuffled. Contents are hashed where they are
    read and never moved.
    """
    spans = jobs.groupBy(*PLACE).agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    if rows_within(spans, settings.broadcast_rows):
        objects = objects.join(F.broadcast(spans.select(*PLACE)), PLACE, "left_semi")
    given = F.col("content_type").cast("string") if "content_type" in objects.columns else None
    known = objects.select(
        *PLACE,
        content_hash(F.col("content").cast("binary")).alias("sha256"),
        content_type(F.col("s3_key"), given).alias("content_type"),
        F.col("size_bytes").cast("long").alias("size_bytes"),
        "etag",
    )
    return (
        spans.join(known, PLACE)
        .withColumn("seq", F.explode(F.array_distinct(F.array("first", "last"))))
        .drop("first", "last")
        .withColumn("filename", F.lit(None).cast("string"))
        .withColumn("seen_at", F.lit(as_of).cast("timestamp"))
        .withColumn("source", F.lit("worker"))
    )


def ingest(
    jobs: DataFrame,
    objects: DataFrame,
    registry: DataFrame,
    sidecars: DataFrame,
    corpus: DataFrame,
    as_of,
    version: str,
    extractor: Callable[[DataFrame], DataFrame] = builtin_extractor,
    settings: Settings = DEFAULTS,
) -> IngestResult:
    """Hash, register, extract once per hash, gate, and upsert into the corpus.

    `jobs` has s3_bucket, s3_key and a unique seq; keys without an object are returned as
    `missing`. `extractor` maps (sha256, s3_bucket, s3_key, content) to (sha256, text, meta,
    http_code, message). A hash with a stored text is never extracted again, and the gate's
    verdict is stored with the text.
    """
    stamp = F.lit(as_of).cast("timestamp")
    events = materialize(sightings(jobs, objects, as_of, settings), "sightings")
    states = materialize(seen_states(registry, events, settings.slot_rows), "states")
    batch = surviving(states)

    wanted = cache_misses(batch, sidecars).select("sha256", *PLACE)
    if rows_within(wanted, settings.broadcast_rows):
        wanted = F.broadcast(wanted)
    fresh = objects.select(*PLACE, "content").join(wanted, PLACE)
    extracted = extractor(fresh.select("sha256", *PLACE, "content")).select(
        "sha256",
        "text",
        outcome_class(F.col("http_code")).alias("outcome"),
        outcome_message(F.col("http_code"), F.col("message"), settings.max_message_chars).alias(
            "error"
        ),
        low_text(chars_per_page(F.col("meta"), F.col("text")), settings.min_chars_per_page).alias(
            "needs_ocr"
        ),
    )
    extracted = materialize(extracted, "extracted")

    new_sidecars = extracted.filter("outcome = 'ok'").select(
        "sha256",
        "text",
        F.lit(version).alias("extractor_version"),
        stamp.alias("extracted_at"),
        "needs_ocr",
    )
    # A stored text without a verdict is judged by the status on record; one without a time or a
    # version counts as extracted now by an unknown extractor, so a rebuild finds it.
    recorded = batch.select("sha256", (F.col("status") == "needs_ocr").alias("_recorded"))
    if "needs_ocr" not in sidecars.columns:
        sidecars = sidecars.withColumn("needs_ocr", F.lit(None).cast("boolean"))
    stored = (
        sidecars.select(*new_sidecars.columns)
        .join(recorded, "sha256")
        .withColumn("needs_ocr", F.coalesce("needs_ocr", "_recorded"))
        .withColumn("extracted_at", F.coalesce("extracted_at", stamp))
        .withColumn("extractor_version", stored_version(F.col("extractor_version")))
        .withColumn("cached", F.lit(True))
        .drop("_recorded")
    )
    texts = stored.unionByName(new_sidecars.withColumn("cached", F.lit(False)))

    # What happens to a hash, as status changes: extracted first, then the verdict.
    skipped = F.col("cached") & F.col("needs_ocr")
    verdict = F.when(F.col("needs_ocr"), "needs_ocr").otherwise("indexed")
    step = F.struct
    steps = F.when(
        skipped, F.array(step(F.lit(2).alias("seq"), F.lit("needs_ocr").alias("action")))
    ).otherwise(
        F.array(
            step(F.lit(1).alias("seq"), F.lit("extracted").alias("action")),
            step(F.lit(2).alias("seq"), verdict.alias("action")),
        )
    )
    changes = texts.select(
        "sha256", "extractor_version", "extracted_at", F.explode(steps).alias("_step")
    ).select(
        F.col("_step.seq").alias("seq"),
        "sha256",
        F.col("_step.action").alias("action"),
        F.lit(None).cast("string").alias("error"),
        text_address(settings.text_prefix, F.col("sha256")).alias("text_s3_key"),
        "extractor_version",
        F.when(F.col("_step.action") == "extracted", F.col("extracted_at"))
        .otherwise(stamp)
        .alias("at"),
    )
    failures = extracted.filter("outcome <> 'ok'").select(
        F.lit(2).alias("seq"),
        "sha256",
        F.lit("error").alias("action"),
        "error",
        F.lit(None).cast("string").alias("text_s3_key"),
        F.lit(None).cast("string").alias("extractor_version"),
        stamp.alias("at"),
    )
    outcomes = changes.unionByName(failures)

    writes = (
        texts.filter("NOT needs_ocr")
        .select("sha256", F.col("text").alias("content"), "extractor_version", "extracted_at")
        .join(batch.drop("extractor_version", "extracted_at", "indexed_at"), "sha256")
        .withColumn("indexed_at", stamp)
        .withColumn("seq", F.lit(1))
        .select("seq", *CORPUS_COLUMNS)
    )
    changed = apply_outcomes(batch, outcomes)
    untouched = registry.join(states.select("sha256"), "sha256", "left_anti")
    return IngestResult(
        registry_rows=changed,
        retired=retired(states),
        new_sidecars=new_sidecars,
        corpus_rows=writes.select(*CORPUS_COLUMNS),
        registry=untouched.select(*REGISTRY.fieldNames()).unionByName(changed),
        corpus=corpus_upsert(corpus, writes),
        missing=jobs.select(*PLACE).distinct().join(objects.select(*PLACE), PLACE, "left_anti"),
    )


def batch_ingest(
    uploads: DataFrame, registry: DataFrame, as_of, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Register addressed uploads (with seq); returns the registry and one answer per upload.

    Addresses contain the hash, so no upload can take the place of another hash's upload, and
    the status after the upsert is the recorded one or `pending`.
    """
    updates = uploads.select(
        "seq",
        "sha256",
        *PLACE,
        "filename",
        "content_type",
        "size_bytes",
        "etag",
        F.lit(as_of).cast("timestamp").alias("seen_at"),
        F.lit("upload").alias("source"),
    )
    hashes = uploads.select("sha256").distinct()
    recorded = registry.select("sha256", F.col("status").alias("_status")).join(
        hashes, "sha256", "left_semi"
    )
    asked = uploads.select("seq", "sha256", *PLACE, "payload")
    small = rows_within(hashes, settings.broadcast_rows)
    answers = lookup_join(asked, recorded, ["sha256"], "left", "seq", small, settings.salts)
    answers = answers.withColumn("status", F.coalesce("_status", F.lit("pending"))).drop("_status")
    return apply_seen(registry, updates, settings.slot_rows), answers
