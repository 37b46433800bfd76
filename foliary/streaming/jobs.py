"""Job streams: queued jobs and notifications into the ingest, and timed sweeps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliary.operators.extract import builtin_extractor
from foliary.operators.reconcile import reconcile
from foliary.plans.ingest import ingest
from foliary.plans.search import upsert_index
from foliary.schemas import CORPUS, REGISTRY
from foliary.settings import DEFAULTS, Settings
from foliary.sources.messages import decode_jobs
from foliary.sources.tables import append_sidecars, current, read_sidecars, write_changes


@dataclass(frozen=True)
class Store:
    """Folders of the written tables."""

    root: str

    @property
    def registry(self) -> str:
        return f"{self.root}/registry"

    @property
    def sidecars(self) -> str:
        return f"{self.root}/sidecars"

    @property
    def corpus(self) -> str:
        return f"{self.root}/corpus"


def ingest_batch(
    payloads: DataFrame,
    objects: DataFrame,
    store: Store,
    as_of,
    version: str,
    extractor: Callable[[DataFrame], DataFrame] = builtin_extractor,
    settings: Settings = DEFAULTS,
    index: str | None = None,
    lemmas: DataFrame | None = None,
) -> None:
    """Run one batch of payloads against the store's tables and write what it changes.

    Stored texts are added first and the registry changes last, so a batch that is lost
    half-way and run again finds its texts and ends in the same state. `payloads` may carry
    its own order as `seq`. With the path of an `index`, what the batch makes searchable is
    upserted there as well (`lemmas` is its dictionary when the batch is the first).
    """
    spark = payloads.sparkSession
    good = decode_jobs(payloads).filter("reason IS NULL")
    if "seq" not in good.columns:
        good = good.withColumn("seq", F.monotonically_increasing_id() + 1)
    result = ingest(
        good.select("s3_bucket", "s3_key", "seq"),
        objects,
        current(spark, store.registry, REGISTRY),
        read_sidecars(spark, store.sidecars),
        current(spark, store.corpus, CORPUS),
        as_of,
        version,
        extractor,
        settings,
    )
    append_sidecars(result.new_sidecars, store.sidecars)
    write_changes(result.corpus_rows, store.corpus)
    if index is not None and not result.corpus_rows.isEmpty():
        upsert_index(result.corpus_rows, index, lemmas, settings)
    write_changes(result.registry_rows, store.registry, result.retired)


def stream_ingest(
    payloads: DataFrame,
    objects: Callable[[SparkSession], DataFrame],
    store: Store,
    checkpoint: str,
    version: str,
    extractor: Callable[[DataFrame], DataFrame] = builtin_extractor,
    settings: Settings = DEFAULTS,
    as_of=None,
    trigger: dict | None = None,
    index: str | None = None,
    lemmas: DataFrame | None = None,
) -> StreamingQuery:
    """Ingest a stream of payloads; every micro-batch is one ingest batch.

    Delivery is at least once and the batch is idempotent by content hash. `as_of` fixes the
    time stamps of a replay; without it they are the time of the batch. `lemmas` is the dictionary
    of an `index` that the stream writes first.
    """

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        now = as_of or spark.range(1).select(F.current_timestamp()).first()[0]
        ingest_batch(batch, objects(spark), store, now, version, extractor, settings, index, lemmas)

    return (
        payloads.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_sweeps(
    spark: SparkSession,
    listing: Callable[[SparkSession], DataFrame],
    store: Store,
    enqueue: Callable[[DataFrame], None],
    checkpoint: str,
    settings: Settings = DEFAULTS,
) -> StreamingQuery:
    """Compare listing and registry on a timer and hand the job payloads to `enqueue`.

    A file stream would miss overwritten objects, so every tick is a whole batch join.
    """

    def run(_: DataFrame, __: int) -> None:
        registry = current(spark, store.registry, REGISTRY)
        enqueue(reconcile(listing(spark), registry).select("payload"))

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        ticks.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{settings.sweep_seconds} seconds")
        .start()
    )
