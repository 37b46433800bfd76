"""Every operator as a query over the given tables: name to (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.catalog import fixtures as fx
from foliary.functions import objects as ob
from foliary.functions import text as tx
from foliary.operators import affix, analyze, corpus, extract, reconcile, registry
from foliary.plans import ingest as jobs
from foliary.plans import search as plans
from foliary.schemas import CORPUS, REGISTRY
from foliary.session import configure, materialize, new_path, spread
from foliary.sources import inventory, listing, messages
from foliary.sources.tables import append_sidecars, current, publish
from foliary.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


def _registry_row(df: DataFrame) -> DataFrame:
    times = {"extracted_at", "indexed_at", "seen_at"}
    return df.select(*[fx.shown_time(c) if c in times else F.col(c) for c in REGISTRY.fieldNames()])


def _long(column: str):
    return F.col(column).cast("long").alias(column)


# Sources and sinks.


@query
def object_listing(spark, sf):
    return listing.from_inventory(fx.inventory(spark, sf))


@query
def object_info(spark, sf):
    """Content types of the pages' objects: given for some, by the key for others."""
    ending = F.element_at(F.array(*[F.lit(e) for e in fx.ENDINGS]), (F.col("page_id") % len(fx.ENDINGS) + 1).cast("int"))
    key = F.concat(F.lit("documents/"), F.col("page_id"), ending)
    given = F.when(F.col("page_id") % 5 == 0, " ").when(F.col("page_id") % 5 == 1, "text/x-page")
    return fx.table(spark, sf, "pages").select("page_id", key.alias("s3_key"), ob.content_type(key, given).alias("content_type"))


@query
def stored_notes(spark, sf):
    """Time and version noted with stored texts, some missing and some unreadable."""
    doc, at = F.col("doc_id"), F.concat(F.lit("2024-03-"), F.lpad(F.col("doc_id") % 33, 2, "0"))
    note = (
        F.when(doc % 6 == 0, F.concat(at, F.lit("T10:30:00+02:00")))
        .when(doc % 6 == 1, F.concat(at, F.lit(" 23:59:59.25")))
        .when(doc % 6 == 2, F.concat(at, F.lit("T01:00Z")))
        .when(doc % 6 == 3, at)
        .when(doc % 6 == 4, "yesterday")
    )
    stamp, bad = ob.stored_stamp(note, fx.instant(fx.AS_OF))
    version = F.when(doc % 4 > 0, F.concat(F.lit("v"), doc % 4))
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("extracted_at"), bad.alias("bad_note"),
        ob.stored_version(version).alias("extractor_version"),
    )


@query
def inventory_prefix(spark, sf):
    """A listing by prefix from an inventory read as a data source of its own."""
    path = new_path(spark, "inventory")
    inventory.write_inventory(listing.from_inventory(fx.inventory(spark, sf)), path)
    return inventory.list_inventory(spark, path, "documents/src1")


@query
def sidecar_delta(spark, sf):
    found = fx.objects(spark, sf).dropDuplicates(["sha256"])
    texts = found.select("sha256", F.col("content").alias("text"))
    fresh = corpus.sidecar_delta(texts, fx.sidecars(spark, sf))
    return fresh.select(
        "sha256", "text_s3_key", F.length("text").cast("long").alias("chars"), F.lit("v2").alias("extractor_version")
    )


@query
def registry_lookup(spark, sf):
    wanted = fx.updates(spark, sf)
    by_place = registry.lookup(fx.registry(spark, sf), wanted, registry.PLACE)
    by_hash = registry.lookup(fx.registry(spark, sf), wanted, ["sha256"])
    columns = ["sha256", "s3_bucket", "s3_key", "status"]
    return (
        by_place.select(*columns, F.lit("place").alias("found_by"))
        .unionByName(by_hash.select(*columns, F.lit("hash").alias("found_by")))
    )


def _uploads(spark, sf):
    docs = fx.objects(spark, sf)
    return docs.select(
        (F.col("doc_id") + 1).alias("seq"), "filename", "content_type", "content"
    )


@query
def batch_ingest(spark, sf):
    uploads = messages.address_uploads(_uploads(spark, sf), fx.SETTINGS)
    _, answers = jobs.batch_ingest(uploads, fx.registry(spark, sf), fx.AS_OF, fx.SETTINGS)
    return answers


@query
def upload_registry(spark, sf):
    uploads = messages.address_uploads(_uploads(spark, sf), fx.SETTINGS)
    after, _ = jobs.batch_ingest(uploads, fx.registry(spark, sf), fx.AS_OF, fx.SETTINGS)
    return _registry_row(after)


# Scalar functions.


@query
def content_hash(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", ob.content_hash(F.col("text")).alias("sha256"))


@query
def content_address(spark, sf):
    pages = fx.table(spark, sf, "pages")
    sha = ob.content_hash(F.col("html"))
    return pages.select(
        "page_id",
        ob.content_address("documents/", sha, F.col("url")).alias("s3_key"),
        ob.text_address("text/", sha).alias("text_s3_key"),
    )


@query
def resolve_filename(spark, sf):
    known = fx.registry(spark, sf).select("sha256", F.col("filename").alias("recorded"))
    found = fx.objects(spark, sf).select("doc_id", "sha256", "s3_key").join(known, "sha256", "left")
    return found.select(
        "doc_id", F.coalesce("recorded", ob.base_name(F.col("s3_key"))).alias("filename")
    )


@query
def ingest_rejects(spark, sf):
    page = F.col("page_id")
    uploads = fx.table(spark, sf, "pages").select(
        "page_id",
        F.when(page % 7 != 0, F.col("url")).alias("filename"),
        F.when(page % 5 == 0, "").otherwise(F.col("html")).alias("content"),
    )
    good, bad = messages.split_uploads(uploads)
    columns = ["page_id", F.length("content").cast("long").alias("chars")]
    return good.select(*columns, F.lit("accepted").alias("reason")).unionByName(
        bad.select(*columns, "reason")
    )


@query
def parse_notifications(spark, sf):
    return messages.parse_notifications(fx.notifications(spark, sf))


@query
def decode_jobs(spark, sf):
    found = messages.decode_jobs(fx.job_payloads(spark, sf))
    return found.select("event_id", "s3_bucket", "s3_key", "reason")


def _measured(spark, sf):
    docs = fx.extraction_meta(fx.table(spark, sf, "documents"))
    return docs.withColumn("per_page", extract.chars_per_page(F.col("meta"), F.col("text")))


@query
def chars_per_page(spark, sf):
    return _measured(spark, sf).select("doc_id", F.round("per_page", 6).alias("per_page"))


@query
def needs_ocr_gate(spark, sf):
    return _measured(spark, sf).select(
        "doc_id", extract.low_text(F.col("per_page")).alias("needs_ocr")
    )


@query
def extraction_outcome(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumn("code", fx.http_code())
    return docs.select(
        "doc_id",
        extract.outcome_class(F.col("code")).alias("outcome"),
        extract.outcome_message(F.col("code"), F.col("text")).alias("error"),
    )


@query
def safe_highlight(spark, sf):
    marked = F.replace(F.col("html"), F.lit("<p>"), F.lit("<em>'p'</em>"))
    return fx.table(spark, sf, "pages").select("page_id", tx.safe_highlight(marked).alias("safe"))


@query
def keyword_fields(spark, sf):
    # Names of every length: each document's words joined by underscores.
    name = F.replace(F.col("content"), F.lit(" "), F.lit("_"))
    docs = fx.corpus(spark, sf).withColumn("filename", name)
    return corpus.keyword_fields(docs).select(
        "sha256", "s3_bucket", "s3_key", "content_type", "size_bytes", "extractor_version",
        fx.shown_time("extracted_at"), fx.shown_time("indexed_at"), "filename_keyword",
    )


# Joins.


def _listing(spark, sf):
    return listing.from_inventory(fx.inventory(spark, sf))


@query
def reconcile_sweep(spark, sf):
    return reconcile.reconcile(_listing(spark, sf), fx.registry(spark, sf))


@query
def reconcile_duplicates(spark, sf):
    found = fx.objects(spark, sf).select("s3_bucket", "s3_key", "etag", "sha256")
    swept = reconcile.reconcile(found, fx.registry(spark, sf))
    return swept.select("s3_key", "state", "known_duplicate")


@query
def sweep_summary(spark, sf):
    return reconcile.sweep_summary(_listing(spark, sf), fx.registry(spark, sf))


@query
def cache_hits(spark, sf):
    return corpus.cache_hits(fx.registry(spark, sf), fx.sidecars(spark, sf)).select(
        "sha256", "s3_key", "status"
    )


@query
def cache_misses(spark, sf):
    return corpus.cache_misses(fx.registry(spark, sf), fx.sidecars(spark, sf)).select(
        "sha256", "s3_key", "status"
    )


@query
def reindex(spark, sf):
    rebuilt = corpus.rebuild(fx.registry(spark, sf), fx.sidecars(spark, sf), fx.AS_OF)
    return rebuilt.select(
        "sha256", F.md5("content").alias("content_md5"), "filename", "s3_key", "size_bytes",
        "extractor_version", fx.shown_time("extracted_at"), fx.shown_time("indexed_at"),
    )


@query
def index_audit(spark, sf):
    audit = reconcile.index_audit(fx.corpus(spark, sf), fx.registry(spark, sf))
    return audit.groupBy("state").agg(F.count(F.lit(1)).alias("documents"))


@query
def expand_dictionary(spark, sf):
    stems = materialize(fx.stems(spark, sf), "stems")
    return affix.expand_dictionary(stems, fx.affixes(spark), fx.FORBIDDEN_FLAG, fx.SETTINGS)


# Registry state.


@query
def apply_seen(spark, sf):
    return _registry_row(registry.apply_seen(fx.registry(spark, sf), fx.updates(spark, sf)))


@query
def retired_rows(spark, sf):
    return registry.retired_rows(fx.registry(spark, sf), fx.updates(spark, sf))


@query
def apply_outcomes(spark, sf):
    return _registry_row(
        registry.apply_outcomes(fx.registry(spark, sf), fx.outcomes(spark, sf))
    )


@query
def corpus_upsert(spark, sf):
    stamp = F.lit(fx.AS_OF).cast("timestamp")
    old = fx.corpus(spark, sf)
    texts = fx.objects(spark, sf).select("sha256", F.col("content")).dropDuplicates(["sha256"])
    writes = (
        materialize(fx.updates(spark, sf), "updates")
        .withColumn("filename", F.coalesce("filename", ob.base_name(F.col("s3_key"))))
        .withColumn("extractor_version", F.lit("v2"))
        .withColumn("extracted_at", F.col("seen_at"))
        .withColumn("indexed_at", stamp)
    )
    return corpus.corpus_upsert(old, writes, texts).select(
        "sha256", F.md5("content").alias("content_md5"), "filename", "s3_key", "extractor_version"
    )


@query
def count_by_status(spark, sf):
    return registry.count_by_status(fx.registry(spark, sf))


@query
def list_by_status(spark, sf):
    return _registry_row(registry.list_by_status(fx.registry(spark, sf), "error"))


# Text analysis.


@query
def tokenize(spark, sf):
    docs = spread(fx.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.array_join(tx.tokens(F.col("text")), " ").alias("words"))


@query
def stopword_filter(spark, sf):
    words = analyze.word_rows(spread(fx.corpus(spark, sf)), "sha256", "content")
    kept = analyze.stopword_filter(words, fx.SETTINGS)
    return kept.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("kept_words"),
        F.min("pos").cast("long").alias("first_pos"),
        F.max("pos").cast("long").alias("last_pos"),
    )


@query
def lemmatize(spark, sf):
    words = materialize(fx.vocabulary(spark, sf), "vocabulary")
    found = analyze.with_lemmas(words, fx.lemmas(spark, sf, words), "word", fx.SETTINGS)
    return found.select("word", F.explode("lemmas").alias("lemma"))


@query
def ascii_fold(spark, sf):
    return fx.vocabulary(spark, sf).select("word", tx.ascii_fold(F.col("word")).alias("folded"))


@query
def analyze_fields(spark, sf):
    rows = analyze.analyze(fx.corpus(spark, sf), fx.lemmas(spark, sf), fx.SETTINGS, listed=True)
    # One document's terms: a list no longer than its text.
    entries = F.transform("terms", lambda e: F.concat(e["pos"].cast("string"), F.lit(":"), e["term"]))
    return rows.select(
        "sha256",
        "field",
        F.size("terms").cast("long").alias("terms"),
        F.size(F.array_distinct("terms.pos")).cast("long").alias("positions"),
        F.md5(F.array_join(F.sort_array(entries), " ")).alias("terms_md5"),
    )


@query
def postings(spark, sf):
    posts = analyze.postings(fx.corpus(spark, sf), fx.lemmas(spark, sf), fx.SETTINGS)
    return posts.select(
        "field", "term", "sha256", _long("tf"), _long("dl"), F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions")
    )


@query
def term_stats(spark, sf):
    return fx.index(spark, sf).vocabulary.select("field", "term", "doc_freq", "total_tf")


@query
def field_stats(spark, sf):
    fields = fx.index(spark, sf).fields
    return fields.select("field", "docs", F.round("avg_length", 6).alias("avg_length"))


# Search.


def _weighted(spark, sf):
    return plans.weighted_terms(fx.search_queries(spark), fx.index(spark, sf), fx.SETTINGS)


@query
def fuzzy_terms(spark, sf):
    found = _weighted(spark, sf)
    return found.select(
        "query_id", "field", _long("pos"), "query_term", "term", _long("distance"),
        F.round("boost", 6).alias("boost"),
    )


@query
def bm25_scores(spark, sf):
    scores = plans.scoring(_weighted(spark, sf), fx.index(spark, sf), fx.SETTINGS)
    return scores.withColumn("score", F.round("score", 6))


@query
def best_fields(spark, sf):
    ranked = plans.ranking(_weighted(spark, sf), fx.index(spark, sf), fx.SETTINGS)
    return ranked.withColumn("score", F.round("score", 6))


@query
def search_total(spark, sf):
    return plans.search_totals(
        fx.search_queries(spark), fx.index(spark, sf), settings=fx.SETTINGS
    )


def _page(df):
    return df.select("query_id", _long("rank"), "sha256", "score")


@query
def search_page(spark, sf):
    return _page(
        plans.search(fx.search_queries(spark), fx.index(spark, sf), settings=fx.SETTINGS)
    )


@query
def search_second_page(spark, sf):
    return _page(
        plans.search(fx.search_queries(spark), fx.index(spark, sf), 20, 5, fx.SETTINGS)
    )


@query
def search_exact(spark, sf):
    settings = replace(fx.SETTINGS, fuzzy=False)
    return _page(plans.search(fx.search_queries(spark), fx.index(spark, sf), settings=settings))


@query
def search_many(spark, sf):
    queries = fx.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("q")
    )
    return _page(plans.search(queries, fx.index(spark, sf), size=10, settings=fx.SETTINGS))


@query
def search_extended(spark, sf):
    """The first page over an index that was written in two parts."""
    docs = fx.corpus(spark, sf)
    path = new_path(spark, "index")
    first = docs.filter("size_bytes % 2 = 0")
    plans.write_index(first, path, fx.lemmas(spark, sf), fx.SETTINGS)
    whole = plans.extend_index(docs, path, fx.SETTINGS)
    return _page(plans.search(fx.search_queries(spark), whole, settings=fx.SETTINGS))


@query
def highlights(spark, sf):
    hits = plans.search_hits(
        fx.search_queries(spark), fx.index(spark, sf), settings=fx.SETTINGS
    )
    return hits.select(
        "query_id", "sha256", F.posexplode("highlights").alias("n", "highlight")
    ).withColumn("n", F.col("n").cast("long"))


@query
def search_hits(spark, sf):
    hits = plans.search_hits(
        fx.search_queries(spark), fx.index(spark, sf), settings=fx.SETTINGS
    )
    return hits.select(
        "query_id", _long("rank"), "filename", "score", "s3_bucket", "s3_key",
        F.size("highlights").cast("long").alias("fragments"),
    )


@query
def quoted_query(spark, sf):
    asked = fx.search_queries(spark)
    quoted = asked.select("query_id", F.concat(F.lit('"'), F.replace("q", F.lit('"'), F.lit("")), F.lit('"')).alias("q"))
    return _page(plans.search(quoted, fx.index(spark, sf), settings=fx.SETTINGS))


# Extraction.


@query
def extract_text(spark, sf):
    pages = fx.table(spark, sf, "pages")
    return pages.select("page_id", extract.extract_text(F.col("html")).alias("text"))


@query
def extract_metadata(spark, sf):
    pages = fx.table(spark, sf, "pages")
    meta = pages.select("page_id", F.explode(extract.extract_metadata(F.col("html"))).alias("name", "found"))
    return meta.select("page_id", "name", F.array_join("found", "|").alias("value"))


def _jobs(spark, sf):
    payloads = fx.job_payloads(spark, sf)
    good = messages.decode_jobs(payloads).filter("reason IS NULL")
    return good.select("s3_bucket", "s3_key", (F.col("event_id") + 1).alias("seq"))


def _ingested(spark, sf, registered, texts, docs):
    return jobs.ingest(
        _jobs(spark, sf), fx.objects(spark, sf).drop("sha256"), registered, texts, docs,
        fx.AS_OF, "v2", fx.extractor, fx.SETTINGS,
    )


def _indexed_before(spark, sf):
    return corpus.rebuild(fx.registry(spark, sf), fx.sidecars(spark, sf), "2024-02-02 00:00:00")


@query
def ingest_jobs(spark, sf):
    done = _ingested(
        spark, sf, fx.registry(spark, sf), fx.sidecars(spark, sf), _indexed_before(spark, sf)
    )
    return _registry_row(done.registry)


@query
def ingest_corpus(spark, sf):
    done = _ingested(
        spark, sf, fx.registry(spark, sf), fx.sidecars(spark, sf), _indexed_before(spark, sf)
    )
    return done.corpus.select(
        "sha256", F.md5("content").alias("content_md5"), "filename", "s3_key", "extractor_version",
        fx.shown_time("extracted_at"), fx.shown_time("indexed_at"),
    )


# Streams.


def _store(spark, sf) -> streams.Store:
    store = streams.Store(new_path(spark, "store"))
    publish(fx.registry(spark, sf), store.registry)
    publish(_indexed_before(spark, sf), store.corpus)
    verdict = F.lit(None).cast("boolean").alias("needs_ocr")
    append_sidecars(fx.sidecars(spark, sf).select("*", verdict), store.sidecars)
    return store


@query
def stream_ingest(spark, sf):
    """The jobs as a file stream; the registry after the stream has run dry."""
    store = _store(spark, sf)
    feed = new_path(spark, "feed")
    fx.job_payloads(spark, sf).select(
        "payload", (F.col("event_id") + 1).alias("seq")
    ).write.parquet(feed)
    payloads = spark.readStream.schema("payload string, seq long").parquet(feed)
    streams.stream_ingest(
        payloads,
        lambda session: fx.objects(session, sf).drop("sha256"),
        store,
        new_path(spark, "stream"),
        "v2",
        fx.extractor,
        fx.SETTINGS,
        fx.AS_OF,
    ).awaitTermination()
    return _registry_row(current(spark, store.registry, REGISTRY))


@query
def replay_idempotent(spark, sf):
    """The registry after the same batch has run twice."""
    store = _store(spark, sf)
    payloads = fx.job_payloads(spark, sf).select("payload", (F.col("event_id") + 1).alias("seq"))
    found = fx.objects(spark, sf).drop("sha256")
    for _ in range(2):
        streams.ingest_batch(payloads, found, store, fx.AS_OF, "v2", fx.extractor, fx.SETTINGS)
    before = current(spark, store.corpus, CORPUS).select("sha256", F.lit(1).alias("searchable"))
    after = current(spark, store.registry, REGISTRY).join(before, "sha256", "left")
    return after.select(
        "sha256", "s3_key", "status", F.coalesce("searchable", F.lit(0)).cast("long").alias("searchable")
    )
