"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions.objects import content_hash, job_payload
from foliary.functions.text import whole_words
from foliary.operators.grouping import distinct_words
from foliary.schemas import CORPUS_COLUMNS, REGISTRY
from foliary.session import arrow_batches, materialize, new_path, rows_within, spread
from foliary.plans.search import Index, open_index, write_index
from foliary.settings import Settings

AS_OF = "2024-06-01 00:00:00"
STOPWORDS = ("the", "of", "and", "in", "to", "le", "la", "de", "der", "die", "el", "los")
SETTINGS = Settings(stopwords=STOPWORDS)

SEARCH_QUERIES = (
    (1, "worthless"),
    (2, "wothless"),
    (3, "taht"),
    (4, "mentoin"),
    (5, "elel"),
    (6, "the"),
    (7, '"of the"'),
    (8, "of the"),
    (9, "mentoiére"),
    (10, "etion"),
    (11, "xqzzy"),
    (12, "Reading worthless thingly"),
)

# Invented affix rules: flag, kind, cross, strip, affix, cont, cond.
AFFIXES = (
    ("A", "SFX", True, "", "s", [], "."),
    ("A", "SFX", True, "e", "ing", ["C"], "e"),
    ("A", "SFX", True, "", "er", ["P"], "[^aeiou]"),
    ("B", "SFX", False, "n", "nal", [], "[io]n"),
    ("C", "SFX", True, "", "ly", [], "g"),
    ("N", "PFX", True, "", "un", [], "."),
    ("P", "PFX", True, "", "most", [], "[^u]"),
    ("R", "PFX", True, "re", "pre", [], "re"),
)
FORBIDDEN_FLAG = "q"

# Endings of invented keys.
ENDINGS = (".txt", ".PDF", ".html", ".tar.gz", "", ".json", ".", ".docx")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(text: str):
    return F.lit(text).cast("timestamp")


def shown_time(column: str):
    """A timestamp as text, so that results compare without regard to time types."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an object in the store."""
    return table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("s3_bucket"),
        F.concat(F.lit("documents/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("s3_key"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.md5("text").alias("etag"),
        content_hash(F.col("text")).alias("sha256"),
        "doc_id",
        F.concat("doc_id", F.lit("-"), "lang", F.lit(".txt")).alias("filename"),
        F.lit("text/plain").alias("content_type"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store inventory: objects without content, etags in quotes."""
    quoted = F.concat(F.lit('"'), "etag", F.lit('"'))
    return objects(spark, sf_dir).select("s3_bucket", "s3_key", "size_bytes", quoted.alias("etag"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the documents as registered, in all states."""
    known = objects(spark, sf_dir).drop("content").filter("doc_id % 3 <> 0")
    latest = known.groupBy("sha256").agg(F.max("doc_id").alias("doc_id"))
    kind = F.col("doc_id") % 20
    status = (
        F.when(kind == 0, "error")
        .when(kind == 2, "pending")
        .when(kind == 4, "extracted")
        .when(kind == 7, "needs_ocr")
        .otherwise("indexed")
    )
    has_text = ~F.col("status").isin("pending", "error")
    seen = F.timestamp_micros(
        F.unix_micros(instant("2024-01-01 00:00:00")) + F.col("doc_id") * 60_000_000
    )
    rows = (
        known.join(latest, ["sha256", "doc_id"], "left_semi")
        .withColumn("status", status)
        .withColumn("seen_at", seen)
        .withColumn("etag", F.when(F.col("doc_id") % 10 == 1, "stale").otherwise(F.col("etag")))
        .withColumn("text_s3_key", F.when(has_text, F.concat(F.lit("text/"), "sha256", F.lit(".txt"))))
        .withColumn("extractor_version", F.when(has_text & (F.col("doc_id") % 50 != 8), "v1"))
        .withColumn("extracted_at", F.when(has_text, F.col("seen_at") + F.expr("INTERVAL 1 HOUR")))
        .withColumn(
            "indexed_at",
            F.when(F.col("status") == "indexed", F.col("seen_at") + F.expr("INTERVAL 2 HOURS")),
        )
        .withColumn("error", F.when(F.col("status") == "error", "boom"))
    )
    return rows.select(*REGISTRY.fieldNames())


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sighting per event; error events put a document's content under another's key."""
    docs = objects(spark, sf_dir).drop("content")
    n = docs.count()
    events = table(spark, sf_dir, "events")
    own = F.col("event_id") % n
    upload = F.col("event_type").isin("signup", "purchase")
    events = events.select(
        (F.col("event_id") + 1).alias("seq"),
        own.alias("doc_id"),
        F.when(F.col("event_type") == "error", (F.col("event_id") * 7 + 3) % n)
        .otherwise(own)
        .alias("key_doc"),
        F.col("ts").cast("timestamp").alias("seen_at"),
        F.when(upload, "upload").otherwise("worker").alias("source"),
        F.when(upload, F.concat(F.lit("upload-"), "event_id", F.lit(".txt"))).alias("filename"),
    )
    content = docs.select("doc_id", "sha256", "content_type", "size_bytes", "etag")
    places = docs.select(F.col("doc_id").alias("key_doc"), "s3_bucket", "s3_key")
    return events.join(content, "doc_id").join(places, "key_doc").drop("doc_id", "key_doc")


def _one_of_each(docs: DataFrame) -> DataFrame:
    """One row for every hash of (sha256, content); only texts that have copies are moved."""
    counted = docs.groupBy("sha256").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    copies = materialize(counted.select(F.col("sha256").alias("_copied")), "copies")
    if not rows_within(copies, SETTINGS.broadcast_rows):
        return docs.dropDuplicates(["sha256"])
    same = F.col("sha256").eqNullSafe(F.col("_copied"))
    alone = docs.join(F.broadcast(copies), same, "left_anti")
    repeated = docs.join(F.broadcast(copies), same, "left_semi").dropDuplicates(["sha256"])
    return alone.unionByName(repeated)


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored texts of four fifths of the documents."""
    docs = objects(spark, sf_dir).filter("doc_id % 5 <> 0").select("sha256", "content")
    return _one_of_each(docs).select(
        "sha256",
        F.col("content").alias("text"),
        F.lit("v1").alias("extractor_version"),
        instant("2024-02-01 00:00:00").alias("extracted_at"),
    )


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bucket notification per event, some without records, without key, or cut off."""
    docs = objects(spark, sf_dir).select("doc_id", "s3_bucket", "s3_key")
    n = docs.count()
    events = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % n).alias("doc_id"))
    key = F.when(F.col("event_id") % 13 == 0, "").otherwise(F.col("s3_key"))
    body = F.concat(
        F.lit('{"Records":[{"s3":{"bucket":{"name":"'),
        "s3_bucket",
        F.lit('"},"object":{"key":"'),
        key,
        F.lit('"}}}]}'),
    )
    body = (
        F.when(F.col("event_id") % 11 == 0, '{"Event":"ping"}')
        .when(F.col("event_id") % 17 == 0, F.substring(body, 1, 40))
        .otherwise(body)
    )
    return events.join(docs, "doc_id").select("event_id", body.alias("body"))


def job_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One queued job per event, some without a key or not JSON at all."""
    docs = objects(spark, sf_dir).select("doc_id", "s3_bucket", "s3_key")
    n = docs.count()
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", (F.col("event_id") % n).alias("doc_id")
    )
    payload = (
        F.when(F.col("event_id") % 19 == 0, '{"bucket":"documents"}')
        .when(F.col("event_id") % 23 == 0, "not json")
        .otherwise(job_payload(F.col("s3_bucket"), F.col("s3_key")))
    )
    return events.join(docs, "doc_id").select("event_id", "ts", payload.alias("payload"))


def extraction_meta(docs: DataFrame) -> DataFrame:
    """Add the extractor's page metadata to frames with doc_id and n_chars."""
    doc = F.col("doc_id")
    figure = (
        F.when(doc % 16 == 8, F.array().cast("array<string>"))
        .when(doc % 8 == 4, F.array(F.lit("abc")))
        .otherwise(F.array(F.concat("n_chars", F.lit(".5"))))
    )
    pages = (
        F.when(doc % 16 == 2, "0")
        .when(doc % 16 == 5, "x")
        .otherwise((F.lit(1) + F.floor(F.col("n_chars") / 3000)).cast("string"))
    )
    entries = F.array(
        F.when(doc % 4 == 0, F.struct(F.lit("pdf:charsPerPage"), figure)),
        F.when((doc % 4).isin(1, 2), F.struct(F.lit("xmpTPg:NPages"), F.array(pages))),
    )
    return docs.withColumn(
        "meta", F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))
    )


def http_code():
    doc = F.col("doc_id")
    return (
        F.when(doc % 29 == 0, 422)
        .when(doc % 31 == 0, 503)
        .when(doc % 37 == 0, F.lit(None).cast("int"))
        .otherwise(200)
    )


def extractor(found: DataFrame) -> DataFrame:
    """The extractor of the ingest queries: text as it is, metadata and outcome by document."""
    docs = found.select(
        "sha256",
        F.col("content").alias("text"),
        F.regexp_extract("s3_key", r"/([0-9]+)\.txt$", 1).cast("long").alias("doc_id"),
        F.length("content").cast("long").alias("n_chars"),
    )
    return extraction_meta(docs).select(
        "sha256", "text", "meta", http_code().alias("http_code"), F.col("text").alias("message")
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes, two per extracted document and one per failed one."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        content_hash(F.col("text")).alias("sha256"),
        "n_chars",
        http_code().alias("code"),
    )
    failed = F.coalesce(F.col("code") >= 400, F.lit(True))
    step = lambda order, action: F.struct(
        (F.col("doc_id") * 2 + order).alias("seq"), F.lit(action).alias("action")
    )
    last = F.when(F.col("n_chars") < 100, F.array(step(1, "needs_ocr"))).when(
        F.col("doc_id") % 7 != 0, F.array(step(1, "indexed"))
    )
    extracted = F.array(step(0, "extracted"))
    steps = F.when(failed, F.array(step(1, "error"))).otherwise(
        F.coalesce(F.concat(extracted, last), extracted)
    )
    return docs.select("sha256", "doc_id", F.explode(steps).alias("s")).select(
        "s.seq",
        "sha256",
        "s.action",
        F.when(F.col("s.action") == "error", F.concat(F.lit("failed "), "doc_id")).alias("error"),
        F.concat(F.lit("text/"), "sha256", F.lit(".txt")).alias("text_s3_key"),
        F.lit("v2").alias("extractor_version"),
        instant(AS_OF).alias("at"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct document as a searchable one; its last copy gives name and place.

    Only the hashes of copies are looked up, so texts stay where they are unless copies are many.
    """
    docs = objects(spark, sf_dir).filter("sha256 IS NOT NULL AND doc_id IS NOT NULL")
    copies = docs.groupBy("sha256").agg(F.max("doc_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    copies = copies.filter("_n > 1").drop("_n")
    if rows_within(copies, SETTINGS.broadcast_rows):
        copies = F.broadcast(copies)
    return (
        docs.join(copies, "sha256", "left")
        .filter("_last IS NULL OR doc_id = _last")
        .withColumn("extractor_version", F.lit("v1"))
        .withColumn("extracted_at", instant("2024-02-01 00:00:00"))
        .withColumn("indexed_at", instant(AS_OF))
        .select(*CORPUS_COLUMNS)
    )


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of all documents."""
    docs = spread(table(spark, sf_dir, "documents").select("text"))
    docs = docs.select(whole_words(F.col("text")).alias("words"))
    arrow_batches(spark)
    return docs.mapInArrow(distinct_words, "word string").distinct()


def lemmas(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """A dictionary for the words of the documents: (surface, lemma); written once.

    `words` is their vocabulary, if it is known already.
    """
    word, size = F.col("word"), F.length("word")

    def without(ending: str):
        return F.substring(word, F.lit(1), size - len(ending))

    found = (
        F.when(word.endswith("ing") & (size > 6), F.array(without("ing")))
        .when(word.endswith("tion") & (size > 6), F.array(without("tion")))
        .when(word.endswith("ly") & (size > 2), F.array(word, without("ly")))
    )
    words = vocabulary(spark, sf_dir) if words is None else words
    words = words.withColumn("found", found).filter("found IS NOT NULL")
    return materialize(words.select(word.alias("surface"), F.explode("found").alias("lemma")), "lemmas")


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the documents as dictionary stems, flagged by their form."""
    word = F.col("word")
    flags = F.array(
        F.when(word.rlike("[esrd]$"), "A"),
        F.when(word.rlike("n$"), "B"),
        F.when(word.rlike("^(th|in)"), "N"),
        F.when(word.rlike("^re"), "R"),
        F.when(word.rlike("eau"), FORBIDDEN_FLAG),
    )
    return vocabulary(spark, sf_dir).select(
        word.alias("stem"), F.filter(flags, lambda f: f.isNotNull()).alias("flags")
    )


def affixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [list(rule) for rule in AFFIXES],
        "flag string, kind string, cross boolean, strip string, affix string, "
        "cont array<string>, cond string",
    )


def search_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEARCH_QUERIES), "query_id long, q string")


_indexes: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The written index of the documents; built once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = new_path(spark, "index")
        write_index(corpus(spark, sf_dir), path, lemmas(spark, sf_dir), SETTINGS)
        _indexes[key] = path
    return open_index(spark, _indexes[key])


