import pytest
from pyspark.sql import functions as F

from foliary.functions.objects import content_hash
from foliary.operators.corpus import corpus_upsert, rebuild
from foliary.operators.extract import builtin_extractor
from foliary.operators.reconcile import index_audit, reconcile
from foliary.plans.ingest import ingest
from foliary.plans.search import open_index, search
from foliary.schemas import CORPUS, REGISTRY
from foliary.session import new_path
from foliary.sources.listing import list_directory, read_objects
from foliary.sources.tables import (
    append_sidecars,
    compact,
    current,
    publish,
    read_sidecars,
    versions,
    write_changes,
)
from foliary.streaming.jobs import Store, ingest_batch, stream_ingest
from tests import model

AS_OF = "2026-01-01 00:00:00"
KEY = "documents/manual import/dodatek č. 1.pdf"


def refuse(_):
    raise AssertionError("extracted again")


@pytest.fixture()
def bucket(tmp_path):
    for key, text in (
        ("documents/abc.pdf", model.RULES),
        (KEY, model.NOTE),
        ("documents/copy.pdf", model.NOTE),
        ("documents/scan.pdf", " too little "),
        ("other/ignored.txt", model.RULES),
    ):
        path = tmp_path / "bucket" / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    for name, content in (
        # A low surrogate without a high one before it is no text; this other mark and its units are.
        ("broken.bin", b"\xff\xfe" + b"\x00\xdc" * 40),
        ("units.bin", b"\xff\xfe\x00\x81" * 40),
    ):
        (tmp_path / "bucket" / "documents" / name).write_bytes(content)
    return str(tmp_path / "bucket")


@pytest.fixture()
def store(spark):
    return Store(new_path(spark, "test-store"))


def sweep(spark, bucket, store):
    known = current(spark, store.registry, REGISTRY)
    return reconcile(list_directory(spark, bucket), known)


def run(spark, bucket, store, payloads, extractor=builtin_extractor):
    ingest_batch(payloads, read_objects(spark, bucket), store, AS_OF, "v1", extractor)


def statuses(spark, store):
    return {r.s3_key: r.status for r in current(spark, store.registry, REGISTRY).collect()}


def test_sweep_ingest_and_rebuild(spark, bucket, store):
    found = sweep(spark, bucket, store)
    assert {r.s3_key for r in found.collect()} == {
        "documents/abc.pdf", KEY, "documents/copy.pdf", "documents/scan.pdf", "documents/broken.bin",
        "documents/units.bin",
    }
    payloads = found.orderBy("s3_key").select("payload").coalesce(1)
    run(spark, bucket, store, payloads)
    state = statuses(spark, store)
    # Equal bytes share a row, which is at the place seen last.
    assert state == {
        "documents/abc.pdf": "indexed", KEY: "indexed",
        "documents/scan.pdf": "needs_ocr", "documents/broken.bin": "error", "documents/units.bin": "needs_ocr",
    }
    corpus = current(spark, store.corpus, CORPUS)
    # The name of a hash is the one it was first seen under.
    assert {r.filename for r in corpus.collect()} == {"abc.pdf", "copy.pdf"}
    registry = current(spark, store.registry, REGISTRY)
    rebuilt = rebuild(registry, read_sidecars(spark, store.sidecars), AS_OF)
    assert sorted(r.sha256 for r in rebuilt.collect()) == sorted(r.sha256 for r in corpus.collect())
    assert index_audit(corpus, registry).filter("state <> 'matched'").isEmpty()
    # The other key of the shared row is found again and again, failed objects are not.
    assert [r.s3_key for r in sweep(spark, bucket, store).collect()] == ["documents/copy.pdf"]


def test_second_run_extracts_nothing(spark, bucket, store):
    keys = ["documents/abc.pdf", "documents/scan.pdf"]
    payloads = sweep(spark, bucket, store).filter(F.col("s3_key").isin(keys)).select("payload")
    run(spark, bucket, store, payloads.coalesce(1))
    before = statuses(spark, store)
    texts = read_sidecars(spark, store.sidecars).count()

    def nothing(objects):
        assert objects.isEmpty()
        return builtin_extractor(objects)

    rows = spark.createDataFrame(
        [('{"bucket":"documents","key":"%s"}' % k,) for k in keys], "payload string"
    )
    run(spark, bucket, store, rows, nothing)
    assert statuses(spark, store) == before
    assert read_sidecars(spark, store.sidecars).count() == texts
    assert current(spark, store.corpus, CORPUS).count() == 1


def test_verdict_is_stored_with_the_text(spark, bucket, store):
    """A low text stays out even if the run that stored it never recorded a status."""
    objects = read_objects(spark, bucket).filter("s3_key = 'documents/scan.pdf'")
    sha = objects.select(content_hash(F.col("content")).alias("sha256"))
    low = sha.select(
        "sha256", F.lit(" too little ").alias("text"), F.lit("v1").alias("extractor_version"),
        F.lit(AS_OF).cast("timestamp").alias("extracted_at"), F.lit(True).alias("needs_ocr"),
    )
    append_sidecars(low, store.sidecars)
    job = spark.createDataFrame([('{"bucket":"documents","key":"documents/scan.pdf"}',)], "payload string")
    run(spark, bucket, store, job)
    assert statuses(spark, store) == {"documents/scan.pdf": "needs_ocr"}
    assert current(spark, store.corpus, CORPUS).isEmpty()


def test_jobs_without_object(spark, bucket):
    jobs = spark.createDataFrame([("documents", "documents/none", 1)], "s3_bucket string, s3_key string, seq long")
    empty = lambda schema: spark.createDataFrame([], schema)
    sidecars = read_sidecars(spark, "/nonexistent/folder")
    done = ingest(jobs, read_objects(spark, bucket), empty(REGISTRY), sidecars, empty(CORPUS), AS_OF, "v1")
    assert [r.s3_key for r in done.missing.collect()] == ["documents/none"]
    assert done.registry.isEmpty()


def test_stream_equals_batch(spark, bucket, store, tmp_path):
    payloads = sweep(spark, bucket, store).select("payload").union(
        spark.createDataFrame([("not a job",)], "payload string")
    )
    feed = str(tmp_path / "feed")
    payloads.coalesce(1).sortWithinPartitions("payload").write.parquet(feed)
    stream = spark.readStream.schema("payload string").parquet(feed)
    stream_ingest(
        stream, lambda session: read_objects(session, bucket), store,
        str(tmp_path / "checkpoint"), "v1", as_of=AS_OF,
    ).awaitTermination()
    batch = Store(new_path(spark, "test-store"))
    run(spark, bucket, batch, spark.read.parquet(feed))
    assert statuses(spark, store) == statuses(spark, batch)
    texts = [
        {r.sha256 for r in current(spark, s.corpus, CORPUS).collect()} for s in (store, batch)
    ]
    assert texts[0] == texts[1] and texts[0]


def test_a_stream_writes_its_index_with_the_dictionary(spark, bucket, store, tmp_path):
    feed, path = str(tmp_path / "feed"), new_path(spark, "test-index")
    sweep(spark, bucket, store).select("payload").coalesce(1).write.parquet(feed)
    lemmas = spark.createDataFrame(model.LEMMAS, "surface string, lemma string")
    stream_ingest(
        spark.readStream.schema("payload string").parquet(feed), lambda session: read_objects(session, bucket), store,
        str(tmp_path / "checkpoint"), "v1", as_of=AS_OF, index=path, lemmas=lemmas,
    ).awaitTermination()
    queries = spark.createDataFrame([(1, "knihám")], "query_id long, q string")
    texts = {r.sha256 for r in current(spark, store.corpus, CORPUS).collect()}
    assert {r.sha256 for r in search(queries, open_index(spark, path)).collect()} == texts and len(texts) == 2


def test_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    assert versions(spark, path) == []
    first = publish(spark.range(3), path)
    publish(first.filter("id > 0"), path)
    assert versions(spark, path) == [1, 2]
    assert first.count() == 3
    assert current(spark, path, first.schema).count() == 2


def test_changes(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "sha256 string, n long"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    table = rows(("a", 1), ("b", 1), ("c", 1))
    read = lambda: {tuple(r) for r in current(spark, path, table.schema).collect()}
    publish(table, path)
    write_changes(rows(("a", 2), ("d", 2)), path, rows(("b", 0)))
    assert read() == {("a", 2), ("c", 1), ("d", 2)}
    write_changes(rows(("b", 3), ("d", 3)), path)
    expected = {("a", 2), ("b", 3), ("c", 1), ("d", 3)}
    assert read() == expected
    compact(spark, path, table.schema)
    assert versions(spark, path) == [1, 4] and read() == expected
    write_changes(rows(("e", 5)), path, rows(("a", 0)))
    assert read() == {("b", 3), ("c", 1), ("d", 3), ("e", 5)}


def test_upsert_takes_texts_after_the_newest_write(spark):
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CORPUS.fields)
    names = CORPUS.fieldNames()
    row = lambda sha, **more: tuple((dict(sha256=sha) | more).get(c) for c in names)
    old = spark.createDataFrame([row("a", content="A"), row("b", content="B"), row("c", content="C")], shape)
    writes = spark.createDataFrame(
        [("a", 1, "first"), ("a", 2, "last"), ("c", 3, "no text")], "sha256 string, seq long, filename string"
    )
    for field in CORPUS.fields:
        if field.name not in ("sha256", "filename", "content"):
            writes = writes.withColumn(field.name, F.lit(None).cast(field.dataType))
    texts = spark.createDataFrame([("a", "A2"), ("d", "D")], "sha256 string, content string")
    after = corpus_upsert(old, writes, texts).select("sha256", "filename", "content").collect()
    assert sorted(map(tuple, after), key=str) == [("a", "last", "A2"), ("b", None, "B"), ("c", None, "C")]
