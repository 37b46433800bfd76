"""Inventories and queues as data sources."""

import pytest
from pyspark.sql import functions as F

from foliary.schemas import LISTING
from foliary.session import new_path
from foliary.sources import inventory

KEYS = sorted(
    [f"documents/{i:03d}.txt" for i in range(250)] + ["documents", "documentz", "other/é.txt", "documents/\U0010ffff", "a", "documents/"]
)


@pytest.fixture(scope="module")
def folder(spark):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(inventory, "FILE_ROWS", 60)
        path = new_path(spark, "inventory")
        rows = [("b", k, len(k), f"e{i}") for i, k in enumerate(KEYS)]
        inventory.write_inventory(spark.createDataFrame(rows, LISTING).repartition(7), path)
    return path


def keys(df):
    return sorted(r.s3_key for r in df.collect())


@pytest.mark.parametrize("prefix", ["", "documents/", "documents/1", "documents/24", "other/", "none", "documents/\U0010ffff"])
def test_prefix(spark, folder, prefix):
    assert keys(inventory.list_inventory(spark, folder, prefix)) == [k for k in KEYS if k.startswith(prefix)]


def test_other_conditions_and_columns(spark, folder):
    rows = inventory.list_inventory(spark, folder)
    assert rows.schema == LISTING
    assert keys(rows.filter("s3_key > 'documents/2' AND size_bytes < 14")) == [
        k for k in KEYS if k.encode() > b"documents/2" and len(k) < 14
    ]
    assert keys(rows.filter("s3_key = 'a'").select("s3_key")) == ["a"]
    assert rows.select("etag").distinct().count() == len(KEYS)


def test_pages_follow_one_another(spark, folder):
    """A listing by pages: each starts after the last key of the page before."""
    seen, last = [], ""
    while page := inventory.list_inventory(spark, folder, "documents/", last).orderBy("s3_key").limit(100).collect():
        seen += [r.s3_key for r in page]
        last = seen[-1]
    assert seen == [k for k in KEYS if k.startswith("documents/")]


def test_files_beside_the_range_are_not_opened(spark, folder):
    reader = inventory.Inventory({"path": folder}).reader(LISTING)
    assert len(reader.partitions()) == 5
    reader = inventory.Inventory({"path": folder, "prefix": "documents/24", "pageRows": "7"}).reader(LISTING)
    assert 1 <= len(reader.partitions()) <= 2
    pages = [page.column("s3_key").to_pylist() for p in reader.partitions() for page in reader.read(p)]
    assert sorted(x for page in pages for x in page) == [f"documents/{i}.txt" for i in range(240, 250)]
    assert max(map(len, pages)) <= 7


def test_empty(spark):
    path = new_path(spark, "inventory")
    inventory.write_inventory(spark.createDataFrame([], LISTING), path)
    assert inventory.list_inventory(spark, path).count() == 0


def payloads(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, payload string").repartition(3)


def test_queue_goes_on_where_it_stopped(spark):
    """Batches are bounded; what arrives between two runs is read by the second."""
    path, checkpoint, read = new_path(spark, "queue"), new_path(spark, "checkpoint"), []

    def run(most=2):
        def keep(batch, number):
            rows = batch.orderBy("seq").collect()
            read.append((number, [(r.seq, r.payload) for r in rows]))

        stream = inventory.queued(spark, path, most).writeStream.foreachBatch(keep)
        stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    assert inventory.enqueue(payloads(spark, "a", "b", None), path) == 3
    run(10)
    assert [x for _, rows in read for x in rows] == [(1, "a"), (2, "b"), (3, None)]
    assert inventory.enqueue(payloads(spark, "c"), path) == 4
    assert inventory.enqueue(payloads(spark, "d", "e"), path) == 6
    read.clear()
    run(10)
    assert [x for _, rows in read for x in rows] == [(4, "c"), (5, "d"), (6, "e")]


def test_queue_offsets(spark):
    path = new_path(spark, "queue")
    inventory.enqueue(payloads(spark, *"abcde"), path)
    reader = inventory.QueueReader(path, ["seq", "payload"], 2)
    start, seen = reader.initialOffset(), []
    while (end := reader.latestOffset()) != start:
        assert end["seq"] - start["seq"] <= 2
        for split in reader.partitions(start, end):
            seen += [x for page in reader.read(split) for x in page.column("payload").to_pylist()]
        reader.commit(end)
        start = end
    assert seen == list("abcde")


def test_one_file_is_not_derived_by_one_task(spark):
    path = new_path(spark, "inventory")
    task = F.spark_partition_id().cast("long")
    names = F.concat(F.lit("documents/"), "id")
    rows = spark.range(0, 40, 1, 4).select(
        F.lit("documents").alias("s3_bucket"), names.alias("s3_key"), task.alias("size_bytes"), F.lit("e").alias("etag")
    )
    inventory.write_inventory(rows, path)
    assert inventory.list_inventory(spark, path).select("size_bytes").distinct().count() == 4
