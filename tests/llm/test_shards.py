import math
import struct
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from foliary.llm import shards
from tests.llm import models


def owner(key, weights):
    """The same law by another implementation of the hash."""
    scores = []
    for shard, weight in enumerate(weights):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        bits = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 11
        scores.append((-math.log((bits + 0.5) / 2.0**53) / weight, shard))
    return min(scores)[1]


def test_owner(spark):
    weights = [1.0, 2.0, 0.5, 1.0]
    df = spark.createDataFrame([(i,) for i in range(2000)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.s for r in shards.place(df, ["doc_id"], weights, "s").collect()}
    assert got == {k: owner(k, weights) for k in got}
    share = [sum(s == i for s in got.values()) / 2001 for i in range(4)]
    assert all(abs(x - w / 4.5) < 0.04 for x, w in zip(share, weights, strict=True))


def test_documents(spark):
    texts = [(i, "é" * (i % 50)) for i in range(500)] + [(7, "é" * 7)] * 3 + [(None, None), (1000, None)]
    rows = shards.shard_documents(models.documents(spark, texts).withColumnRenamed("lang", "shard"), [1.0] * 8, 1.0).collect()
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for row in rows:
        text = ("é" * (row.doc_id % 50) if row.doc_id is not None and row.doc_id < 500 else "").encode()
        assert (row.size, row.text_crc32, row.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert row.shard == owner(row.doc_id, [1.0] * 8)
        assert row.grown_shard in (row.shard, 8)
        slots[row.shard].append(row.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 20 < sum(r.grown_shard == 8 for r in rows) < 100


def test_many_equal_rows_are_written_in_steps(spark, monkeypatch):
    monkeypatch.setattr(shards, "CHUNK", 7)
    df = spark.createDataFrame([(1, 0)] * 100 + [(2, 0), (3, 1)], "doc_id long, shard int")
    got = shards.number_slots(df, "shard", "slot")
    assert sorted(r.slot for r in got.filter("shard = 0").collect()) == list(range(101))


def test_order_does_not_depend_on_partitions(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("shard"))
    one, two = (shards.number_slots(df.repartition(n), "shard", "slot").collect() for n in (1, 7))
    assert sorted(one) == sorted(two)


def test_no_weight(spark):
    with pytest.raises(ValueError):
        shards.owner([F.lit(1)], [0.0])
    empty = models.documents(spark, {1: "a"}).limit(0)
    assert shards.shard_documents(empty, [1.0] * 8, 1.0).count() == 0
