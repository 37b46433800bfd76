import random

import pytest
from pyspark.sql import functions as F

from foliary.operators import reconcile, registry
from foliary.schemas import LISTING, REGISTRY, SIGHTING
from tests import model


def history(rng, size):
    hashes = [f"h{i}" for i in range(rng.randint(2, 6))]
    keys = [f"p/k{i}" for i in range(rng.randint(2, 6))]
    places = rng.sample(keys, min(len(keys), len(hashes), 3))
    rows = [
        {
            "sha256": h, "s3_bucket": "b", "s3_key": k, "filename": f"{h}.old", "size_bytes": 1,
            "etag": "e", "seen_at": model.moment(0), "status": rng.choice(["indexed", "error"]),
            "error": rng.choice([None, "boom"]),
        }
        for h, k in zip(hashes, places)
    ]
    updates = []
    for seq in range(1, size + 1):
        source = rng.choice(["worker", "upload"])
        updates.append(
            {
                "seq": seq, "sha256": rng.choice(hashes), "s3_bucket": "b",
                "s3_key": rng.choice(keys), "size_bytes": seq, "etag": f"e{seq}",
                "filename": f"up{seq}" if source == "upload" else None, "content_type": None,
                "seen_at": model.moment(seq), "source": source,
            }
        )
    return rows, updates


@pytest.mark.parametrize("slot_rows, slotted", [(1_000_000, None), (3, True), (1, True)])
def test_sightings_equal_one_by_one(spark, slot_rows, slotted):
    """Many histories side by side, told apart by bucket and hash prefix."""
    rng = random.Random(slot_rows)
    rows, updates, expected = [], [], {}
    for n in range(150):
        old, new = history(rng, rng.randint(1, 25))
        for row in old + new:
            row["s3_bucket"], row["sha256"] = f"b{n}", f"{n}-{row['sha256']}"
        expected.update(model.apply_one_by_one(old, new))
        rows, updates = rows + old, updates + new
    # Sequence numbers are unique over the whole batch and keep the order of each history.
    for seq, update in enumerate(sorted(updates, key=lambda u: u["seq"]), start=1):
        update["seq"] = seq
    blank = dict.fromkeys(REGISTRY.fieldNames())
    old = spark.createDataFrame([{**blank, **r} for r in rows], REGISTRY)
    new = spark.createDataFrame(updates, SIGHTING)
    got = {r.sha256: r.asDict() for r in registry.apply_seen(old, new, slot_rows, slotted).collect()}
    assert got.keys() == expected.keys()
    for sha, row in expected.items():
        shown = {c: got[sha][c] for c in row if c != "seen_at"}
        assert shown == {c: v for c, v in row.items() if c != "seen_at"}
    retired = registry.retired_rows(old, new, slot_rows, slotted)
    everything = {r["sha256"] for r in rows + updates}
    assert {r.sha256 for r in retired.collect()} == everything - expected.keys()


def test_untouched_rows_pass(spark):
    old, new = history(random.Random(1), 4)
    blank = dict.fromkeys(REGISTRY.fieldNames())
    away = {**blank, **old[0], "sha256": "away", "s3_key": "elsewhere", "text_s3_key": "text/x"}
    before = spark.createDataFrame([away], REGISTRY)
    after = registry.apply_seen(before, spark.createDataFrame(new, SIGHTING))
    assert after.filter("sha256 = 'away'").first().asDict() == before.first().asDict()


def test_outcomes(spark):
    blank = dict.fromkeys(REGISTRY.fieldNames())
    base = {**blank, "s3_bucket": "b", "filename": "f", "size_bytes": 1, "seen_at": model.moment(0)}
    rows = [
        {**base, "sha256": s, "s3_key": s, "status": "error", "error": "old"} for s in "abcd"
    ]
    changes = [
        (1, "a", "extracted", None), (2, "a", "indexed", None),
        (1, "b", "extracted", None),
        (1, "c", "error", "new"), (2, "c", "extracted", None),
    ]
    outcomes = spark.createDataFrame(
        [(q, s, a, e, f"text/{s}", "v", model.moment(q)) for q, s, a, e in changes],
        "seq long, sha256 string, action string, error string, text_s3_key string, "
        "extractor_version string, at timestamp",
    )
    after = registry.apply_outcomes(spark.createDataFrame(rows, REGISTRY), outcomes)
    got = {r.sha256: (r.status, r.error, r.text_s3_key) for r in after.collect()}
    assert got == {
        "a": ("indexed", None, "text/a"),
        "b": ("extracted", "old", "text/b"),
        "c": ("extracted", "new", "text/c"),
        "d": ("error", "old", None),
    }


def test_sweep(spark):
    blank = dict.fromkeys(REGISTRY.fieldNames())
    base = {**blank, "s3_bucket": "b", "filename": "f", "size_bytes": 1, "seen_at": model.moment(0), "status": "indexed"}
    known = spark.createDataFrame(
        [
            {**base, "sha256": "1", "s3_key": "same", "etag": "x"},
            {**base, "sha256": "2", "s3_key": "other etag", "etag": "x"},
            {**base, "sha256": "3", "s3_key": "dodatek č. 1.pdf", "etag": None},
        ],
        REGISTRY,
    )
    keys = ["same", "other etag", "dodatek č. 1.pdf", "new"]
    found = spark.createDataFrame([("b", k, 1, "x" if k == "same" else "y") for k in keys], LISTING)
    got = {r.s3_key: (r.state, r.payload) for r in reconcile.reconcile(found, known).collect()}
    assert {k: s for k, (s, _) in got.items()} == {
        "other etag": "changed", "dodatek č. 1.pdf": "changed", "new": "new",
    }
    assert got["new"][1] == '{"bucket":"b","key":"new"}'
    hashed = found.withColumn("sha256", F.when(F.col("s3_key") == "new", "1").otherwise("9"))
    copies = reconcile.reconcile(hashed, known).filter("known_duplicate")
    assert [r.s3_key for r in copies.collect()] == ["new"]


def test_many_updates_of_many_keys_need_no_slots(spark):
    """Slots are for hot keys; high sequence numbers alone do not call for them."""
    rows = spark.range(1, 3001).select(
        F.col("id").alias("seq"), F.concat(F.lit("h"), "id").alias("sha256"), F.lit("b").alias("s3_bucket"),
        F.concat(F.lit("k"), F.col("id") % 1500).alias("s3_key"),
    )
    assert 2 <= registry.most_of_a_key(rows) <= 100
    hot = rows.withColumn("s3_key", F.lit("k"))
    assert registry.most_of_a_key(hot) == 3000
    assert registry.most_of_a_key(rows.limit(0)) == 0
    new = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(SIGHTING[c].dataType).alias(c) for c in SIGHTING.fieldNames()])
    old = spark.createDataFrame([], REGISTRY)
    hot = new.withColumn("s3_key", F.lit("k"))
    for updates, sliced in ((new, False), (hot, True)):
        plan = registry.seen_states(old, updates, 1000)._jdf.queryExecution().optimizedPlan().toString()
        assert ("_far" in plan) == sliced
    assert registry.retired_rows(old, hot, 1000).count() == 2999
    assert registry.retired_rows(old, new, 1000).count() == 1500
