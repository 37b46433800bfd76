import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import toxicity
from foliary.llm.common import fold
from tests.llm import models

BAD = ["rotter", "scoundrel", "blackguard"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    texts, labels = {}, []
    for i in range(600):
        words = models.prose(rng, rng.randrange(20, 120)).split(" ")
        toxic = i % 5 == 2
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(BAD).upper() + "!"
        texts[i] = " ".join(words)
        labels.append((i, 1, int(toxic)))
    texts |= {1000: None, 1001: ""}
    schema = "doc_id long, quality int, toxic int"
    return models.documents(spark, texts), spark.createDataFrame(labels + [(5, 1, None), (9999, 0, 1)], schema)


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    rows = toxicity.report(docs, labels, fold("doc_id", 5) == 0).collect()
    assert len(rows) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 1000]
    assert 80 < len(held) < 160
    assert np.mean([r.predicted == (r.doc_id % 5 == 2) for r in held]) > 0.95
    empty = {r.score for r in rows if r.doc_id >= 1000}
    assert len(empty) == 1


def test_labels_that_are_held_out_change_nothing(spark, tables):
    docs, labels = tables
    held = fold("doc_id", 5) == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r.doc_id: r.score for r in toxicity.report(docs, labels, held).collect()}
    assert one == {r.doc_id: r.score for r in toxicity.report(docs, flipped, held).collect()}


def test_stage_keeps_clean_documents(spark, tables):
    docs, labels = tables
    kept = toxicity.keep_clean(docs.withColumn("score", F.lit("x")), labels, F.lit(True))
    assert kept.columns == [*docs.columns, "score"]
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {1000, 1001} <= ids and len({i for i in ids if i % 5 != 2}) == 482
    assert sum(i % 5 == 2 for i in ids) < 15


def test_without_labels_and_without_rows(spark, tables):
    docs, labels = tables
    assert {r.score for r in toxicity.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels, F.lit(True)).count() == 0


def test_penalty_leaves_few_weights():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(1, 5000, 200)).astype(np.int32) for _ in range(200)]
    labels = np.array([float(i % 2) for i in range(200)])
    rows = [np.union1d(r, [0, 6000]) if y else np.union1d(r, [0]) for r, y in zip(rows, labels, strict=True)]
    places, values = toxicity.fit(rows, labels)
    assert len(places) < 1000 and values[list(places).index(6000)] == max(values)


def test_repeated_ids_are_chosen_alike_in_any_partitioning(spark, tables):
    docs, labels = tables
    other = docs.withColumn("text", F.reverse("text"))
    both = docs.unionByName(other)
    scores = [
        sorted((r.doc_id, r.text_key, r.score) for r in toxicity.score(both.repartition(n), labels, F.lit(True)).collect())
        for n in (1, 7)
    ]
    assert scores[0] == scores[1]
