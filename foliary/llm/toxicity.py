"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbours and pairs with one word between,
hashed into 2 ** BITS places. Every place has a learning rate of its own, and the L1 penalty leaves
most weights at 0, so the model is a short list of (place, weight) whose size is bounded by the
number of places; it is broadcast to score all texts.

The model is fitted on a bounded sample: the TRAIN_ROWS labelled documents with the smallest hash of
their id (a documented limit; the features are made in parallel, the updates run one after another
as the method asks). All texts are scored whole.

Defined results: a null or empty text has the bias as its only feature; without labelled rows all
scores are 0; a label that is null is no label, and of several labels for one id the highest counts;
labels without a document are not used; repeated rows repeat their score; an empty table gives an
empty result. Other columns are not read by `score` and pass through `keep_clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import pieces, prepare, text_of
from foliary.session import materialize

BITS = 20
TRAIN_ROWS = 10_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
#: Words that a worker remembers.
KNOWN = 400_000
#: Signs at the edges of a word that do not belong to it.
EDGES = b".,;:!?#$%&*|\"'()[]{}<>-_=+~/"

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_SKIP = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BITS)


class Words(dict):
    """The 64-bit hash of a word without the signs at its edges, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.strip(EDGES))
        return value


def features(text: bytes, known: Words) -> np.ndarray:
    """The sorted distinct places of a text's features; place 0 is the bias."""
    words = text.lower().split()
    one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    two = (one[:-1] * _PAIR) ^ (one[1:] + (one[:-1] >> np.uint64(29)))
    skip = (one[:-2] * _SKIP) ^ (one[2:] + (one[:-2] >> np.uint64(31)))
    mixed = np.concatenate([one, two, skip]) * _PAIR
    places = (mixed >> _SHIFT).astype(np.int32)
    return np.unique(np.append(places, np.int32(0)))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that are not 0, after EPOCHS passes over the rows."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        rate = (BETA + np.sqrt(n[at])) / ALPHA + L2
        penalty = np.where(at == 0, 0.0, L1)
        return np.where(np.abs(own) <= penalty, 0.0, (np.sign(own) * penalty - own) / rate)

    for _ in range(EPOCHS):
        for at, label in zip(rows, labels, strict=True):
            own = weights(at)
            error = chance(own.sum()) - label
            grown = n[at] + error * error
            z[at] += error - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * own
            n[at] = grown
    final = weights(np.arange(1 << BITS))
    places = np.nonzero(final)[0]
    return places.astype(np.int32), final[places]


def chance(x: float) -> float:
    """The logistic function."""
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Words()
    for batch in pieces(batches):
        rows = [features(text, known) for text in batch.column("text").to_pylist()]
        places = pa.array(rows, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rank"), batch.column("label"), places], names=["rank", "label", "places"]
        )


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("rank")
    places, values = fit(list(rows["places"]), rows["label"].to_numpy(float))
    return pd.DataFrame({"place": places, "weight": values})


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    known, weights = Words(), np.zeros(1 << BITS)
    places, values = model.value
    weights[places] = values
    for batch in pieces(batches):
        scores = [
            chance(weights[features(text, known)].sum()) if len(places) else 0.0
            for text in batch.column("text").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(scores, pa.float64())],
            names=["doc_id", "text_key", "score"],
        )


def train(docs: DataFrame, labels: DataFrame, learns: Column) -> DataFrame:
    """The model (place, weight), from the labels for which `learns` holds."""
    prepare(docs.sparkSession)
    known = labels.filter(learns & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    known = known.withColumn("rank", F.xxhash64("doc_id"))
    # At most TRAIN_ROWS rows of three numbers.
    sample = F.broadcast(known.orderBy("rank", "doc_id").limit(TRAIN_ROWS))
    texts = docs.select("doc_id", text_of("text").cast("binary").alias("text"))
    chosen = texts.join(sample, "doc_id").select("rank", "label", "text")
    # Of several texts under one id, the one of smallest hash, whatever the partitioning.
    picked = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    chosen = chosen.groupBy("rank").agg(F.first("label").alias("label"), picked.alias("text"))
    one_each = chosen.mapInArrow(_features, "rank long, label double, places array<int>")
    return one_each.groupBy(F.lit(0).alias("all")).applyInPandas(_fit, "place int, weight double")


def score(docs: DataFrame, labels: DataFrame, learns: Column) -> DataFrame:
    """(doc_id, text_key, score) of every document."""
    spark = prepare(docs.sparkSession)
    rows = train(docs, labels, learns).toPandas()  # 2 ** BITS rows at most
    model = (rows["place"].to_numpy(np.int32), rows["weight"].to_numpy(float))
    texts = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"), text_of("text").cast("binary").alias("text")
    )
    job = partial(_score, model=spark.sparkContext.broadcast(model))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(job, f"doc_id {kind}, text_key long, score double")


def report(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """Score and class of every document; labels with `held_out` are never learned from."""
    scored = score(docs, labels, ~held_out)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, learns: Column) -> DataFrame:
    """The documents that the classifier does not reject."""
    bad = score(docs, labels, learns).filter("score >= 0.5")
    bad = materialize(bad.select("doc_id", "text_key").distinct(), "rejected")
    same = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_key"])
    return docs.join(bad, same, "left_anti")
