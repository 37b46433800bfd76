import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import language_model as lm
from foliary.llm.common import fold
from tests.llm import models


def part():
    return lm.split(fold("doc_id", 7), test=2, kept=3)


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", models.lower(text)), "\n"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    out = {}
    for key in range(150):
        # Every word has a favourite successor, so pairs tell more than words.
        own = [rng.choice(models.WORDS)]
        for _ in range(rng.randrange(5, 80)):
            at = models.WORDS.index(own[-1])
            own.append(models.WORDS[(at * 7 + 3) % len(models.WORDS)] if rng.random() < 0.7 else rng.choice(models.WORDS))
        out[key] = " ".join(own) + (f"\tOnly{key}" if key % 4 == 0 else "")
    return out | {500: None, 501: "", 502: "ÉCOLE École", 503: " \n "}


def test_base_and_counts(spark, texts):
    rows = {r.doc_id: r for r in lm.score(models.documents(spark, texts), part()).collect()}
    counts = Counter()
    for key, text in texts.items():
        if zlib.crc32(str(key).encode()) % 7 != 2:
            counts.update(words(text))
    total, distinct = sum(counts.values()), len(counts)
    assert rows.keys() == texts.keys()
    for key, text in texts.items():
        own, row = words(text), rows[key]
        assert row.held_out == (zlib.crc32(str(key).encode()) % 7 == 2)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        assert row.base_score == pytest.approx(base, abs=1e-9)
        assert -1e6 < row.score < 0
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 50


def test_rare_words_take_the_join_and_score_the_same(spark, texts, monkeypatch):
    docs = models.documents(spark, texts)
    one = {r.doc_id: r for r in lm.score(docs, part()).collect()}
    # Nothing is hot: every word is counted in the join, and no pairs are left.
    monkeypatch.setattr(lm, "HOT_SHARE", 2.0)
    two = {r.doc_id: r for r in lm.score(docs, part()).collect()}
    for key in texts:
        assert two[key].base_score == pytest.approx(one[key].base_score, abs=1e-9)
        assert (two[key].n_known, two[key].n_tokens) == (one[key].n_known, one[key].n_tokens)


def test_probabilities_add_up():
    random = np.random.default_rng(3)
    size = 6
    counts = np.array([50, 40, 30, 20, 10], np.int64)
    pairs = np.sort(random.choice(size * 5, 12, replace=False))
    pairs = np.unique(pairs // 5 * size + pairs % 5)
    weights = random.dirichlet(np.ones(3), lm.BUCKETS)
    weights[0] = [0.0, 0.8, 0.2]
    core = np.array([0, 1, 2, 3, 4, 5])
    model = lm.Model(150, 5, np.arange(5, dtype=np.uint64), counts, core, pairs, random.integers(1, 9, len(pairs)), weights)
    after, buckets = model.contexts()
    for context in range(6):
        total = weights[buckets[context]][2] / 6  # an unknown word
        for word in range(5):
            if context == 5:  # the start of a text
                codes, ends = np.array([word], np.uint64), np.array([1])
            else:
                codes, ends = np.array([context, word], np.uint64), np.array([2])
            _, p2, p1, bucket = lm._estimates(codes, ends, model, after, buckets)
            total += weights[bucket[-1]] @ [p2[-1], p1[-1], 1 / 6]
        assert total == pytest.approx(1.0)


def test_weights_follow_the_better_estimate():
    step = lambda p: round(math.log(p) * lm.STEPS)
    rows = np.array([[3, step(0.5), step(0.01), 100], [3, 1, step(0.01), 5], [0, 1, step(0.2), 50]], float)
    weights = lm.learn_weights(rows, 1000)
    assert weights[3][0] > 0.8 and weights[0][0] == 0 and weights[0][1] > 0.9
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 2] >= lm.LEAST / 2).all()


def test_repeated_rows_empty_tables_and_no_training(spark):
    docs = models.documents(spark, [(1, "a b a"), (1, "a b a"), (None, "a")]).withColumn("base", F.lit(1))
    rows = lm.score(docs, F.lit(lm.LEARN)).collect()
    assert sorted((r.n_tokens, r.train_tokens) for r in rows) == [(2, 10), (4, 10), (4, 10)]
    assert lm.score(docs.limit(0), F.lit(lm.LEARN)).count() == 0
    untrained = lm.score(docs, F.lit(lm.TEST)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in untrained} == {(0, 0, 0.0)}
    assert all(math.isfinite(r.score) for r in untrained)


@pytest.mark.parametrize("hot, frequent, held", [(2.0**-20, 2.0**-20, 200_000), (2.0**-8, 2.0**-8, 1), (2.0, 2.0, 1)])
def test_every_pair_counts_however_rare(spark, texts, monkeypatch, hot, frequent, held):
    monkeypatch.setattr(lm, "HOT_SHARE", hot)
    monkeypatch.setattr(lm, "PAIR_SHARE", frequent)
    monkeypatch.setattr(lm, "TOKENS_PER_TASK", held, raising=False)
    monkeypatch.setattr(lm, "learn_weights", lambda rows, words: np.tile([0.6, 0.3, 0.1], (lm.BUCKETS, 1)))
    got = {r.doc_id: r for r in lm.score(models.documents(spark, texts), part()).collect()}
    trained = [words(t) for k, t in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    single, pairs = Counter(), Counter()
    for own in trained:
        single.update(own)
        pairs.update(zip(["\n", *own], own))
    total, distinct = sum(single.values()), len(single)
    for key, text in texts.items():
        own = words(text)
        p = [
            0.6 * (pairs[v, w] / single[v] if single[v] else 0) + 0.3 * single[w] / total + 0.1 / (distinct + 1)
            for v, w in zip(["\n", *own], own)
        ]
        assert got[key].score == pytest.approx(sum(map(math.log10, p)), abs=1e-9)
        assert got[key].n_known == sum(single[w] > 0 for w in own)


def test_weights_of_each_part_of_the_histogram(spark, texts, monkeypatch):
    grids = []
    real = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda rows, words: grids.append(rows) or real(rows, words))
    for share in (2.0**-20, 2.0):
        monkeypatch.setattr(lm, "HOT_SHARE", share)
        lm.score(models.documents(spark, texts), part()).count()
    one, two = (sorted(map(tuple, g)) for g in grids)
    kept = [words(t) for k, t in texts.items() if zlib.crc32(str(k).encode()) % 7 == 3]
    assert one == two and sum(r[3] for r in one) == sum(map(len, kept))
