import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import components, jaccard
from tests.llm import models


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = {i: models.prose(rng, rng.randrange(1, 90)) for i in range(60)}
    key = 100
    for base in range(0, 60, 3):
        for changes in (0, 1, 2, 4, 8):
            out[key] = models.edited(rng, out[base], changes)
            key += 1
    # A group of many near copies, and a passage that many other texts share.
    seed = models.prose(rng, 120)
    for _ in range(60):
        out[key] = models.edited(rng, seed, rng.randrange(1, 5))
        key += 1
    passage = models.prose(rng, 60)
    for _ in range(40):
        out[key] = passage + " " + models.prose(rng, rng.randrange(5, 40))
        key += 1
    return out | {900: None, 901: "", 902: " \n\t", 903: "two words", 904: "TWO words", 905: "Two Words", 906: "x " * 3000}


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_against_all_pairs(spark, texts):
    docs = models.documents(spark, texts).withColumnRenamed("lang", "class")
    assert got(jaccard.report(docs)) == models.components(texts)


def test_parts_of_blocks_and_shuffled_sides(spark, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "SMALL_ROWS", 0)
    some = {k: v for k, v in texts.items() if k >= 130}
    assert got(jaccard.report(models.documents(spark, some))) == models.components(some)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "one two three four five six seven"
    rows = [(2, text), (2, text), (None, text), (1, "other words are in this text"), (2, "and a third text for that id"), (None, None)]
    docs = models.documents(spark, rows)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.report(docs).collect()), key=str)
    assert found == sorted([(2, 3, 2), (2, 3, 2), (None, 3, 2), (1, 2, 1), (2, 3, 2), (None, 0, None)], key=str)
    kept = jaccard.one_of_each(docs)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(2, text), (1, rows[3][1]), (2, rows[4][1]), (None, None)], key=str
    )
    assert jaccard.report(docs.limit(0)).count() == 0


def test_stage_keeps_one_of_each(spark, texts):
    docs = models.documents(spark, texts).withColumn("root", F.lit(1))
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    expected = {k for k, (_, c) in models.components(texts).items() if k == c}
    assert {r.doc_id for r in kept.collect()} == expected


def test_bound_never_rules_out_a_link():
    rng = np.random.default_rng(5)
    for size in (3, 40, 400, 30_000):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        other = np.concatenate([base[: max(1, int(size * 0.9))], rng.integers(0, 2**63, size // 20).astype(np.uint64)])
        sets = [np.unique(base), np.unique(other)]
        sizes = np.array([len(s) for s in sets])
        rows = jaccard.coordinates([jaccard.point(s) for s in sets], sizes)
        assert (rows.sum(axis=1) == sizes).all()
        overlap = len(np.intersect1d(*sets))
        assert np.minimum(rows[0], rows[1]).sum() >= overlap


def test_tree_join_equals_all_pairs():
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.poisson(2, (150, 20)), np.repeat(rng.poisson(2, (10, 20)), 5, axis=0)]).astype(np.int32)
    points[150:] += rng.integers(0, 2, (50, 20)).astype(np.int32)
    sizes, roots = points.sum(axis=1), np.arange(200) // 2
    every = np.arange(200)
    found = {tuple(sorted(p)) for i, j in jaccard.tree_join(points, sizes, roots, every, every) for p in zip(i.tolist(), j.tolist())}
    expected = {
        (i, j) for i in range(200) for j in range(i + 1, 200)
        if roots[i] != roots[j] and np.minimum(points[i], points[j]).sum() >= jaccard.needed(sizes[i], sizes[j])
    }
    assert found == expected and len(expected) > 50


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (5, 4)]
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    frame = spark.createDataFrame(edges, "a long, b long")
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert {r.node: r.root for r in components.components(frame).collect()} == {k: find(k) for k in list(root)}
    assert components.components(frame.limit(0)).count() == 0


def test_working_tables_go_when_they_are_done(spark, tmp_path, monkeypatch):
    """Only what the result is read from stays, so the steps do not add up on disk."""
    monkeypatch.setattr("foliary.session.work_dir", lambda _: str(tmp_path))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:50], f"x{i}", *words[51:]])) for i in range(6)] + [(9, "no other"), (10, None)]
    found = jaccard.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict.fromkeys(range(6), 0) | {9: 9, 10: 10}
    left = sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "foliary").iterdir())
    assert left == ["edges", "edges", "roots", "rows"]
