import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def model(rows, positives=5, count=5):
    """Every anchor against every row, in whole numbers."""
    kept = []
    for v, vector, label in rows:
        if v is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        entry = (v, (label + 1) % 10 if v % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in vector))
        if (v, label, tuple(vector)) not in {k[0] for k in kept}:
            kept.append(((v, label, tuple(vector)), entry))
    entries = [e for _, e in kept]
    out = []
    for v, label, own in entries:
        if v % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(own, u)), i, x == label) for i, x, u in entries if i != v]
        scored.sort()
        for p, i, _ in [s for s in scored if s[2]][:positives]:
            window = [s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(v, i, r, j, -p, -s) for r, (s, j, _) in enumerate(window[:count], 1)]
    return out


def check(spark, rows, partitions=6):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    df = df.withColumn("part", F.lit("x")).withColumn("anchor", F.lit(0)).withColumn("score", F.lit(1))
    got = negatives.report(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == Counter(model(rows))


def vectors(count, dimension, seed, labels=10, step=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, dimension))
    out = []
    for i in range(count):
        label = int(r.integers(labels))
        v = centres[label] * 0.6 + r.normal(size=dimension)
        out.append((i * step, [float(np.float32(x)) for x in v / np.linalg.norm(v)], label))
    return out


@pytest.mark.parametrize(("block", "dimension"), [(50, 3), (40_000, 16)])
def test_against_all_pairs(spark, monkeypatch, block, dimension):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    check(spark, vectors(900, dimension, dimension))


def test_ties_and_copies(spark, monkeypatch):
    """Equal vectors under many ids, a hot label, an id repeated as it is and with other vectors."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 30)
    rows = [(i, [0.5, 0.5, 0.25], 1 if i % 3 else 2) for i in range(0, 400, 3)]
    rows += [(1000 + i, [0.5, 0.25, 0.5], i % 4) for i in range(120)]
    rows += [(300, [0.5, 0.5, 0.25], 2)] * 20 + [(300, [0.1, 0.9, 0.3], 5), (1001, [1.0, 0.2, 0.1], 3)]
    check(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(200, 4, 9, labels=3, step=10)
    rows += [
        (None, [1.0, 0.0, 0.0, 0.0], 1), (1, None, 1), (3, [1.0, None, 0.0, 0.0], 1), (5, [nan, 0.0, 0.0, 0.0], 1),
        (9, [inf, 0.0, 0.0, 0.0], 1), (11, [1.0, 0.0, 0.0, 0.0], None), (13, [], 1), (15, [1.0], 2), (17, [0.5] * 6, 0),
        (2100, [0.0] * 4, 1), (2200, [], 2), (-100, [0.3, 0.1, 0.2, 0.2], 1), (-7, [0.2, 0.1, 0.2, 0.2], 0),
    ]
    check(spark, rows)


def test_few_rows(spark):
    check(spark, [])
    check(spark, [(0, [1.0, 0.0], 1)])
    check(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [0.9, 0.0], 2)])


def test_large_components(spark):
    """Sums beyond what doubles hold exactly."""
    rng = random.Random(4)
    rows = [(i * 20, [float(2 ** rng.randrange(8, 17)) + rng.randrange(9), float(rng.randrange(2**17)), 0.5], i % 2) for i in range(120)]
    check(spark, rows)


def test_reading_stops_early(spark):
    """A block whose best rows stand out is not read to the end."""
    r = np.random.default_rng(2)
    rows = np.floor(256 * r.normal(size=(5000, 2)) * 0.1)
    rows[:10] += 5000
    block = negatives.Block(np.arange(5000), np.zeros(5000, np.int64), rows)
    anchor = np.array([200.0, 150.0])
    met = []
    whole = block.met
    block.met = lambda a: (met.append(len(x)) or x for x in whole(a))
    bounds = block.thresholds(anchor[None, :])[0]
    everything = [(-float("inf"), float("inf"))]
    ids, scores = negatives.search(block, anchor, bounds, True, -1, None, None, everything, 5)[0]
    order = np.lexsort((np.arange(5000), -(rows @ anchor)))[:5]
    assert list(ids) == list(order) and list(scores) == list((rows @ anchor)[order])
    assert sum(met) < 500
