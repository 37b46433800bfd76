import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foliary.llm import quality
from tests.llm import models


def counts(text):
    """The base statistics, window by window."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


EDGES = [
    None, "", " \t\n\x0b\x0c\r", "one", "a " * 8, "a " * 9, "a " * 30, "\n\n a\n a\n\na\n", " x  y　z", "😀 é ß " * 9,
    "a b c d e f g h " * 2 + "x", "a b c d e f g h i j k l a b c d e f g h z c d e f g h i j", "#" * 50 + " <a|b> 100%",
    " ".join(f"w{i}" for i in range(30000)), " ".join(f"w{i % 5000}" for i in range(20000)), "x" * 300000,
]


def test_counts(spark):
    rng = random.Random(5)
    texts = EDGES + [" ".join(rng.choice("abc") + rng.choice(["", "\n"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, "en" if i % 3 else None, None) for i, t in enumerate(texts)] + [(None, "a b", None, "s"), (0, None, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # Names of the module's own columns are no matter.
    docs = docs.withColumn("_eight", F.lit(1)).withColumn("group", F.lit("g")).withColumn("n_words", F.lit(-1))
    got = quality.report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = counts("a b" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected, r
        assert not (r.base_failed and r.kept)


def test_empty_and_too_few(spark):
    few = models.documents(spark, {i: models.prose(random.Random(i), 50) for i in range(20)})
    assert quality.report(few.limit(0)).count() == 0
    # Too few documents for an estimate: the base rules alone decide.
    assert all(r.kept and r.distance is None for r in quality.report(few).collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "group string, " + ", ".join(f"{f} long" for f in quality.FEATURES) + ", n long")


def estimate(x):
    """The same estimate with arrays over single rows: means and scatter of the better start."""
    n, size = x.shape

    def median(values):
        return np.sort(values, axis=0)[(n - 1) // 2]

    centre = median(x)
    scale = np.sqrt((1.4826 * median(np.abs(x - centre))) ** 2 + quality.SPREAD**2)
    bent = np.rint(1000 * np.tanh((x - centre) / scale))
    scatter = np.cov(bent.T, bias=True) + 100.0**2 * np.eye(size)
    starts = [np.diag(1 / scale**2), np.linalg.inv(scatter) / np.outer(scale, scale)]
    found = []
    for inverse in starts:
        mean = centre
        for _ in range(quality.STEPS):
            d = np.sqrt(np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean))
            bins = np.floor(quality.BINS * np.log2(d + 0.01))
            order = np.sort(bins)
            core = x[bins <= order[math.ceil(quality.CORE * n) - 1]]
            mean = core.mean(axis=0)
            scatter = np.cov(core.T, bias=True) * quality.consistency(quality.CORE) + quality.SPREAD**2 * np.eye(size)
            inverse = np.linalg.inv(scatter)
        found.append((np.linalg.slogdet(scatter)[1], mean, inverse))
    return min(found, key=lambda f: f[0])


def test_estimates_equal_those_of_arrays(spark):
    random_ = np.random.default_rng(3)
    groups = {}
    for name, spread in (("a", 40), ("b", 90)):
        mixed = random_.normal(size=(6, 6)) * spread / 3
        good = 400 + random_.normal(size=(800, 6)) @ mixed
        far = 900 + 5 * random_.normal(size=(200, 6))
        groups[name] = np.rint(np.concatenate([good, far])).clip(0, 1024)
    rows = [(g, *map(int, v), 1) for g, x in groups.items() for v in x]
    vectors = table(spark, rows).groupBy("group", *quality.FEATURES).agg(F.sum("n").alias("n"))
    got = {r.group: r for r in quality.estimates(vectors).collect()}
    assert got.keys() == groups.keys()
    for name, x in groups.items():
        det, mean, inverse = estimate(x)
        row = got[name]
        assert math.isclose(row.det, det, rel_tol=1e-9)
        assert np.allclose([row[f"m{i}"] for i in range(6)], mean)
        lower = np.zeros((6, 6))
        for i, j in quality.PAIRS:
            lower[i, j] = row[f"w{i}_{j}"]
        assert np.allclose(lower.T @ lower, inverse)
        # A fifth of outliers does not move the centre.
        assert np.abs(mean - x[:800].mean(axis=0)).max() < 25


def test_consistency():
    sample = np.random.default_rng(1).normal(size=(200_000, 6))
    d = np.sort((sample**2).sum(axis=1))
    assert math.isclose(quality.chi_square(d[150_000], 6), 0.75, abs_tol=0.005)
    core = sample[(sample**2).sum(axis=1) <= d[150_000]]
    assert math.isclose(core.var() * quality.consistency(0.75), 1.0, abs_tol=0.01)


def documents(spark):
    rng = random.Random(11)
    rows = []
    for i in range(900):
        lang, source = ("en", None, "de")[i % 3], "hot" if i % 9 else f"s{i}"
        text = models.prose(rng, rng.randrange(30, 120))
        if i % 30 == 7:
            text = " | ".join(text.split(" "))
        if i % 30 == 11:
            text = text.upper()
        rows.append((i, text, lang, source, len(text)))
    return rows, spark.createDataFrame(rows, models.DOCS)


def test_verdicts(spark):
    rows, docs = documents(spark)
    got = {r.doc_id: r for r in quality.report(docs).collect()}
    odd = {i for i in got if i % 30 in (7, 11)}
    assert {i for i, r in got.items() if not r.kept and not r.base_failed} == odd
    # Small sources take the estimate of their language, a null language has one as well.
    assert got[0].group == '1{"lang":"en"}' and got[1].group.startswith('0{"source":"hot"}')
    again = {r.doc_id: r.distance for r in quality.report(docs.repartition(7)).collect()}
    assert again == {i: r.distance for i, r in got.items()}


def test_copies_in_a_hot_group(spark):
    """A third of all rows are one text; equal vectors travel once."""
    rows, _ = documents(spark)
    copies = [(1000 + i, rows[0][1], "en", "hot", 1) for i in range(400)]
    got = {r.doc_id: r for r in quality.report(spark.createDataFrame(rows + copies, models.DOCS)).collect()}
    assert all(got[i].kept for i in range(1000, 1400))
    assert not got[7].kept and not got[11].kept
