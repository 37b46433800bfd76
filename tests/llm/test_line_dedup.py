import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foliary.llm import line_dedup
from tests.llm import models


def expected(texts):
    """{doc_id: numbers of dropped lines} by comparing all pairs of distinct lines."""
    first = {}
    for key, text in sorted(texts.items()):
        for i, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line, (key, i))
    near = set()
    lines = [x for x in first if len(x) >= line_dedup.MIN_CHARS]
    for a in lines:
        for b in lines:
            if first[a] < first[b] and abs(len(a) - len(b)) <= 2 and models.edit_distance(a, b) <= 2:
                near.add(b)
    return {
        key: [i for i, x in enumerate(text.split("\n")) if x.strip(" ") and (first[x] != (key, i) or x in near)]
        for key, text in texts.items() if text is not None
    }


def change(rng, line):
    chars = list(line)
    for _ in range(rng.randrange(0, 5)):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcé日")
        elif kind == 1:
            chars.insert(at, rng.choice("abcé日"))
        elif len(chars) > 1:
            del chars[at]
    return "".join(chars)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    lines = ["".join(rng.choice("abcdeé 日") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    out = {}
    for key in range(60):
        own = [change(rng, rng.choice(lines)) if rng.random() < 0.6 else models.prose(rng, 8).replace("\n", " ") for _ in range(6)]
        out[key] = "\n".join(own + ["", "  "])
    return out | {70: None, 71: "", 72: "\n\n", 73: "same line here, twice in a text\n" * 3, 74: "x" * 20_000, 75: "x" * 20_001}


def check(spark, texts, frame):
    wanted = expected(texts)
    for row in frame.collect():
        text = texts[row.doc_id]
        gone = wanted.get(row.doc_id, [])
        left = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        digest = None if left is None else hashlib.sha256(left.encode()).hexdigest()
        assert (row.dropped, row.n_dropped, row.kept_sha256) == (",".join(map(str, gone)), len(gone), digest), row.doc_id
        assert row.n_lines == (0 if text is None else len(text.split("\n")))


def test_against_all_pairs(spark, texts):
    docs = models.documents(spark, texts).withColumnRenamed("lang", "line_numbers")
    check(spark, texts, line_dedup.report(docs))


def test_shuffled_sides(spark, texts, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL_ROWS", 0)
    monkeypatch.setattr(line_dedup, "ROWS_PER_TASK", 2)
    some = {k: v for k, v in texts.items() if k % 3 == 0}
    check(spark, some, line_dedup.report(models.documents(spark, some)))


def test_distance_in_a_band(spark):
    rng = random.Random(1)
    pairs = []
    while len(pairs) < 300:
        a = "".join(rng.choice("abcé日") for _ in range(rng.randrange(24, 70)))
        b = change(rng, a)
        if abs(len(a) - len(b)) <= 2:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b")).alias("near")).collect()
    assert all(r.near == (models.edit_distance(r.a, r.b) <= 2) for r in got)
    assert 50 < sum(r.near for r in got) < 290


def test_some_probe_meets_a_segment(spark):
    rng = random.Random(2)
    pairs = []
    while len(pairs) < 200:
        a = "".join(rng.choice("abcdef") for _ in range(rng.randrange(24, 50)))
        b = change(rng, a)
        if models.edit_distance(a, b) <= 2:
            pairs.append(tuple(sorted((a, b), key=len)))
    df = spark.createDataFrame(pairs, "a string, b string")
    index = line_dedup.with_prints(df.select("a", "b", F.col("a").alias("line")), line_dedup.index_segments())
    probes = line_dedup.with_prints(df.select("a", "b", F.col("b").alias("line")), line_dedup.probe_segments())
    met = index.join(probes, ["a", "b", "print"]).select("a", "b").distinct()
    assert met.count() == df.distinct().count()
    long = F.concat(F.repeat(F.lit("eta"), 40), "a"), F.concat(F.repeat(F.lit("eta"), 40), "b")
    sketches = [line_dedup.sketch(x, F.length(x)) for x in long]
    assert df.filter(~line_dedup.sketches_allow(*sketches)).count() == 0


def test_repeated_rows_are_one_document(spark):
    line = "a line that is long enough to count"
    docs = models.documents(spark, [(1, line), (1, line), (None, line), (2, line + "\nnew")])
    got = sorted(((r.doc_id, r.n_dropped) for r in line_dedup.report(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 0), (2, 1)], key=str)
    kept = line_dedup.dedup(docs, drop_empty=True)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, line), (2, "new")], key=str)
    assert line_dedup.report(docs.limit(0)).count() == 0


def test_columns_pass_through_and_empty_texts_stay(spark):
    docs = models.documents(spark, {1: None, 2: "", 3: "\n", 4: "a"}).withColumn("line_numbers", F.lit("x"))
    kept = line_dedup.dedup(docs, drop_empty=True)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {1: None, 2: "", 3: "\n", 4: "a"}


def test_working_tables_go_when_they_are_done(spark, tmp_path, monkeypatch):
    """Only what the result is read from stays, so the steps do not add up on disk."""
    monkeypatch.setattr("foliary.session.work_dir", lambda _: str(tmp_path))
    line = "a line that is long enough to be compared with others"
    rows = [(1, f"{line}\none"), (2, f"{line}s\ntwo"), (3, "three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert found == {1: f"{line}\none", 2: "two", 3: "three"}
    assert [p.name.rsplit("-", 1)[0] for p in (tmp_path / "foliary").iterdir()] == ["gone"]
