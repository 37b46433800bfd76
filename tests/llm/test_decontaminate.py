import hashlib
import random
import re

import pytest

from foliary.llm import decontaminate
from tests.llm import models

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, words string"


def expected(texts, items):
    windows = {}
    for key, text in items:
        words = WORD.findall(models.lower(text))
        size = min(10, len(words))
        for i in range(len(words) - size + 1) if words and key is not None else ():
            windows.setdefault(tuple(words[i : i + size]), set()).add(key)
    out = []
    for key, text in texts:
        words, hit, found = WORD.findall(models.lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if own := windows.get(tuple(words[i : i + size])):
                    found |= own
                    hit |= set(range(i, i + size))
        names = ",".join(sorted(map(str, found)))
        out.append((key, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(9)
    items = [(i, models.prose(rng, rng.randrange(10, 40))) for i in range(12)]
    items += [(20, "Short ITEM é"), (21, "one"), (22, None), (23, "... !"), (None, items[0][1]), (3, items[3][1])]
    items += [(24, items[2][1]), (25, "Éclair " + items[1][1])]
    texts = [(i, models.prose(rng, rng.randrange(0, 200))) for i in range(40)]
    for i in range(40, 80):
        key, item = rng.choice(items[:12])
        words = item.split()
        cut = words[: rng.randrange(6, len(words) + 1)] if i % 2 else words[rng.randrange(0, 4) :]
        joiner = rng.choice([" ", ", ", "\n", " - "])
        texts.append((i, models.prose(rng, 30) + " " + joiner.join(cut).upper() + " " + models.prose(rng, rng.randrange(0, 30))))
    texts += [(90, None), (91, ""), (92, "a short item É"), (93, "a short item é b"), (94, "one two one"), (None, items[4][1])]
    texts += [(95, (items[5][1] + " ") * 40), (95, (items[5][1] + " ") * 40), (96, "éclair " + " ".join(items[1][1].split()[:9]))]
    return texts, items


def test_against_all_windows(spark, case):
    texts, items = case
    docs = models.documents(spark, texts).withColumnRenamed("lang", "words")
    benchmark = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    assert sorted(map(tuple, decontaminate.report(docs, benchmark).collect()), key=str) == expected(texts, items)


def test_sort_merge_path(spark, case, monkeypatch):
    monkeypatch.setattr(decontaminate, "SMALL_ROWS", 0)
    texts, items = case
    got = decontaminate.report(models.documents(spark, texts[60:]), spark.createDataFrame([(*i, "x") for i in items], ITEMS))
    assert sorted(map(tuple, got.collect()), key=str) == expected(texts[60:], items)


def test_every_shared_span_of_the_guaranteed_length_shares_a_kept_hash(spark):
    rng = random.Random(1)
    for _ in range(3):
        span = [rng.choice(models.WORDS) for _ in range(decontaminate.GUARANTEE)]
        one, two = (" ".join([models.prose(rng, 15), *span, models.prose(rng, 15)]) for _ in range(2))
        frames = [spark.createDataFrame([(1, t)], "id int, text string") for t in (one, two)]
        prints = [
            {r["print"] for r in decontaminate._prints(f.select("id", decontaminate._hashes(f["text"]).alias("hashes")), [], "id").collect()}
            for f in frames
        ]
        assert prints[0] & prints[1]


def test_stage(spark, case):
    texts, items = case
    docs = models.documents(spark, texts)
    benchmark = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    clean = [r[0] for r in expected(texts, items) if not r[-1]]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, clean))
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == len(texts)
    assert decontaminate.report(docs.limit(0), benchmark).count() == 0


def test_no_python_in_the_plan(spark, case):
    texts, items = case
    plan = decontaminate.report(models.documents(spark, texts), spark.createDataFrame([(*i, "x") for i in items], ITEMS))
    text = plan._jdf.queryExecution().toString() if hasattr(plan, "_jdf") else ""
    assert "Python" not in text and "Arrow" not in text
