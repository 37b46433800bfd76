import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from foliary.llm import merkle
from tests.llm import models


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def others(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        start = at - at % fanout
        out += [level[i] for i in range(start, min(start + fanout, len(level))) if i != at]
        at //= fanout
    return out


def rooted(leaves, at, digest, fanout):
    """The root with one leaf replaced, by hashing everything again."""
    return tree([*leaves[:at], digest, *leaves[at + 1 :]], fanout)[-1][0]


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    if n_chars is not None:
        n_chars += more
    return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def model(rows, fanout=2):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {name: tree([leaf(r) for r in groups[name]], fanout) for name in names}
    top = tree([trees[name][-1][0] for name in names], fanout)
    out = []
    for g, name in enumerate(names):
        leaves = trees[name][0]
        for at, row in enumerate(groups[name]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            digest = leaf(row, 1) if tampered else leaves[at]
            folded = rooted(top[0], g, rooted(leaves, at, digest, fanout), fanout)
            proof = sha(*others(trees[name], at, fanout), *others(top, g, fanout))
            root = top[-1][0]
            out.append((row[0], leaves[at], trees[name][-1][0], root, proof, folded, folded == root))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, models.DOCS).repartition(5)
    # Clashing names of other columns are no matter.
    docs = docs.withColumn("pos", F.lit("x")).withColumn("group", F.lit(1)).withColumn("digest", F.lit(2.0))
    got = merkle.report(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, model(rows)))


def sample(count):
    rng = random.Random(count)
    langs = ["en"] * 6 + ["de", "fr", "é", "z", None, ""]
    rows = [
        (i * 3 - 50, rng.choice([None, "", models.prose(rng, 5), "ž😀"]), rng.choice(langs), rng.choice([None, "s", "hot"]), rng.choice([None, 0, i]))
        for i in range(count)
    ]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4, 1024])
def test_against_plain_trees(spark, monkeypatch, block):
    """Blocks of four make several rounds of blocks; one block makes none."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = sample(150) + [(7, "a", "en", "s", 1)] * 3 + [(7, "b", "en", "s", 1), (None, "x", "en", None, 2), (None, None, None, None, None)]
    check(spark, rows)


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 9])
def test_sizes_around_whole_blocks(spark, monkeypatch, count):
    monkeypatch.setattr(merkle, "BLOCK", 4)
    check(spark, [(i, f"t{i}", "en", "s", i) for i in range(count)])


def test_many_groups_and_cells(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CELL_ROWS", 7)
    check(spark, [(i, "t", f"lang{i % 60}" if i % 3 else "hot", "s", i) for i in range(120)])


def test_empty(spark):
    assert merkle.report(models.documents(spark, {1: "a"}).limit(0)).count() == 0


def test_wider_trees(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = sample(40)
    docs = spark.createDataFrame(rows, models.DOCS)
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaves = docs.select(
        F.col("lang").alias("group"), F.col("doc_id").alias("key"), merkle.leaf_digest(named).alias("digest"),
        F.lit(None).cast("binary").alias("changed"),
    )
    got = sorted((r.key, r.leaf, r.subroot, r.root, r.proof_sha256) for r in merkle.manifest(leaves, 3).collect())
    assert got == sorted(row[:5] for row in model(rows, 3))
    with pytest.raises(ValueError):
        merkle.manifest(leaves, 1)


def test_states_are_resumed():
    """A fold reads no left sibling."""
    leaves = [sha(str(i)).encode() for i in range(6)]
    levels, states = merkle.grow(leaves, 3, 2)
    left, right = merkle.siblings(levels, 1, 3)[0]
    assert left == leaves[0] and right == leaves[2]
    assert merkle.resume(states[0][0][1], leaves[1], right) == levels[1][0]
    assert merkle.resume(states[0][0][1], b"x", right).decode() == sha(leaves[0].decode(), "x", leaves[2].decode())
