"""Benchmark decontamination by winnowing.

A document's k-grams of words are hashed; of every run of `GUARANTEE - K + 1` neighbouring hashes
the smallest is kept. Two texts that share GUARANTEE words in a row share such a run, and so share
a kept hash: no shared span of that length is missed. The kept hashes of the documents meet those
of the benchmark; only documents with a common hash are compared word by word, along the diagonals
that the common hashes give.

Defined results: a null or empty text has no words and is clean; an item without words or without
an id occurs nowhere; an item of fewer words than a window must occur as a whole; items that repeat
an id count once; repeated rows repeat their result; an empty table gives an empty result, and an
empty benchmark leaves all documents clean. Only the columns named here are read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import text_of
from foliary.session import materialize, rows_within

#: Words of a window, of a k-gram, and k-grams in the run whose smallest hash is kept.
GUARANTEE = 10
K = 5
RUN = GUARANTEE - K + 1
#: What does not belong to a word.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows up to which a side is broadcast.
SMALL_ROWS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(lowered: Column) -> Column:
    """The words of a text whose A-Z are in lower case."""
    parts = F.split(lowered, BETWEEN)
    first = (F.get(parts, F.lit(0)) == "").cast("int")
    last = ((F.get(parts, F.size(parts) - 1) == "") & (F.size(parts) > 1)).cast("int")
    return F.slice(parts, first + 1, F.size(parts) - first - last)


def _hashes(text: Column) -> Column:
    """Hashes of the words. All letters count as lower case here: what is equal stays equal, and
    what should differ is told apart when hits are compared word by word."""
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def _windows(df: DataFrame, length: int, *keep: str) -> DataFrame:
    """A row for every `length` neighbours in the column `hashes`: their place `at`, and `gram`."""
    count = F.greatest(F.size("hashes") - length + 1, F.lit(0))
    zipped = F.arrays_zip(*[F.slice("hashes", i + 1, count) for i in range(length)])
    return df.select(*keep, F.posexplode(zipped).alias("at", "gram"))


def _prints(df: DataFrame, short: Iterable[int], *keep: str) -> DataFrame:
    """(keep, print, at): the smallest k-gram hash of every window and where it stands, and the
    hashes of all runs of the lengths in `short`."""
    long = _windows(df, GUARANTEE, *keep)
    grams = [F.xxhash64(*[F.col("gram")[str(i + j)] for j in range(K)]).alias(f"gram{i}") for i in range(RUN)]
    long = long.select(*keep, "at", *grams)
    least = F.least(*[F.col(f"gram{i}") for i in range(RUN)])
    long = long.select(*keep, "at", *[f"gram{i}" for i in range(RUN)], least.alias("print"))
    shift = F.lit(RUN - 1)
    for i in reversed(range(RUN - 1)):
        shift = F.when(F.col(f"gram{i}") == F.col("print"), i).otherwise(shift)
    found = long.select(*keep, "print", (F.col("at") + shift).alias("at"))
    for n in short:
        runs = _windows(df, n, *keep)
        whole = F.xxhash64(F.lit(n), *[F.col("gram")[str(j)] for j in range(n)])
        found = found.unionByName(runs.select(*keep, whole.alias("print"), "at"))
    return found


def _items(benchmark: DataFrame) -> DataFrame:
    """Items with their words, A-Z in lower case, and the hashes that stand for these."""
    text = text_of("text")
    found = benchmark.filter("item_id IS NOT NULL").select(
        "item_id", words(F.translate(text, _UPPER, _LOWER)).alias("item_words"), _hashes(text).alias("hashes")
    )
    return found.filter(F.size("item_words") > 0).distinct()


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if rows_within(df, SMALL_ROWS) else df


def _equal_starts(text: Column, item: Column, shift: Column) -> Column:
    """Where on a diagonal a whole window of the item occurs in the text."""
    length = F.least(F.size(item), F.lit(GUARANTEE))
    low = F.greatest(shift, F.lit(0))
    high = F.least(F.size(text), F.size(item) + shift) - length
    steps = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return F.filter(
        steps, lambda i: F.slice(text, i + 1, length) == F.slice(item, i - shift + 1, length)
    )


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document (doc_id, text_key): words, hit words, and the items that occur.

    `text_key` is a hash of the text. Rows with the same id and text have the same result.
    """
    items = materialize(_items(benchmark), "items")
    lengths = items.select(F.size("item_words").alias("n")).filter(F.col("n") < GUARANTEE)
    short = sorted(r["n"] for r in lengths.distinct().collect())  # fewer than GUARANTEE numbers
    item_prints = _prints(items, [], "item_id")
    for n in short:
        own = items.filter(F.size("item_words") == n)
        item_prints = item_prints.unionByName(_prints(own, [n], "item_id"))
    item_prints = materialize(item_prints.distinct(), "prints").select(
        "item_id", "print", F.col("at").alias("item_at")
    )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), text_of("text").alias("text"))
    hashed = keyed.select("doc_id", "text_key", _hashes(F.col("text")).alias("hashes"))
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    met = _prints(hashed, short, "doc_id", "text_key").join(_checked(item_prints), "print")
    met = materialize(met.select("doc_id", "text_key", "item_id", shift).distinct(), "met")
    near = met.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item_id", "shift")).alias("near"))
    near = _checked(materialize(near, "near"))

    same = keyed["doc_id"].eqNullSafe(near["doc_id"]) & (keyed["text_key"] == near["text_key"])
    lowered = words(F.translate(keyed["text"], _UPPER, _LOWER))
    texts = keyed.join(near, same).select(near["doc_id"], near["text_key"], "near", lowered.alias("words"))
    texts = texts.dropDuplicates(["doc_id", "text_key"])
    pairs = texts.select("doc_id", "text_key", "words", F.explode("near").alias("found"))
    pairs = pairs.select("doc_id", "text_key", "words", "found.*").join(_checked(items.drop("hashes")), "item_id")
    starts = _equal_starts(F.col("words"), F.col("item_words"), F.col("shift"))
    length = F.least(F.size("item_words"), F.lit(GUARANTEE))
    hit = F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + length - 1))))
    hits = (
        pairs.withColumn("starts", starts)
        .filter(F.size("starts") > 0)
        .select("doc_id", "text_key", "item_id", hit.alias("hit"))
        .groupBy("doc_id", "text_key")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"),
            F.collect_set("item_id").alias("items"),
        )
    )
    hits = _checked(materialize(hits, "hits"))
    same = keyed["doc_id"].eqNullSafe(hits["doc_id"]) & (keyed["text_key"] == hits["text_key"])
    return keyed.join(hits, same, "left").select(
        keyed["doc_id"],
        keyed["text_key"],
        F.size(words(F.lower(keyed["text"]))).cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array()).alias("items"),
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The result per document, its items as a hash."""
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return occurrences(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of an item occurs."""
    dirty = occurrences(docs, benchmark).filter("n_hit > 0").select("doc_id", "text_key")
    dirty = _checked(materialize(dirty.distinct(), "dirty"))
    same = docs["doc_id"].eqNullSafe(dirty["doc_id"])
    return docs.join(dirty, same & (F.xxhash64(docs["text"]) == dirty["text_key"]), "left_anti")
