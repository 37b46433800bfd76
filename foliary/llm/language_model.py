"""Language-model scores by deleted interpolation.

P(w | v) = a p2(w | v) + b p1(w) + c / (V + 1), with the maximum-likelihood estimates p2 of pairs and
p1 of words, and weights a, b, c for every bucket of contexts v of a similar frequency. The weights
are learned by expectation-maximisation on held-out counts: part of the training documents is kept
from the estimates and shows how well each of them predicts. The final estimates use all of them.

Counts of all words and of all pairs are tables that grow with the corpus; nothing is left out of
them. Every token has a context, the word before it or the start of its text, so the count of a
word is its count as context too, and that of the end is the one of the start. Words that make up
2 ** -20 of all tokens or more, and pairs that do (so 2 ** 20 of each at most), are broadcast as
a short cut. Every other token meets its pair in a join; the table of pairs has met the counts of
both words before, once for each distinct pair, and gives the held-out counts as well.

Defined results: a null or empty text has one token, its end; repeated rows are counted and scored
as often as they occur; without training documents every score is that of an unknown word; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import pieces, prepare, text_of
from foliary.session import materialize

HOT_SHARE, PAIR_SHARE = 2.0**-20, 2.0**-20
#: Buckets of contexts: 0 was never seen, the others halve the share of the tokens.
BUCKETS = 40
#: Steps of a power of e in the histogram that the weights are learned from.
STEPS = 16
ROUNDS = 60
#: No weight of the uniform part is smaller, so no text is impossible.
LEAST = 1e-4
#: Words that a worker remembers, and rows that it gathers before it hands them on.
KNOWN = 400_000
#: Tokens whose pairs a worker gathers, and tokens of one pair that a task joins.
GATHERED, TOKENS_PER_TASK = 2_000_000, 200_000
#: White space is no part of a word, so this stands for the end of a text.
END = b"\n"
#: Parts of the documents: scored only, learned from, and kept for the weights.
TEST, LEARN, KEPT = 0, 1, 2
_COLD = 1 << 63


def hash_of(word: bytes) -> int:
    """63 bits, so that it is a positive long."""
    return xxhash.xxh64_intdigest(word) >> 1


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, then the end."""
    return [*text.lower().split(), END]


def edges_of(total: int) -> list[int]:
    """The largest count of every bucket after the first, in whole numbers."""
    return [int(total) >> k for k in range(1, BUCKETS - 1)]


def bucket_of(count: Column, total: int) -> Column:
    """The bucket of a context by its count, as `Model.contexts` has it."""
    bucket = reduce(Column.__add__, [(count <= F.lit(e)).cast("int") for e in edges_of(total)])
    return F.when(count > 0, bucket + 1).otherwise(0)


@dataclass
class Model:
    """Counts and weights that a scoring worker needs; every part has a proven bound."""

    total: int
    words: int
    hashes: np.ndarray  # of the hot words, sorted
    counts: np.ndarray
    core: np.ndarray  # number of a hot word in the keys of pairs, -1 if it has none; last: start
    pairs: np.ndarray  # the frequent ones: context * size + word, sorted
    pair_counts: np.ndarray
    weights: np.ndarray  # BUCKETS rows of three
    seen: np.ndarray | None = None  # tokens after each context; without it, those of the pairs

    @property
    def size(self) -> int:
        return int(self.core.max(initial=0)) + 1

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """For every numbered word as context: the tokens after it, and its bucket."""
        after = self.seen
        if after is None:
            after = np.bincount(self.pairs // self.size, self.pair_counts, minlength=self.size)
        bucket = 1 + sum((after <= edge).astype(np.int64) for edge in edges_of(self.total))
        return after, np.where(after > 0, bucket, 0)


class Numbers(dict):
    """The number of a hot word, or a marked hash of another one, remembered."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.hashes = hashes

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        code = hash_of(word)
        at = int(np.searchsorted(self.hashes, np.uint64(code)))
        hot = at < len(self.hashes) and self.hashes[at] == code
        value = self[word] = at if hot else code | _COLD
        return value


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = {LEARN: Counter(), KEPT: Counter()}

    def rows() -> pa.RecordBatch:
        words = list(found[LEARN].keys() | found[KEPT].keys())
        columns = [[hash_of(w) for w in words], *[[found[p][w] for w in words] for p in (LEARN, KEPT)]]
        for counts in found.values():
            counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["word", "learn", "kept"]
        )

    for batch in batches:
        for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if part != TEST:
                found[part].update(tokens(text))
        if len(found[LEARN]) + len(found[KEPT]) > KNOWN:
            yield rows()
    yield rows()


def _coded(batch: pa.RecordBatch, numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all tokens of a batch, and where each document ends."""
    codes, ends = [], []
    for text in batch.column("text").to_pylist():
        words = tokens(text)
        codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words)))
        ends.append(len(words))
    return np.concatenate(codes) if codes else np.empty(0, np.uint64), np.cumsum(ends, dtype=np.int64)


def _core_pairs(codes: np.ndarray, ends: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Number among the core words of every token and of the token before it; -1 for others."""
    start = len(model.hashes)
    own = np.full(len(codes), -1, np.int64)
    hot = codes < _COLD
    own[hot] = model.core[codes[hot].astype(np.int64)]
    before = np.empty(len(codes), np.int64)
    before[1:] = own[:-1]
    before[0] = model.core[start]
    before[ends[:-1]] = model.core[start]
    return own, before


def _names(codes: np.ndarray, ends: np.ndarray, numbers: Numbers) -> tuple[np.ndarray, ...]:
    """Of every token: a name of its pair, the word before it, and the word itself.

    A hot word is its hash, another one its hash less 2 ** 63; the start of a text is the end.
    """
    word = codes.copy()
    hot = word < _COLD
    word[hot] = numbers.hashes[word[hot].astype(np.int64)]
    code = numbers[END]
    start = numbers.hashes[code] if code < _COLD else np.uint64(code)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[0] = start
    before[ends[:-1]] = start
    pair = before * np.uint64(0x9E3779B97F4A7C15)
    pair ^= pair >> np.uint64(32)
    pair = (pair + word) * np.uint64(0xC2B2AE3D27D4EB4F)
    pair ^= pair >> np.uint64(29)
    pair *= np.uint64(0x165667B19E3779F9)
    pair ^= pair >> np.uint64(32)
    return pair.view(np.int64), before.view(np.int64), word.view(np.int64)


def _count_pairs(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Counts of all pairs of all documents; those that are only scored count in `n` alone."""
    numbers = Numbers(model.value.hashes)
    held: list[tuple[np.ndarray, ...]] = []

    def rows() -> pa.RecordBatch:
        pair, before, word, part = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(pair)
        pair, part = pair[order], part[order]
        first = np.nonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))[0]
        own = [np.add.reduceat((part == p).astype(np.int64), first) for p in (LEARN, KEPT)]
        n = np.diff(np.append(first, len(pair)))
        columns = [pair[first], before[order[first]], word[order[first]], *own, n]
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], names=["pair", "context", "word", "learn", "kept", "n"]
        )

    waiting = 0
    for batch in pieces(batches):
        part = batch.column("part").to_numpy()
        codes, ends = _coded(batch, numbers)
        if not len(codes):
            continue
        held.append((*_names(codes, ends, numbers), np.repeat(part, np.diff(ends, prepend=0))))
        waiting += len(codes)
        if waiting > GATHERED:
            yield rows()
            waiting = 0
    if held:
        yield rows()


def _estimates(codes, ends, model: Model, after, buckets):
    """Of every token: is it hot, p2, p1 (0 for others), and the bucket of its context."""
    word, before = _core_pairs(codes, ends, model)
    hot = codes < _COLD
    p1 = np.zeros(len(codes))
    p1[hot] = model.counts[codes[hot].astype(np.int64)] / max(model.total, 1)
    bucket = np.where(before >= 0, buckets[before], 0)
    p2 = np.zeros(len(codes))
    both = np.nonzero((word >= 0) & (bucket > 0))[0]
    key = before[both] * model.size + word[both]
    at = np.searchsorted(model.pairs, key)
    at[at == len(model.pairs)] = 0
    found = model.pairs[at] == key if len(model.pairs) else np.zeros(len(key), bool)
    p2[both[found]] = model.pair_counts[at[found]] / after[before[both[found]]]
    return hot, p2, p1, bucket


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """A row for every document with what its frequent pairs add, and rows of the other pairs.

    These say at which rows from `row` on a pair stands, once for every token. The row of a document
    has a name of its own instead of one of a pair, so the join spreads it.
    """
    own: Model = model.value
    numbers = Numbers(own.hashes)
    after, buckets = own.contexts()
    floor = 1.0 / (own.words + 1)
    row = TaskContext.get().partitionId() << 40
    doc_type = pa.struct(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
         ("base", pa.float64()), ("score", pa.float64())]
    )
    schema = pa.schema([("row", pa.int64()), ("pair", pa.int64()), ("at", pa.list_(pa.int32())), ("doc", doc_type)])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def waiting_rows() -> pa.RecordBatch:
        pair, at = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(pair, kind="stable")
        pair, first = pair[order], at[0]
        cuts = np.nonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))[0]
        places = pa.array((at[order] - first).astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(pair)).astype(np.int32)), places)
        start = pa.array(np.full(len(cuts), first, np.int64))
        return pa.RecordBatch.from_arrays([start, pa.array(pair[cuts]), lists, pa.nulls(len(cuts), doc_type)], schema=schema)

    for batch in pieces(batches):
        codes, ends = _coded(batch, numbers)
        if not len(codes):
            continue
        _, p2, p1, bucket = _estimates(codes, ends, own, after, buckets)
        fast = p2 > 0
        lengths = np.diff(ends, prepend=0)
        doc = np.repeat(np.arange(len(ends)), lengths)
        mixed = own.weights[bucket] * np.stack([p2, p1, np.full(len(p1), floor)], axis=1)
        base = np.log10((p1 * own.total + 1) / (own.total + own.words + 1))
        known = np.bincount(doc, fast, len(ends)).astype(np.int64)
        with np.errstate(divide="ignore"):
            parts = [np.bincount(doc, np.where(fast, x, 0.0), len(ends)) for x in (base, np.log10(mixed.sum(axis=1)))]
        ids = row + np.arange(len(ends))
        row += len(ends)
        docs = pa.StructArray.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(lengths), pa.array(known),
             *[pa.array(x) for x in parts]], fields=list(doc_type)
        )
        own_place = pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32), np.zeros(len(ids), np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids * 0x9E3779B1), own_place, docs], schema=schema)
        slow = np.nonzero(~fast)[0]
        if len(slow):
            held.append((_names(codes, ends, numbers)[0][slow], ids[doc[slow]]))
            waiting += len(slow)
        if waiting > GATHERED:
            yield waiting_rows()
            waiting = 0
    if held:
        yield waiting_rows()


def learn_weights(rows: np.ndarray, words: int) -> np.ndarray:
    """Weights by bucket from rows (bucket, step of p2, step of p1, count)."""
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    weights[1:] = [0.4, 0.5, 0.1]
    for bucket in range(BUCKETS):
        own = rows[rows[:, 0] == bucket]
        if not len(own):
            # Rarer contexts than any that was seen take the weights of the rarest.
            if any(0 < b < bucket for b in rows[:, 0]):
                weights[bucket] = weights[bucket - 1]
            continue
        p = np.stack([np.where(own[:, i] > 0, 0.0, np.exp(own[:, i] / STEPS)) for i in (1, 2)], axis=1)
        p = np.concatenate([p, np.full((len(own), 1), 1.0 / (words + 1))], axis=1)
        mix = weights[bucket]
        for _ in range(ROUNDS):
            parts = p * mix
            parts /= parts.sum(axis=1, keepdims=True)
            mix = (parts * own[:, 3:4]).sum(axis=0) / own[:, 3].sum()
        mix = np.maximum(mix, [0.0, LEAST, LEAST])
        weights[bucket] = mix / mix.sum()
    return weights


def _with_counts(pairs: DataFrame, words: DataFrame, is_hot: Column, name: str) -> DataFrame:
    """Add the counts of the words in column `name`: hot ones are broadcast, so no key of the join is hot."""
    counts = [F.col(c).alias(f"{name}_{c}") for c in ("learn", "both")]
    own = [*pairs.columns, *[F.coalesce(f"{name}_{c}", F.lit(0)).alias(f"{name}_{c}") for c in ("learn", "both")]]
    hot = F.broadcast(words.filter(is_hot).select(F.col("word").alias(name), *counts))
    cold = words.filter(~is_hot).select((F.col("word") + F.lit(-_COLD)).alias(name), *counts)
    one = pairs.filter(F.col(name) >= 0).join(hot, name, "left")
    return one.select(own).unionByName(pairs.filter(F.col(name) < 0).join(cold, name, "left").select(own))


def score(docs: DataFrame, part: Column) -> DataFrame:
    """Score every document; `part` says which are TEST, LEARN or KEPT."""
    spark = prepare(docs.sparkSession)
    send = spark.sparkContext.broadcast
    texts = docs.select(
        F.col("doc_id").cast("long"), part.cast("int").alias("part"), text_of("text").cast("binary").alias("text")
    )
    counted = texts.filter(F.col("part") != TEST).select("part", "text").mapInArrow(
        _count_words, "word long, learn long, kept long"
    )
    counted = counted.groupBy("word").agg(F.sum("learn").alias("learn"), F.sum("kept").alias("kept"))
    words = materialize(counted.withColumn("both", F.col("learn") + F.col("kept")), "words")
    totals = words.agg(
        F.coalesce(F.sum("both"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("learn"), F.lit(0)),
        F.count(F.when(F.col("learn") > 0, 1)),
    ).first()
    total, distinct, learn_total, learn_distinct = totals
    # 1 / HOT_SHARE words at most.
    is_hot = F.col("both") >= F.lit(float(HOT_SHARE * total))
    hot = words.filter(is_hot).orderBy("word").toPandas()
    hashes, both = hot["word"].to_numpy(np.uint64), hot["both"].to_numpy(np.int64)
    core = np.arange(len(hot) + 1)

    none = np.empty(0, np.int64)
    blank = np.zeros((BUCKETS, 3))
    bare = Model(total, distinct, hashes, both, core, none, none, blank)
    pairs = texts.select("part", "text").mapInArrow(
        partial(_count_pairs, model=send(bare)), "pair long, context long, word long, learn long, kept long, n long"
    )
    pairs = pairs.groupBy("pair").agg(
        *[F.first(c).alias(c) for c in ("context", "word")], *[F.sum(c).alias(c) for c in ("learn", "kept", "n")]
    )
    pairs = materialize(pairs, "counted")
    pairs = _with_counts(_with_counts(pairs, words, is_hot, "context"), words, is_hot, "word")
    pairs = materialize(pairs, "pairs")

    def share(one: str, other: Column) -> Column:
        return F.when(F.col(one) > 0, F.round(F.log(F.col(one) / other) * STEPS)).otherwise(1)

    # A bounded number of buckets and steps.
    grid = pairs.filter("kept > 0").groupBy(
        bucket_of(F.col("context_learn"), learn_total).alias("bucket"),
        share("learn", F.col("context_learn")).cast("long").alias("step2"),
        share("word_learn", F.lit(float(max(learn_total, 1)))).cast("long").alias("step1"),
    ).agg(F.sum("kept").alias("n")).toPandas()
    weights = learn_weights(grid.to_numpy(np.float64).reshape(-1, 4), learn_distinct)

    # 1 / PAIR_SHARE pairs at most.
    trained = F.col("learn") + F.col("kept")
    frequent = (F.col("context") >= 0) & (F.col("word") >= 0) & (trained > 0) & (trained >= F.lit(float(PAIR_SHARE * total)))
    fast = pairs.filter(frequent).select("context", "word", trained.alias("n")).toPandas()
    at = [np.searchsorted(hashes, fast[c].to_numpy(np.uint64)) for c in ("context", "word")]
    ends = words.filter(F.col("word") == hash_of(END)).select("both").first()
    ends = ends[0] if ends else 0
    is_end = fast["context"].to_numpy(np.int64) == hash_of(END)
    keys = np.where(is_end, len(hashes), at[0]) * len(core) + at[1]
    order = np.argsort(keys)
    model = Model(
        total, distinct, hashes, both, core, keys[order], fast["n"].to_numpy(np.int64)[order], weights, np.append(both, ends)
    )
    inputs = texts.select("doc_id", (F.col("part") == TEST).alias("held_out"), "text")
    rows = inputs.mapInArrow(
        partial(_score, model=send(model)),
        "row long, pair long, at array<int>, doc struct<doc_id: long, held_out: boolean, n_tokens: long, n_known: long, "
        "base: double, score: double>",
    )

    context, word = F.col("context_both"), F.col("word_both")
    bucket = bucket_of(context, total)
    a, b, c = (F.get(F.array(*[F.lit(float(w)) for w in weights[:, i]]), bucket) for i in range(3))
    p2 = F.when(context > 0, trained / context).otherwise(0.0)
    mixed = a * p2 + b * word / F.lit(float(max(total, 1))) + c / F.lit(float(distinct + 1))
    base = F.log10((word + 1) / F.lit(float(total + distinct + 1)))
    known = (word > 0).cast("long")
    slow = pairs.filter(~frequent)
    priced = slow.select("pair", base.alias("base"), F.log10(mixed).alias("score"), known.alias("known"))
    # Pairs that many documents hold though the training documents do not.
    cuts = slow.filter(F.col("n") > TOKENS_PER_TASK).select("pair", F.ceil(F.col("n") / TOKENS_PER_TASK).cast("int").alias("cuts"))
    on = ["pair"]
    if not cuts.isEmpty():
        on, parts = ["pair", "salt"], F.coalesce("cuts", F.lit(1))
        rows = rows.join(F.broadcast(cuts), "pair", "left").withColumn("salt", F.pmod(F.xxhash64("row"), parts).cast("int"))
        priced = priced.join(F.broadcast(cuts), "pair", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))

    def added(name: str, other: str) -> Column:
        return F.sum(F.coalesce(F.col(f"doc.{name}"), F.when(F.col("doc").isNull(), F.col(other)), F.lit(0)))

    met = rows.join(priced, on, "left").withColumn("place", F.explode("at"))
    met = met.groupBy((F.col("row") + F.col("place")).alias("row")).agg(
        *[F.max(f"doc.{c}").alias(c) for c in ("doc_id", "held_out", "n_tokens")],
        added("n_known", "known").alias("n_known"), added("base", "base").alias("base_score"),
        added("score", "score").alias("score"),
    )
    return met.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def split(remainder: Column, test: int, kept: int) -> Column:
    """The part of a document by the remainder of its id's checksum."""
    return F.when(remainder == test, TEST).when(remainder == kept, KEPT).otherwise(LEARN)
