"""Hard negatives by the threshold algorithm over sorted lists.

An anchor is a row; its positives are the nearest rows of its label, and its hard negatives for one
positive are the best rows of other labels whose score lies in a window below the positive's score.
Scores are whole numbers: inner products of components cut to units.

Candidates lie in blocks. A block has one list of its rows for each dimension, sorted by that
component. An anchor reads every list from the end that its own component's sign asks for, in
rounds; each row it meets is looked up and scored exactly. What no list has shown yet scores at
most the threshold: the anchor times the last values read. Reading stops once the threshold is
strictly below the last kept score of each window (or below the window itself, while it has room),
so ties are all seen. When half of a block has been met, the rest is scored without reading on.

Two passes: positives in blocks of one label, negatives in blocks of all. A hot label has as many blocks as it
needs, and anchors stream past a block, so a task holds one block and a batch.

Defined results: rows with a null id or label, a null vector, or null or non-finite components take
no part; a vector that is shorter than another counts as filled up with zeros; equal rows count
once; rows that share an id but differ are rows of their own, and none is a positive or negative of
its id; equal scores are ordered by the smaller id; an empty table gives an empty result. Sums beyond
2^53 are computed with whole numbers of any size, and a score beyond the long type is cut to its range.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.llm.common import pieces, prepare
from foliary.session import materialize

#: Rows of a block, anchors taken together, and rows that the first round reads of every list.
BLOCK_ROWS = 32_768
ANCHORS = 256
FIRST_ROWS = 8
#: Up to here sums of doubles are exact; the range of a long.
EXACT = 2.0**53
LONGEST = 2**63 - 1


def units(column: pa.Array, factor: float) -> np.ndarray:
    """Components cut to whole units, a row for each vector; short vectors are filled up with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = np.floor(values * factor)
    return out


def widen(matrix: np.ndarray, width: int) -> np.ndarray:
    """The first `width` components, with zeros for those a matrix lacks."""
    out = np.zeros((len(matrix), width))
    shared = min(width, matrix.shape[1])
    out[:, :shared] = matrix[:, :shared]
    return out


class Block:
    """Candidates with a sorted list for every dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        count = len(ids)
        self.order = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32)
        sizes = [min(FIRST_ROWS, count)]
        while sizes[-1] < count:
            sizes.append(min(4 * sizes[-1], count))
        self.depths = sizes
        at = np.array(sizes)
        each = np.arange(rows.shape[1])[:, None]
        #: Last values read, by dimension and round, from the high and from the low end.
        self.high = rows[self.order[:, count - at], each]
        self.low = rows[self.order[:, at - 1], each]
        self.largest = np.abs(rows).max(axis=0, initial=0)

    def thresholds(self, anchors: np.ndarray) -> np.ndarray:
        """For every anchor and round, what a row not met yet can score at most."""
        return np.maximum(anchors, 0) @ self.high + np.minimum(anchors, 0) @ self.low

    def exact(self, anchors: np.ndarray) -> bool:
        """Whether sums of doubles hold every score of these anchors exactly."""
        # Each sum is rounded, so a margin is kept.
        return bool((np.abs(anchors) @ self.largest < EXACT / 2).all())

    def met(self, anchor: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of this block that each round of sorted access meets first."""
        count, seen, before = len(self.ids), np.zeros(len(self.ids), bool), 0
        up, down = np.nonzero(anchor >= 0)[0], np.nonzero(anchor < 0)[0]
        for depth in self.depths:
            fresh = np.zeros(count, bool)
            if 2 * seen.sum() < count and depth < count:
                fresh[self.order[:, count - depth : count - before][up]] = True
                fresh[self.order[:, before:depth][down]] = True
            else:
                fresh[:] = True
            fresh &= ~seen
            seen |= fresh
            yield np.nonzero(fresh)[0]
            if seen.all():
                return
            before = depth

    def scores(self, at: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return self.rows[at] @ anchor
        own = [int(x) for x in anchor]
        return np.array([sum(int(x) * y for x, y in zip(r, own, strict=True)) for r in self.rows[at]], object)


def best(ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the `count` best by score, then by smaller id."""
    return np.lexsort((ids, -scores))[:count]


def search(
    block: Block, anchor: np.ndarray, bounds: np.ndarray, exact: bool, own: int,
    same: int | None, other: int | None, windows: list[tuple[int, int]], count: int,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the `count` best rows in each window (lowest, highest score).

    `own` is the id left out; `same` or `other` the label that rows must or must not have.
    """
    empty = np.zeros(0, np.float64 if exact else object)
    ids, scores = np.zeros(0, np.int64), empty
    lowest, highest = min(w[0] for w in windows), max(w[1] for w in windows)
    for step, at in enumerate(block.met(anchor)):
        got = block.scores(at, anchor, exact)
        fits = (block.ids[at] != own) & (got >= lowest) & (got <= highest)
        if same is not None:
            fits &= block.labels[at] == same
        if other is not None:
            fits &= block.labels[at] != other
        fits = fits.astype(bool)
        ids, scores = np.concatenate([ids, block.ids[at][fits]]), np.concatenate([scores, got[fits]])
        inside = [(scores >= low) & (scores <= high) for low, high in windows]
        kept = []
        for picked in inside:
            place = np.nonzero(picked.astype(bool))[0]
            kept.append(place[best(ids[place], scores[place], count)])
        edges = [scores[p[-1]] if len(p) == count else low for p, (low, _) in zip(kept, windows, strict=True)]
        # Whole numbers of any size need no threshold: their blocks are read to the end.
        if exact and all(bounds[step] < edge for edge in edges):
            break
        used = np.unique(np.concatenate(kept))
        back = {int(p): i for i, p in enumerate(used)}
        kept = [np.array([back[int(p)] for p in k], np.int64) for k in kept]
        ids, scores = ids[used], scores[used]
    else:
        return [(ids[k], scores[k]) for k in kept] if len(block.ids) else [(ids, scores)] * len(windows)
    return [(ids[k], scores[k]) for k in kept]


def _long(score) -> int:
    return max(-LONGEST - 1, min(LONGEST, int(score)))


def _blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], factor: float):
    """Each block with each batch of its anchors: (block, batch, units of the anchors).

    Rows are sorted by block, in each the candidates before the anchors.
    """
    key, held, block = None, [], None
    for batch in pieces(batches, ANCHORS):
        names = np.stack([batch.column(c).to_numpy() for c in (*keys, "asks")], axis=1)
        cuts = np.nonzero((names[1:] != names[:-1]).any(axis=1))[0] + 1
        for start, end in zip([0, *cuts], [*cuts, len(names)], strict=True):
            if start == end:
                continue
            own = batch.slice(start, end - start)
            if key is None or (names[start, :-1] != key).any():
                key, held, block = names[start, :-1], [], None
            if not names[start, -1]:
                ids, labels = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
                held.append((ids, labels, units(own.column("vector"), factor)))
                continue
            if block is None and held:
                width = max(m.shape[1] for _, _, m in held)
                block = Block(
                    np.concatenate([i for i, _, _ in held]),
                    np.concatenate([x for _, x, _ in held]),
                    np.concatenate([widen(m, width) for _, _, m in held]),
                )
                held = []
            if block is not None:
                yield block, own, widen(units(own.column("vector"), factor), block.rows.shape[1])


def _positives(batches: Iterator[pa.RecordBatch], factor: float, count: int) -> Iterator[pa.RecordBatch]:
    """(anchor, vec_id, score): the best rows of the anchor's own label in every block."""
    for block, asks, anchors in _blocks(batches, ("label", "part"), factor):
        bounds, exact, out = block.thresholds(anchors), block.exact(anchors), []
        whole = [(-float("inf"), float("inf"))]
        names = zip(asks.column("anchor").to_pylist(), asks.column("vec_id").to_pylist(), strict=True)
        for i, (name, own) in enumerate(names):
            ids, scores = search(block, anchors[i], bounds[i], exact, own, None, None, whole, count)[0]
            out += [(name, int(v), _long(s)) for v, s in zip(ids, scores, strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["anchor", "vec_id", "score"]
            )


def _negatives(
    batches: Iterator[pa.RecordBatch], factor: float, count: int, low: int, high: int
) -> Iterator[pa.RecordBatch]:
    """(anchor, place, vec_id, score): the best rows of other labels in the window of every positive."""
    for block, asks, anchors in _blocks(batches, ("part",), factor):
        bounds, exact, out = block.thresholds(anchors), block.exact(anchors), []
        names = ("anchor", "vec_id", "label", "positives")
        for i, row in enumerate(asks.select(list(names)).to_pylist()):
            # low * positive <= 100 * negative <= high * positive, in whole numbers.
            windows = [(-(-low * p // 100), high * p // 100) for p in row["positives"]]
            open_ = [(place, w) for place, w in enumerate(windows) if w[0] <= w[1]]
            if not open_:
                continue
            found = search(
                block, anchors[i], bounds[i], exact, row["vec_id"], None, row["label"], [w for _, w in open_], count
            )
            for (place, _), (ids, scores) in zip(open_, found, strict=True):
                out += [(row["anchor"], place, int(v), _long(s)) for v, s in zip(ids, scores, strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["anchor", "place", "vec_id", "score"]
            )


def usable(df: DataFrame, vector: str, label: Column) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, equal rows once."""
    rows = df.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(finite)
    return rows.dropDuplicates(["vec_id", "label", "vector"])


def mine(
    df: DataFrame, vector: str, label: Column, is_anchor: Column,
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, factor: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `low` and `high` are the window of negatives as hundredths of the positive's score.
    """
    spark = prepare(df.sparkSession)
    rows = materialize(usable(df, vector, label), "vectors")
    # Differing rows may share an id, so an anchor goes by a hash of its row.
    anchors = rows.filter(is_anchor).withColumn("anchor", F.xxhash64("vec_id", "label", "vector"))
    anchors = materialize(anchors, "anchors")
    name = F.xxhash64("vec_id")
    none = F.lit(None).cast("long").alias("anchor")

    # At most rows / BLOCK_ROWS labels have more than one block.
    hot = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    hot = F.broadcast(materialize(hot.filter("parts > 1"), "hot-labels"))
    parts = F.coalesce("parts", F.lit(1))
    rows_of = rows.join(hot, "label", "left").withColumn("part", F.pmod(name, parts))
    asks = anchors.join(hot, "label", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    columns = ["label", F.col("part").cast("long").alias("part"), "vec_id", "vector"]
    met = rows_of.select(*columns, none, F.lit(0).alias("asks")).unionByName(
        asks.select(*columns, "anchor", F.lit(1).alias("asks"))
    )
    met = met.repartition("label", "part").sortWithinPartitions("label", "part", "asks")
    found = met.mapInArrow(partial(_positives, factor=factor, count=positives), "anchor long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("place", rank - 1).filter(F.col("place") < positives)
    # At most `positives` entries in a list.
    listed = F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("listed")
    found = materialize(found.groupBy("anchor").agg(listed), "positives")

    blocks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // BLOCK_ROWS))
    asks = anchors.join(found, "anchor").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("part"),
        "label",
        "vec_id",
        "vector",
        "anchor",
        F.transform("listed", lambda p: p["score"]).alias("positives"),
        F.lit(1).alias("asks"),
    )
    rows_of = rows.select(
        F.pmod(name, F.lit(blocks)).alias("part"), "label", "vec_id", "vector", none,
        F.lit(None).cast("array<long>").alias("positives"), F.lit(0).alias("asks"),
    )
    met = rows_of.unionByName(asks).repartition("part").sortWithinPartitions("part", "asks")
    mined = met.mapInArrow(
        partial(_negatives, factor=factor, count=negatives, low=low, high=high),
        "anchor long, place long, vec_id long, score long",
    )
    rank = F.row_number().over(W.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id"))
    mined = mined.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    names = anchors.select("anchor", F.col("vec_id").alias("anchor_id")).join(found, "anchor")
    pair = F.get("listed", F.col("place").cast("int"))
    return mined.join(names, "anchor").select(
        "anchor_id",
        pair["vec_id"].alias("positive_id"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        pair["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def report(df: DataFrame) -> DataFrame:
    """Hard negatives of the given vectors; every seventh label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(df, "embedding", moved, F.col("vec_id") % 100 == 0)
