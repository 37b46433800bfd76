"""Approximate nearest neighbours by multiprobe p-stable hashing.

The largest inner product is sought. Vectors get one more component that brings all of them to the
length of the longest, queries get a 0 there; then the nearest vector is the one with the largest
inner product. Every table hashes a vector by `functions` Gaussian projections, cut into
steps. A query visits its own bucket and then those next to it, in the order of the estimated chance
that a neighbour lies there: the squared distances to the steps' edges, summed up. What the tables
find is scored on the original vectors in double precision.

The number of projections follows the logarithm of the number of vectors, as far as neighbours are
reached: the true neighbours of a bounded sample of queries are sought in full, and projections are
left out, then probes, then tables double until RECALL of them are reached. More probes in finer
buckets would meet no fewer candidates, and each visit of a bucket moves the query. A query that
meets fewer candidates than asked for is searched in full. A bucket with more than BUCKET_ROWS rows
is cut, and each of its parts is searched in full: no candidate is left out. Batches of visits are
bounded, whatever the number of probes.

Defined results: vectors that are null, of another length than most, zero, or with null or
non-finite components take no part, nor do rows without an id; repeated rows of an id count as one
candidate by their best score; equal scores are ordered by the smaller id; with fewer candidates
than asked for, all of them are returned, since such a query is searched in full; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.llm.common import BATCH_ROWS, pieces, prepare
from foliary.session import materialize

#: Vectors for which the fewest projections are enough, and how many these are.
BASE_ROWS, LEAST = 4000, 2
#: Tables and probes to begin with; the share of a sample's true neighbours that they have to reach.
TABLES, PROBES = 10, 16
RECALL, SAMPLE = 0.95, 64
#: Steps of a projection, as a multiple of the largest length; the factor a projection divides by.
STEP, FACTOR = 1.2, 2.0
SEED = 7
#: Candidates of a bucket that are searched at once, queries scored at once, queries held by a task.
BUCKET_ROWS, QUERY_ROWS, HELD = 20_000, 256, 50_000
#: Rows with a vector that a task hands on at once, and visits that it works out at once.
PLACED_ROWS, VISITS = 4096, 50_000
#: Scores closer than this are compared again by their exact sums.
SLACK = 1e-9


@dataclass
class Hashing:
    """Projections of all tables; their size does not follow the data.

    Without tables there is one bucket, in which every row is met.
    """

    planes: np.ndarray  # tables, functions, dimension + 1
    shifts: np.ndarray  # tables, functions
    step: float
    longest: float

    @classmethod
    def make(cls, dimension: int, rows: int, longest: float, tables: int, functions: int | None = None) -> Hashing:
        """As many projections as the number of rows asks for, unless `functions` are given."""
        if functions is None:
            functions = max(LEAST, round(math.log(max(rows, 1) / BASE_ROWS) / math.log(FACTOR)))
        functions = functions if tables else 0
        random = np.random.default_rng(SEED)
        planes = random.standard_normal((max(tables, 1), functions, dimension + 1))
        step = STEP * longest
        return cls(planes, random.uniform(0, step, planes.shape[:2]), step, longest)

    def project(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Positions on every projection, in steps: rows, tables, functions."""
        rest = self.longest**2 - np.einsum("ij,ij->i", vectors, vectors)
        last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(rest, 0.0))
        full = np.concatenate([vectors, last[:, None]], axis=1)
        return (np.einsum("nd,tfd->ntf", full, self.planes, optimize=True) + self.shifts) / self.step

    def names(self, steps: np.ndarray) -> np.ndarray:
        """A 63-bit name of every bucket: rows, tables."""
        out = np.broadcast_to(np.arange(steps.shape[1], dtype=np.uint64), steps.shape[:2]).copy()
        for i in range(steps.shape[2]):
            out = (out ^ steps[:, :, i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return (out >> np.uint64(1)).astype(np.int64)


def probes(position: np.ndarray, count: int) -> list[list[tuple[int, int]]]:
    """Sets of (function, -1 or 1) in order of estimated success; the first set is empty."""
    inside = position - np.floor(position)
    edges = sorted(
        [(x * x, i, -1) for i, x in enumerate(inside)] + [((1 - x) ** 2, i, 1) for i, x in enumerate(inside)]
    )
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(edges[0][0], (0,))] if edges else []
    while heap and len(out) < count:
        cost, chosen = heapq.heappop(heap)
        moves = [edges[c][1:] for c in chosen]
        if len({i for i, _ in moves}) == len(moves):
            out.append(moves)
        following = chosen[-1] + 1
        if following < len(edges):
            heapq.heappush(heap, (cost - edges[chosen[-1]][0] + edges[following][0], (*chosen[:-1], following)))
            heapq.heappush(heap, (cost + edges[following][0], (*chosen, following)))
    return out


def reached(hashing: Hashing, queries: np.ndarray, found: np.ndarray, count: int) -> float:
    """The share of pairs of a query and a neighbour that `count` probes of every table bring together."""
    own, there = hashing.project(queries, query=True), np.floor(hashing.project(found, query=False))
    known: dict[tuple, set] = {}
    hits = 0
    for i in range(len(own)):
        for t in range(own.shape[1]):
            moves = there[i, t] - np.floor(own[i, t])
            if np.abs(moves).max(initial=0) > 1:
                continue
            key = (queries[i].tobytes(), t)
            if key not in known:
                known[key] = {frozenset(x) for x in probes(own[i, t], count)}
            if frozenset((f, int(d)) for f, d in enumerate(moves) if d) in known[key]:
                hits += 1
                break
    return hits / max(len(own), 1)


def _matrix(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(batch.num_rows, dimension)


def _index(batches: Iterator[pa.RecordBatch], hashing: Hashing, dimension: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        steps = np.floor(hashing.project(_matrix(batch, dimension), query=False))
        names = hashing.names(steps)
        tables = names.shape[1]
        at = np.repeat(np.arange(batch.num_rows), tables)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names.ravel()), batch.column("vec_id").take(pa.array(at))], names=["bucket", "vec_id"]
        )


def _place(batches: Iterator[pa.RecordBatch], hashing: Hashing, dimension: int, query: bool, count: int) -> Iterator[pa.RecordBatch]:
    """A row for every bucket that a vector lies in, or that a query visits."""
    visits = max(1, hashing.planes.shape[0]) * (count if query else 1)
    for batch in pieces(batches, min(250, max(1, VISITS // visits))):
        positions = hashing.project(_matrix(batch, dimension), query)
        if not query:
            names = hashing.names(np.floor(positions))
            at, buckets = np.repeat(np.arange(len(names)), names.shape[1]), names.ravel()
        else:
            rows, own = [], np.floor(positions)
            for i in range(len(own)):
                sets = [probes(positions[i, t], count) for t in range(own.shape[1])]
                for k in range(max(map(len, sets))):
                    moved = own[i].copy()
                    for t, table in enumerate(sets):
                        for f, d in table[min(k, len(table) - 1)]:
                            moved[t, f] += d
                    rows.append((i, moved))
            names = hashing.names(np.stack([m for _, m in rows]))
            at, buckets = np.repeat([i for i, _ in rows], names.shape[1]), names.ravel()
            pairs = np.unique(np.stack([at, buckets], axis=1), axis=0)
            at, buckets = pairs[:, 0], pairs[:, 1]
        for start in range(0, len(at), PLACED_ROWS):
            take = pa.array(at[start : start + PLACED_ROWS])
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets[start : start + PLACED_ROWS]), batch.column("vec_id").take(take), batch.column("vector").take(take)],
                names=["bucket", "vec_id", "vector"],
            )


class Best:
    """The best candidates of every query that a task has met."""

    def __init__(self, count: int):
        self.count = count
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.held:
            old_ids, old = self.held[query]
            ids, scores = np.concatenate([old_ids, ids]), np.concatenate([old, scores])
        order = np.lexsort((ids, -scores))
        # An id counts once, by its best score, before the rest is cut off.
        _, first = np.unique(ids[order], return_index=True)
        order = order[np.sort(first)[: self.count]]
        self.held[query] = (ids[order], scores[order])

    def rows(self) -> pa.RecordBatch:
        sizes = [len(ids) for ids, _ in self.held.values()]
        query = np.repeat(np.fromiter(self.held, np.int64, len(self.held)), sizes)
        ids = np.concatenate([ids for ids, _ in self.held.values()])
        scores = np.concatenate([s for _, s in self.held.values()])
        self.held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"]
        )


def _search(batches: Iterator[pa.RecordBatch], dimension: int, count: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and part, in each the candidates before the queries."""
    best, key = Best(count), None
    ids: list[np.ndarray] = []
    vectors: list[np.ndarray] = []
    repeated, starts = None, None
    for batch in pieces(batches, QUERY_ROWS):
        keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "part", "is_query")], axis=1)
        cuts = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
        for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if start == end:
                continue
            own = batch.slice(start, end - start)
            if key is None or (keys[start, :2] != key).any():
                key, ids, vectors, repeated = keys[start, :2], [], [], None
            matrix, names = _matrix(own, dimension), own.column("vec_id").to_numpy()
            if not keys[start, 2]:
                ids.append(names)
                vectors.append(matrix)
                continue
            if not ids:
                continue
            if len(ids) > 1:
                ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
            if repeated is None:
                # Rows by id, so that the best of each id can be told from its copies.
                repeated = len(np.unique(ids[0])) < len(ids[0])
                if repeated:
                    order = np.argsort(ids[0], kind="stable")
                    ids, vectors = [ids[0][order]], [vectors[0][order]]
                    starts = np.nonzero(np.r_[True, ids[0][1:] != ids[0][:-1]])[0]
            scores = matrix @ vectors[0].T
            scores[names[:, None] == ids[0][None, :]] = -np.inf
            for i, query in enumerate(names):
                row = scores[i]
                each = np.maximum.reduceat(row, starts) if repeated else row
                if len(each) > count:
                    edge = np.partition(each, len(each) - count)[len(each) - count]
                    near = np.nonzero((row >= edge - SLACK) & (row > -np.inf))[0]
                else:
                    near = np.nonzero(row > -np.inf)[0]
                if len(near):
                    # Sums of one row each: equal vectors have equal scores.
                    exact = (vectors[0][near] * matrix[i]).sum(axis=1)
                    best.add(int(query), ids[0][near], exact)
            if len(best.held) > HELD:
                yield from pieces([best.rows()], BATCH_ROWS)
    if best.held:
        yield from pieces([best.rows()], BATCH_ROWS)


def _nearest(batches: Iterator[pa.RecordBatch], sample: dict, dimension: int, count: int) -> Iterator[pa.RecordBatch]:
    """The nearest of a task's rows for each query of a sample."""
    best = Best(count)
    for batch in batches:
        if batch.num_rows:
            ids, vectors = batch.column("vec_id").to_numpy(), _matrix(batch, dimension)
            for query, vector in sample.items():
                other = ids != query
                best.add(query, ids[other], vectors[other] @ vector)
    if best.held:
        yield best.rows()


def _hashing(rows: DataFrame, queries: DataFrame, usual, count: int) -> tuple[Hashing, int]:
    """Projections, and the number of probes, that reach enough neighbours of a sample."""
    tables, visited = TABLES, PROBES
    hashing = Hashing.make(usual["dimension"], usual["rows"], usual["longest"], tables)
    functions = hashing.planes.shape[1]
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample = {r["vec_id"]: np.array(r["vector"], np.float64) for r in sample}
    near = partial(_nearest, sample=sample, dimension=usual["dimension"], count=count)
    best = rows.mapInArrow(near, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    # SAMPLE * count rows at most.
    best = best.withColumn("rank", rank).filter(F.col("rank") <= count).select("query_id", "vec_id")
    # Found before rows of an id are told apart: only these vectors move.
    pairs = rows.join(F.broadcast(best), "vec_id").dropDuplicates(["query_id", "vec_id"]).select("query_id", "vector").collect()
    if not pairs:
        return hashing, visited
    own = np.stack([sample[r["query_id"]] for r in pairs])
    found = np.array([r["vector"] for r in pairs], np.float64)
    while reached(hashing, own, found, visited) < RECALL:
        if functions > LEAST:
            functions -= 1
        elif visited < 3**functions:
            visited = min(2 * visited, 3**functions)
        else:
            tables *= 2
        hashing = Hashing.make(usual["dimension"], usual["rows"], usual["longest"], tables, functions)
    return hashing, visited


def usable(df: DataFrame, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    own = df.select(F.col("vec_id").cast("long"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    own = own.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(finite & some)
    return own


def search(df: DataFrame, vector: str, is_query: Column, count: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the `count` nearest found for the rows `is_query` picks."""
    spark = prepare(df.sparkSession)
    rows = usable(df, vector)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = rows.groupBy(F.size("vector").alias("dimension")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(length).alias("longest")
    )
    usual = sizes.orderBy(F.desc("rows"), "dimension").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension = usual["dimension"]
    rows = rows.filter(F.size("vector") == dimension)
    asked = rows.filter(is_query)
    hashing, visited = _hashing(rows, asked, usual, count)
    one = _scored(rows, asked, hashing, visited, dimension, count)
    one = materialize(one, "found")
    enough = one.groupBy("query_id").count().filter(F.col("count") >= count).select(F.col("query_id").alias("vec_id"))
    few = materialize(asked.join(enough, "vec_id", "left_anti"), "few")
    if not few.isEmpty():
        full = Hashing.make(dimension, 1, usual["longest"], 0)
        more = _scored(rows, few, full, 1, dimension, count)
        one = one.unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")


def _scored(rows: DataFrame, asked: DataFrame, hashing: Hashing, visited: int, dimension: int, count: int) -> DataFrame:
    """(query_id, vec_id, score) of the best candidates in the buckets that the queries visit."""
    placed = partial(_place, hashing=hashing, dimension=dimension, count=visited)
    schema = f"bucket long, vec_id long, vector {rows.schema['vector'].dataType.simpleString()}"
    index = rows.mapInArrow(partial(_index, hashing=hashing, dimension=dimension), "bucket long, vec_id long")
    # Buckets that have to be cut: rows * TABLES / BUCKET_ROWS at most.
    cuts = index.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("parts"))
    cuts = F.broadcast(materialize(cuts.filter("parts > 1"), "cuts"))
    parts = F.coalesce("parts", F.lit(1))
    candidates = rows.mapInArrow(partial(placed, query=False), schema).join(cuts, "bucket", "left")
    candidates = candidates.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
    queries = asked.mapInArrow(partial(placed, query=True), schema).join(cuts, "bucket", "left")
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    both = candidates.withColumn("is_query", F.lit(0)).unionByName(queries.withColumn("is_query", F.lit(1)))
    met = both.select("bucket", "part", "is_query", "vec_id", "vector").repartition("bucket", "part")
    found = met.sortWithinPartitions("bucket", "part", "is_query").mapInArrow(
        partial(_search, dimension=dimension, count=count), "query_id long, vec_id long, score double"
    )
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
