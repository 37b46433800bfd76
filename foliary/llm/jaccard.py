"""N-gram Jaccard join with count-vector R-trees.

A document's set holds hashes of its distinct word shingles. Equal sets are one class, so copies
are joined without any pair. What follows works on classes:

1. Shingles are hashed into groups and counted over the whole corpus. The counts order the
   shingles, rare groups first. Two sets with a Jaccard similarity of at least t share one of their
   first n - ceil(t n) + 1 shingles in any common order; in this one, passages that many
   documents repeat come last and bring few classes together.
2. The classes with a common leading shingle are a block; blocks with the same members are one.
   Every member is checked against the one that meets most others; linked classes are united.
3. Blocks that are united need nothing more. In the others, every class is a point: its shingles
   counted in `DIMENSIONS` groups. An R-tree holds the points; the sum of the smaller coordinates
   of two boxes bounds the overlap below them, so most pairs are never looked at. What
   survives between different components is verified on the sets.

All links that can change a component are found, and no block emits all its pairs.

Defined results: a null or empty text has no set and links with nothing; fewer words than a shingle
count as one shingle; repeated rows have equal sets and so one component; a null id does not count
as smallest unless a component has no other; an empty table gives an empty result. Other columns
are not read by `groups` and pass through `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import pieces, prepare, text_of
from foliary.llm.components import components
from foliary.session import discard, materialize, rows_within

WORDS = 5
PERCENT = 75
#: Groups of the corpus-wide count, as a power of two.
GROUP_BITS = 14
#: Coordinates of a point, and of the folded points in a tree (a divisor of the former); points of
#: a leaf, points of a block that one task joins.
DIMENSIONS, FOLDED = 2048, 512
LEAF = 16
BLOCK = 4096
#: Words and classes that a worker remembers; bytes of sets that it does; rows up to which a side is broadcast.
KNOWN = 400_000
KNOWN_BYTES = 32 << 20
SMALL_ROWS = 500_000

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
    np.uint64,
)


class Hashes(dict):
    """The 64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes, known: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; none without words.

    Words are separated by ASCII white space; A-Z count as lower case.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out += (hashes[i : len(hashes) - size + 1 + i] + np.uint64(i)) * _ODD[i]
    out ^= out >> np.uint64(31)
    out *= _ODD[0]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def class_of(found: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(found.tobytes()))))


def prefix_length(size: int) -> int:
    """How many leading shingles are enough to meet every similar set."""
    return size + (-PERCENT * size) // 100 + 1


def needed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least overlap that links sets of these sizes."""
    return -((-PERCENT * (left + right)) // (100 + PERCENT))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class and size of every document; at the end, the task's group counts."""
    known, counts = Hashes(), np.zeros(1 << GROUP_BITS, np.int64)
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("text_key", pa.int64()), ("class", pa.int64()), ("n", pa.int64()),
            ("point", pa.binary()), ("groups", pa.list_(pa.int64())),
        ]
    )

    def rows(ids, keys, classes, sizes, points, groups):
        own = [pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(points, pa.binary())]
        return pa.RecordBatch.from_arrays([ids, keys, *own, groups], schema=schema)

    for batch in pieces(batches):
        classes, sizes, points = [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text, known)
            counts += np.bincount((found >> np.uint64(64 - GROUP_BITS)).astype(np.int64), minlength=len(counts))
            classes.append(class_of(found) if len(found) else None)
            sizes.append(len(found))
            points.append(point(found))
        none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
        yield rows(batch.column("doc_id"), batch.column("text_key"), classes, sizes, points, none)
    one = pa.nulls(1, pa.int64())
    yield rows(one, one, [None], [-1], [None], pa.array([counts.tolist()], pa.list_(pa.int64())))


def _leading(batches: Iterator[pa.RecordBatch], counts) -> Iterator[pa.RecordBatch]:
    """The leading shingles of every class, once for each class a worker remembers."""
    known, seen, total = Hashes(), set(), counts.value
    for batch in pieces(batches):
        tokens, classes = [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text, known)
            if not len(found):
                continue
            name = class_of(found)
            if name in seen:
                continue
            if len(seen) >= KNOWN:
                seen.clear()
            seen.add(name)
            group = (found >> np.uint64(64 - GROUP_BITS)).astype(np.int64)
            order = np.lexsort((found, total[group]))[: prefix_length(len(found))]
            tokens.append(found[order].view(np.int64))
            classes.append(np.full(len(order), name, np.int64))
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(classes))], names=["token", "class"]
            )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by token and class, whose token has more than one class; each once.

    Only one row is held back, so a token may have any number of rows.
    """
    last_token, last_class, last_joined = np.empty(0, np.int64), np.empty(0, np.int64), False
    for batch in batches:
        if not batch.num_rows:
            continue
        token = np.concatenate([last_token, batch.column("token").to_numpy()])
        name = np.concatenate([last_class, batch.column("class").to_numpy()])
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
        token, name = token[new], name[new]
        joined = np.zeros(len(token), bool)
        joined[1:] = token[1:] == token[:-1]
        joined[0] = last_joined
        keep = joined[:-1] | joined[1:]
        last_token, last_class, last_joined = token[-1:], name[-1:], bool(joined[-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[:-1][keep]), pa.array(name[:-1][keep])], names=["token", "class"]
            )
    if last_joined:
        yield pa.RecordBatch.from_arrays([pa.array(last_token), pa.array(last_class)], names=["token", "class"])


def _stands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the documents that stand for a class; hashes of their sets would compress no further."""
    known = Hashes()
    for batch in pieces(batches):
        names, texts = [], []
        for name, text in zip(batch.column("class").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = shingles(text, known)
            if len(found) and class_of(found) == name:
                names.append(name)
                texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(texts, pa.binary())], names=["class", "text"]
        )


class Sets(dict):
    """The sets of the last classes that a worker met."""

    def __init__(self):
        super().__init__()
        self.known, self.held = Hashes(), 0

    def of(self, name: int, text: bytes) -> np.ndarray:
        found = self.get(name)
        if found is None:
            found = shingles(text, self.known)
            if self.held + found.nbytes > KNOWN_BYTES:
                self.clear()
                self.held = 0
            self.held += found.nbytes
            self[name] = found
        return found


def point(found: np.ndarray) -> bytes:
    """The set's shingles counted in groups, two bits for each; `coordinates` adds what these can't hold."""
    counts = np.bincount((found % np.uint64(DIMENSIONS)).astype(np.int64), minlength=DIMENSIONS)
    held = np.minimum(counts, 3).astype(np.uint8).reshape(4, -1)
    return (held[0] | held[1] << 2 | held[2] << 4 | held[3] << 6).tobytes()


def coordinates(points: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Points as rows; the last coordinate is the part of the size that the two bits do not hold.

    Summed minima of two such rows are never less than the overlap.
    """
    packed = np.frombuffer(b"".join(points), np.uint8).reshape(len(points), -1)
    held = np.concatenate([packed >> shift & 3 for shift in (0, 2, 4, 6)], axis=1).astype(np.int32)
    return np.concatenate([held, (sizes - held.sum(axis=1)).astype(np.int32)[:, None]], axis=1)


def folded(points: np.ndarray) -> np.ndarray:
    """Fewer coordinates, each the sum of several: a weaker bound that is quicker to compare."""
    parts = points[:, :-1].reshape(len(points), -1, FOLDED).sum(axis=1)
    return np.concatenate([parts, points[:, -1:]], axis=1)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose points allow an overlap that is large enough."""
    for batch in batches:
        n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        a = coordinates(batch.column("point_a").to_pylist(), n_a)
        b = coordinates(batch.column("point_b").to_pylist(), n_b)
        good = np.minimum(a, b).sum(axis=1) >= needed(n_a, n_b)
        yield batch.select(["a", "b"]).filter(pa.array(good))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar."""
    sets = Sets()
    for batch in pieces(batches):
        keep = []
        for a, b, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
            both = np.concatenate([sets.of(a, text_a), sets.of(b, text_b)])
            size = len(both)
            both.sort(kind="stable")
            overlap = int((both[1:] == both[:-1]).sum())
            keep.append(100 * overlap >= PERCENT * (size - overlap))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Tree:
    """An R-tree over points, packed by halving the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, roots: np.ndarray, rows: np.ndarray):
        self.rows = rows
        self.high = points[rows].max(axis=0)
        self.least = int(sizes[rows].min())
        own = roots[rows]
        self.root = own[0] if (own == own[0]).all() else None
        self.parts: list[Tree] = []
        if len(rows) > LEAF:
            # The size is a coordinate as well: it spreads most where sizes differ.
            spread = np.ptp(points[rows], axis=0)
            widest = sizes[rows] if np.ptp(sizes[rows]) > 4 * spread.max() else points[rows, spread.argmax()]
            order = rows[np.argsort(widest, kind="stable")]
            middle = len(order) // 2
            self.parts = [Tree(points, sizes, roots, order[:middle]), Tree(points, sizes, roots, order[middle:])]


def tree_join(
    points: np.ndarray, sizes: np.ndarray, roots: np.ndarray, left: np.ndarray, right: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different roots, one of each side, that the bound can't rule out."""
    if not len(left) or not len(right):
        return
    one = Tree(points, sizes, roots, left)
    stack = [(one, one if left is right else Tree(points, sizes, roots, right))]
    while stack:
        a, b = stack.pop()
        if a.root is not None and a.root == b.root:
            continue
        if np.minimum(a.high, b.high).sum() < needed(a.least, b.least):
            continue
        if a.parts or b.parts:
            if a is b:
                first, second = a.parts
                stack += [(first, first), (first, second), (second, second)]
            elif not b.parts or a.parts and len(a.rows) >= len(b.rows):
                stack += [(part, b) for part in a.parts]
            else:
                stack += [(a, part) for part in b.parts]
            continue
        overlap = np.minimum(points[a.rows][:, None, :], points[b.rows][None, :, :]).sum(axis=2)
        good = overlap >= needed(sizes[a.rows][:, None], sizes[b.rows][None, :])
        good &= roots[a.rows][:, None] != roots[b.rows][None, :]
        if a is b:
            good = np.triu(good, 1)
        i, j = np.nonzero(good)
        if len(i):
            yield a.rows[i], b.rows[j]


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join every block, its rows sorted by block; a block has 2 * BLOCK rows or so at most."""
    held: list[pa.RecordBatch] = []
    key = None

    def joined() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        names, sizes, roots, side = (rows.column(c).to_numpy() for c in ("class", "n", "root", "side"))
        points = coordinates(rows.column("point").to_pylist(), sizes)
        small = folded(points)
        left, right = np.nonzero(side != 1)[0], np.nonzero(side != 0)[0]
        for i, j in tree_join(small, sizes, roots, left, left if (side == 2).all() else right):
            good = np.minimum(points[i], points[j]).sum(axis=1) >= needed(sizes[i], sizes[j])
            i, j = i[good], j[good]
            a, b = np.minimum(names[i], names[j]), np.maximum(names[i], names[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        keys = np.array(batch.column("block").to_pylist(), object)
        cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1), len(keys)] if len(keys) else []
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if keys[start] != key:
                if held:
                    yield from joined()
                held, key = [], keys[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield from joined()


def _linked(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are similar, of those whose points allow it."""

    def side(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.select(F.col("class").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    placed = pairs.join(side(classes, "a", "n", "point"), "a").join(side(classes, "b", "n", "point"), "b")
    sized = placed.filter("n_a * 100 >= n_b * {0} AND n_b * 100 >= n_a * {0}".format(PERCENT))
    close = materialize(sized.mapInArrow(_bounded, "a long, b long"), "close")

    wanted = close.select(F.col("a").alias("class")).unionByName(close.select(F.col("b").alias("class")))
    stands = materialize(classes.join(wanted.distinct(), "class").select("class", "doc_id"), "stands")
    few = _checked(stands)
    chosen = texts.join(few, texts["doc_id"].eqNullSafe(few["doc_id"])).select("class", "text")
    chosen = materialize(chosen.mapInArrow(_stands, "class long, text binary"), "chosen")
    one = chosen
    if not chosen.groupBy("class").count().filter("count > 1").isEmpty():
        one = chosen.dropDuplicates(["class"])
    both = close.join(side(one, "a", "text"), "a").join(side(one, "b", "text"), "b")
    links = materialize(both.mapInArrow(_verify, "a long, b long"), "links")
    discard(close, stands, chosen)
    return links


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if rows_within(df, SMALL_ROWS) else df


def _profiled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' binary texts, and the table of their classes."""
    prepare(docs.sparkSession)
    texts = docs.select(
        F.col("doc_id").cast("long"),
        F.xxhash64("text").alias("text_key"),
        text_of("text").cast("binary").alias("text"),
    )
    profile = texts.mapInArrow(
        _profile, "doc_id long, text_key long, class long, n long, point binary, groups array<long>"
    )
    return texts, materialize(profile, "profile")


def _united(texts: DataFrame, profile: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, root) for the classes that are linked with another one."""
    spark = texts.sparkSession
    counts = np.zeros(1 << GROUP_BITS, np.int64)
    sums = profile.filter("groups IS NOT NULL").select(F.posexplode("groups").alias("group", "n"))
    for row in sums.groupBy("group").agg(F.sum("n").alias("n")).collect():  # 2 ** GROUP_BITS rows
        counts[row["group"]] = row["n"]
    total = spark.sparkContext.broadcast(counts)

    leading = texts.select("text").mapInArrow(partial(_leading, counts=total), "token long, class long")
    shared = (
        leading.repartition("token").sortWithinPartitions("token", "class").mapInArrow(_shared, "token long, class long")
    )
    shared = materialize(shared, "shared")
    members = F.bit_xor(F.xxhash64("class")).alias("members")
    lists = shared.groupBy("token").agg(F.count(F.lit(1)).alias("size"), members, F.min("class").alias("low"))
    lists = lists.groupBy("size", "members", "low").agg(F.min("token").alias("token"))
    members_of = materialize(shared.join(lists.select("token", "size"), "token"), "members")
    # The member that meets most others stands in the middle of its block: of an original and its
    # edited copies, the original.
    met = members_of.groupBy("class").agg(F.sum("size").alias("met"))
    middle = F.max(F.struct("met", "class"))["class"].alias("first")
    firsts = members_of.join(met, "class").groupBy("token").agg(middle)
    blocks = materialize(members_of.join(firsts, "token"), "blocks")
    discard(shared, members_of)

    stars = blocks.filter("class <> first").select(F.col("first").alias("a"), F.col("class").alias("b"))
    links = _linked(stars.distinct(), classes, texts)
    roots = materialize(components(links), "roots")
    discard(links)

    placed = blocks.join(roots.withColumnRenamed("node", "class"), "class", "left")
    placed = placed.withColumn("root", F.coalesce("root", "class"))
    open_blocks = placed.groupBy("token").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("rows")
    )
    open_blocks = open_blocks.filter("low <> high").select("token", "rows")
    # A large block is cut into parts, and every two parts are joined by one task.
    parts = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    cut = (
        placed.select("token", "class", "root")
        .join(open_blocks, "token")
        .withColumn("own", own)
        .withColumn("other", other)
        .join(classes.select("class", "n", "point"), "class")
    )
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    block = F.concat_ws(":", "token", F.least("own", "other"), F.greatest("own", "other"))
    cut = cut.select(block.alias("block"), side.cast("int").alias("side"), "class", "n", "root", "point")
    pairs = cut.repartition("block").sortWithinPartitions("block").mapInArrow(_join_blocks, "a long, b long")
    pairs = materialize(pairs.distinct(), "pairs")
    discard(blocks)
    more = _linked(pairs, classes, texts)
    discard(pairs)
    known = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = components(known.unionByName(more)).withColumnRenamed("node", "class")
    discard(roots, more)
    return found


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, root, component_id) of every document.

    `root` names a component and is null for documents without a set.
    """
    texts, profile = _profiled(docs)
    rows = materialize(profile.filter("n >= 0").select("doc_id", "text_key", "class", "n"), "rows")
    classes = profile.filter("class IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("point").alias("point")
    )
    classes = materialize(classes, "classes")
    roots = _united(texts, profile, classes)
    rooted = classes.select("class", F.col("doc_id").alias("least")).join(roots, "class", "left")
    rooted = materialize(rooted.withColumn("root", F.coalesce("root", "class")), "roots")
    discard(profile, classes)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("class", "root").join(least, "root")
    return rows.join(named, "class", "left").select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        "root",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def report(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that are linked with an earlier one.

    Of each component the document with the smallest id stays (of equal ids, that with the smaller
    hash of its text). Documents without a set stay.
    """
    found = materialize(groups(docs), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    winners = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("first"))
    winners = winners.select("first.doc_id", "first.text_key")
    empty = found.filter("root IS NULL").select("doc_id", "text_key").distinct()
    stays = _checked(materialize(winners.unionByName(empty), "stays"))
    same = docs["doc_id"].eqNullSafe(stays["doc_id"])
    kept = docs.join(stays, same & (F.xxhash64(docs["text"]) == stays["text_key"]), "left_semi")
    repeated = found.filter("root IS NOT NULL").groupBy("doc_id", "text_key").count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    full = text_of("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.filter(full).dropDuplicates(["doc_id", "text"]).unionByName(kept.filter(~full))
