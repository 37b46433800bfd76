"""A Merkle manifest of a table: one digest for every row, group and the whole.

Rows are leaves, ordered inside their group. Every `fanout` neighbours of a level become the hash of
their digests, until one is left: the group's root. The roots of the groups, in order of the
groups, are hashed likewise to the root of all.

Inside a task a parent keeps a copy of its hash state before each child slot. To fold a changed leaf
upwards, the state before its slot is resumed with the new digest and the siblings on its right
alone; what lies on its left is never hashed again. Between tasks the states travel as the left
siblings they come from and are resumed for all leaves of a block.

Leaves are numbered after a range partitioning, cell by cell. `BLOCK` neighbours are a block, which
is one group of a shuffle; the roots of blocks are the leaves of the next round, so a task never holds
more than a block, and each round shrinks the table by that factor.

Defined results: a null column counts as `-`; a null key sorts first and its row is never tampered
with; repeated rows, and rows that share a key, are leaves of their own, ordered by key, then
by digest; a null group is a group and comes first; an empty table gives an empty result. Only
the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.llm.common import prepare
from foliary.session import materialize, rows_within

#: Leaves of a block, rows of a cell of the range partitioning, and groups that are broadcast.
BLOCK = 1024
CELL_ROWS = 1_000_000
SMALL_GROUPS = 20_000

#: Levels of a tree from the leaves up, and for each parent its states before every child slot.
Levels = list[list[bytes]]
States = list[list[list]]


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values of a row: `-` for null, else the UTF-8 byte count, `:` and the value."""
    parts = []
    for value in values:
        text = value.cast("string")
        shown = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(shown))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def grow(leaves: list[bytes], fanout: int, height: int) -> tuple[Levels, States]:
    """`height` levels over the digests (as hexadecimal text), with the states of every parent."""
    levels, states = [leaves], []
    for _ in range(height):
        above, kept = [], []
        for start in range(0, len(levels[-1]), fanout):
            state, slots = hashlib.sha256(), []
            for child in levels[-1][start : start + fanout]:
                slots.append(state.copy())
                state.update(child)
            above.append(state.hexdigest().encode())
            kept.append(slots)
        levels.append(above)
        states.append(kept)
    return levels, states


def resume(state, digest: bytes, right: bytes) -> bytes:
    """The parent of a replaced child, from the state before its slot."""
    state = state.copy()
    state.update(digest)
    state.update(right)
    return state.hexdigest().encode()


def siblings(levels: Levels, at: int, fanout: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of a leaf's ancestor on every level."""
    out = []
    for level in levels[:-1]:
        start = at - at % fanout
        out.append((b"".join(level[start:at]), b"".join(level[at + 1 : start + fanout])))
        at //= fanout
    return out


def _height(fanout: int) -> int:
    """Levels of a whole block."""
    return max(1, int(math.log(BLOCK, fanout) + 1e-9))


def _levels_of(block: int, rows: int, fanout: int, high: int) -> int:
    """A first block that is not full is alone in its group and only as high as it needs to be."""
    if block > 0:
        return high
    height = 0
    while fanout**height < rows:
        height += 1
    return height


def _hex(column: pa.ChunkedArray) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def _root(rows: pa.Table, fanout: int, high: int) -> pa.Table:
    """The root of one block."""
    rows = rows.sort_by("pos")
    block = rows["block"][0].as_py()
    levels, _ = grow(_hex(rows["digest"]), fanout, _levels_of(block, rows.num_rows, fanout, high))
    digest = pa.array([bytes.fromhex(levels[-1][0].decode())], pa.binary())
    return pa.table({"group": rows["group"].slice(0, 1), "pos": pa.array([block], pa.int64()), "digest": digest})


def _extend(rows: pa.Table, above: pa.Table, fanout: int, high: int) -> pa.Table:
    """The paths of a block's nodes: the siblings inside it, then the path of its root."""
    if not rows.num_rows:
        return pa.table({"group": rows["group"], "pos": rows["pos"], "lefts": [], "rights": [], "root": []})
    rows = rows.sort_by("pos")
    nodes = _hex(rows["digest"])
    levels, _ = grow(nodes, fanout, _levels_of(rows["block"][0].as_py(), len(nodes), fanout, high))
    own = [siblings(levels, at, fanout) for at in range(len(nodes))]
    lefts, rights = above["lefts"][0].as_py(), above["rights"][0].as_py()
    return pa.table(
        {
            "group": rows["group"],
            "pos": rows["pos"],
            "lefts": pa.array([[left.decode() for left, _ in path] + lefts for path in own], pa.list_(pa.string())),
            "rights": pa.array([[right.decode() for _, right in path] + rights for path in own], pa.list_(pa.string())),
            "root": pa.array(above["root"].to_pylist() * len(nodes), pa.binary()),
        }
    )


def _prove(rows: pa.Table, above: pa.Table, fanout: int, high: int) -> pa.Table:
    """Proof and folded root of every leaf of a block."""
    rows = rows.sort_by("pos")
    leaves = _hex(rows["digest"])
    changed = rows["changed"].to_pylist()
    levels, states = grow(leaves, fanout, _levels_of(rows["block"][0].as_py(), len(leaves), fanout, high))
    path = list(zip(above["lefts"][0].as_py(), above["rights"][0].as_py(), strict=True)) if leaves else []
    path = [(left.encode(), right.encode()) for left, right in path]
    # The states above the block, once for all of its leaves.
    resumed = [(hashlib.sha256(left), right) for left, right in path]
    upper = b"".join(left + right for left, right in path)
    proofs, folded = [], []
    for at, digest in enumerate(leaves):
        own = siblings(levels, at, fanout)
        proofs.append(hashlib.sha256(b"".join(left + right for left, right in own) + upper).hexdigest())
        if changed[at] is not None:
            digest = changed[at].hex().encode()
        node = at
        for (_, right), kept in zip(own, states, strict=True):
            node, slot = divmod(node, fanout)
            digest = resume(kept[node][slot], digest, right)
        for state, right in resumed:
            digest = resume(state, digest, right)
        folded.append(digest.decode())
    out = {c: rows[c] for c in ("group", "key")} | {"leaf": pa.array([x.decode() for x in leaves], pa.string())}
    return pa.table(
        out
        | {
            "subroot": pa.array([x.hex() for x in above["root"].to_pylist()] * len(leaves), pa.string()),
            "root": pa.array([x.hex() for x in above["top"].to_pylist()] * len(leaves), pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
        }
    )


def number(rows: DataFrame, group: str, order: Sequence[str], out: str) -> DataFrame:
    """Add `out`: the place of every row in its group, from 0, by the columns of `order`.

    Rows are cut by ranges into cells of bounded size, which are numbered one by one. A group that
    goes on from an earlier cell starts at the rows it has there; every cell has one such group
    at most. The place in the written input splits rows that are equal in all columns.
    """
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "rows")
    shuffled = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = max(shuffled, math.ceil(rows.count() / CELL_ROWS))
    keys = [F.col(c).asc_nulls_first() for c in (*order, "_at")]
    cut = rows.repartitionByRange(cells, F.col(group).asc_nulls_first(), *keys)
    cut = materialize(cut.withColumn("_cell", F.spark_partition_id()), "cells")
    earlier = W.partitionBy(group).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    begun = cut.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    # One row for a cell at most.
    begun = begun.withColumn("_start", F.sum("_n").over(earlier)).filter("_start > 0")
    begun = begun.select(F.col(group).alias("_group"), F.col("_cell").alias("_begun"), "_start")
    inside = F.row_number().over(W.partitionBy("_cell", group).orderBy(*keys)) - 1
    same = (F.col("_cell") == F.col("_begun")) & F.col(group).eqNullSafe(F.col("_group"))
    numbered = cut.withColumn("_inside", inside).join(F.broadcast(begun), same, "left")
    place = F.coalesce("_start", F.lit(0)) + F.col("_inside")
    return numbered.withColumn(out, place.cast("long")).drop("_at", "_cell", "_inside", "_group", "_begun", "_start")


def _cut(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes with the block they belong to."""
    return nodes.withColumn("block", F.floor(F.col("pos") / fanout ** _height(fanout)).cast("long"))


def _kinds(nodes: DataFrame) -> str:
    return f"group {nodes.schema['group'].dataType.simpleString()}"


def _climb(nodes: DataFrame, fanout: int) -> DataFrame:
    """(group, pos, digest) of the blocks of nodes."""
    blocks, high = _cut(nodes, fanout).groupBy("group", "block"), _height(fanout)
    return blocks.applyInArrow(lambda rows: _root(rows, fanout, high), f"{_kinds(nodes)}, pos long, digest binary")


def paths(nodes: DataFrame, fanout: int) -> DataFrame:
    """(group, pos, lefts, rights, root): the siblings of every node on its way to the group's root.

    A round for every factor of BLOCK in the size of the largest group.
    """
    nodes = materialize(nodes.select("group", "pos", "digest"), "nodes")
    if not nodes.agg(F.max("pos")).first()[0]:
        none = F.array().cast("array<string>")
        return nodes.select("group", "pos", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("root"))
    above = paths(_climb(nodes, fanout), fanout).withColumnRenamed("pos", "block")
    schema = f"{_kinds(nodes)}, pos long, lefts array<string>, rights array<string>, root binary"
    high = _height(fanout)
    met = _cut(nodes, fanout).groupBy("group", "block").cogroup(above.groupBy("group", "block"))
    return materialize(met.applyInArrow(lambda rows, above: _extend(rows, above, fanout, high), schema), "paths")


def manifest(leaves: DataFrame, fanout: int = 2) -> DataFrame:
    """Proofs of the rows (group, key, digest, changed) of a table.

    Returns group, key, leaf, subroot (root of the group), root, proof_sha256 (hash of all siblings
    from the leaf to the root) and folded_root: what the root becomes with `changed` in the place of
    the leaf, or with the leaf itself where `changed` is null. Digests are hexadecimal text.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    prepare(leaves.sparkSession)
    leaves = leaves.select("group", "key", "digest", "changed")
    numbered = materialize(number(leaves, "group", ["key", "digest"], "pos"), "numbered")
    blocks = paths(_climb(numbered, fanout), fanout)

    # The groups' roots are the leaves of one more tree.
    roots = blocks.filter("pos = 0").select(F.col("group").alias("name"), F.col("root").alias("digest"))
    roots = materialize(number(roots.withColumn("group", F.lit(0)), "group", ["name"], "pos"), "roots")
    tops = paths(roots, fanout).select(
        "pos", F.col("lefts").alias("top_lefts"), F.col("rights").alias("top_rights"), F.col("root").alias("top")
    )
    tops = roots.select("pos", "name").join(tops, "pos").drop("pos")
    if rows_within(roots, SMALL_GROUPS):
        tops = F.broadcast(tops)
    blocks = blocks.join(tops, F.col("group").eqNullSafe(F.col("name"))).select(
        "group",
        F.col("pos").alias("block"),
        F.concat("lefts", "top_lefts").alias("lefts"),
        F.concat("rights", "top_rights").alias("rights"),
        "root",
        "top",
    )
    met = _cut(numbered, fanout).groupBy("group", "block").cogroup(blocks.groupBy("group", "block"))
    high = _height(fanout)
    key = numbered.schema["key"].dataType.simpleString()
    schema = f"{_kinds(numbered)}, key {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return met.applyInArrow(lambda rows, above: _prove(rows, above, fanout, high), schema)


def report(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language; every seventh, by checksum, is tampered with."""
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    longer = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = [longer if i == 3 else c for i, c in enumerate(named)]
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select(
        F.col("lang").alias("group"),
        F.col("doc_id").alias("key"),
        leaf_digest(named).alias("digest"),
        F.when(drawn, leaf_digest(changed)).alias("changed"),
    )
    return manifest(leaves).select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
