"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a score for a key; the best score owns it. The score of a shard depends on the
key, the shard's number and its weight alone, so one more shard takes rows only into itself, and
the share it takes is its share of the weights. No shuffle is needed to place rows.

`number_slots` then counts the rows of a shard from 0 without gaps. Rows are spread over a fixed
number of buckets in each shard; equal rows are counted before they are shuffled, so neither a hot
key nor many equal rows end in one task.

Defined results: a null key is a key like any other (all such rows share a shard); a null text has
size 1 and the checksum of an empty text; repeated rows share a shard and take neighbouring slots;
an empty table gives an empty result; other columns pass through `place`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.llm.common import text_of
from foliary.session import materialize

#: Buckets in which the rows of a shard are counted, and copies of a row written by one step.
BUCKETS = 4096
CHUNK = 10_000


def owner(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """The number of the shard that owns a key: the smallest of -ln(u) / weight wins."""
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11)
            score = -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))
            draws.append(F.struct(score.alias("score"), F.lit(shard).alias("shard")))
    if not draws:
        raise ValueError("at least one shard needs a weight above 0")
    return F.array_min(F.array(*draws))["shard"]


def place(df: DataFrame, keys: Sequence[str], weights: Sequence[float], out: str) -> DataFrame:
    """Add the column `out`: the shard of every row."""
    return df.withColumn(out, owner([F.col(k) for k in keys], weights))


def number_slots(rows: DataFrame, shard: str, out: str) -> DataFrame:
    """Add the column `out`: a number from 0, without gaps, for the rows of each shard.

    `rows` holds small columns only. The order within a shard is by a hash of the row, then by the
    row itself, so it does not depend on how the input is partitioned.
    """
    columns = rows.columns
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(BUCKETS))
    counted = materialize(
        rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", bucket),
        "slots",
    )
    within = W.partitionBy(shard, "_bucket")
    order = within.orderBy(*[F.col(c) for c in columns])
    earlier = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # At most BUCKETS rows for each shard.
    starts = (
        counted.groupBy(shard, "_bucket")
        .agg(F.sum("_n").alias("_rows"))
        .select(shard, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    first = F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    numbered = counted.withColumn("_first", first).join(F.broadcast(starts), [shard, "_bucket"])
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK)))
    last = F.least(F.col("_n"), (F.col("_chunk") + 1) * CHUNK) - 1
    copy = F.explode(F.sequence(F.col("_chunk") * CHUNK, last))
    return (
        numbered.withColumn("_chunk", chunk)
        .withColumn("_copy", copy)
        .select(*columns, (F.col("_start") + F.col("_first") + F.col("_copy")).alias(out))
    )


def shard_documents(docs: DataFrame, weights: Sequence[float], added: float) -> DataFrame:
    """Shard and slot of every document, and its shard when one of weight `added` joins."""
    text = text_of("text")
    key = [F.col("doc_id")]
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        owner(key, weights).alias("shard"),
        owner(key, [*weights, added]).alias("grown_shard"),
    )
    return number_slots(rows, "shard", "slot")
