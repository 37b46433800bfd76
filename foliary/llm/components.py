"""Connected components of a large graph, as joins and aggregations.

Every round points each node's larger neighbours at its smallest one (large star), then does the
same among the smaller ones (small star). The rounds end when nothing changes. A node's smallest
neighbour is found before the shuffle, and adaptive execution cuts the edges of a node with many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.session import discard, materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over directed edges (node, other)."""
    lowest = edges.groupBy("node").agg(F.min("other").alias("low"))
    lowest = lowest.withColumn("low", F.least("low", "node"))
    joined = edges.join(lowest, "node")
    if not small:
        return joined.filter("other > node").select(F.col("other").alias("node"), F.col("low").alias("other"))
    down = joined.filter("other <> low").select(F.col("other").alias("node"), F.col("low").alias("other"))
    own = lowest.filter("node <> low").select("node", F.col("low").alias("other"))
    return down.unionByName(own)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node that it reaches.

    Loops and repeated edges do no harm; an empty table of edges gives an empty result.
    """
    high, low = F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")
    found = materialize(edges.filter("a <> b").select(high, low).distinct(), "edges")
    state = None
    while True:
        mark = found.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "other"))).first()
        if mark == state:
            break
        state = mark
        both = found.unionByName(found.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _star(both, small=False).distinct()
        before, found = found, materialize(_star(large, small=True).distinct(), "edges")
        discard(before)
    roots = found.select(F.col("other").alias("node")).distinct()
    return found.select("node", F.col("other").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
