"""Secret scans weighed by corpus-wide ownership.

Every text is scanned for candidates: assigned secrets, access keys, long hex strings, and bare
strings that look random. The hashes of the candidates are counted over the whole corpus by distinct
repositories and distinct owners; copies of one text count once, under the smallest of their owners,
since a mirror is no second holder. A value that several owners hold, or one owner in many
repositories, is an example that was copied around; any other looks live. A bare string becomes a
finding only if it looks live; the others are findings anyway and carry the verdict.

Defined results: a null or empty text has no findings; of overlapping candidates of different kinds
all but the bare ones stay; a null owner or repository is one more owner or repository; repeated
rows count as one repository and repeat their result; an empty table gives an empty result. Other
columns are not read. Texts with many findings take time in proportion.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import pieces, prepare, strings
from foliary.session import hot_key_join, materialize

# The patterns of the base findings and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "bare")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-])")
#: Bits for each character that a bare string needs.
LEAST_BITS = 3.8
#: Owners, or repositories of one owner, from which on a value is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 2, 20
#: Findings of one value that a task joins.
VALUES_PER_TASK = 200_000


def looks_random(value: str) -> bool:
    """Capitals, small letters and digits, mixed with a high entropy."""
    if not (re.search("[A-Z]", value) and re.search("[a-z]", value) and re.search("[0-9]", value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= LEAST_BITS


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) in order of start, then kind; offsets are code points."""
    found = []
    lower = text.lower()
    if any(word in lower for word in WORDS):
        found += [
            (0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED
        ]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for m in BARE.finditer(text):
        # Of the findings that start before its end, does the last to end reach into it?
        before = bisect_left(starts, m.end())
        if (not before or ends[before - 1] <= m.start()) and looks_random(m[0]):
            found.append((3, m.start(), m.end(), m[0]))
    return sorted(found, key=lambda x: (x[1], x[0]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    kind = pa.list_(
        pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.int64())])
    )
    for batch in pieces(batches):
        spans = [
            [
                {"kind": k, "start": s, "stop": e, "value": xxhash.xxh64_intdigest(v.encode()) >> 1}
                for k, s, e, v in candidates(text)
            ]
            for text in strings(batch, "text")
        ]
        rows = pa.array(range(row, row + batch.num_rows), pa.int64())
        row += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [rows, *[batch.column(c) for c in ("doc_id", "owner", "repository", "copy")], pa.array(spans, kind)],
            names=["row", "doc_id", "owner", "repository", "copy", "spans"],
        )


def ownership(found: DataFrame) -> DataFrame:
    """Per value: its distinct repositories and owners over the whole corpus, copies of a text once."""
    texts = found.groupBy("value", "copy").agg(F.min(F.struct("owner", "repository")).alias("first"))
    each = texts.groupBy("value", "first.owner", "first.repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("value").agg(
        F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners")
    )


def scan(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """Per row: doc_id and findings, an array of (start, kind, stop, live, owners, repositories) in that order."""
    prepare(docs.sparkSession)
    texts = docs.select(
        "doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"),
        F.xxhash64("text").alias("copy"), "text",
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row long, doc_id {kind}, owner string, repository string, copy long, "
        "spans array<struct<kind: int, start: int, stop: int, value: long>>"
    )
    rows = materialize(texts.mapInArrow(_scan, schema), "candidates")
    found = rows.select("row", "owner", "repository", "copy", F.explode("spans").alias("span"))
    found = found.select("row", "owner", "repository", "copy", "span.*")
    owned = materialize(ownership(found), "ownership")
    judged = hot_key_join(
        found.drop("owner", "repository", "copy"), owned, ["value"], "row", VALUES_PER_TASK
    ).withColumn("live", (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") < EXAMPLE_REPOSITORIES))
    judged = judged.filter((F.col("kind") < KINDS.index("bare")) | F.col("live"))
    spans = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "live", "owners", "repositories"))).alias("findings")
    )
    none = "array<struct<start: int, kind: int, stop: int, live: boolean, owners: long, repositories: long>>"
    none = F.array().cast(none)
    return rows.select("row", "doc_id").join(spans, "row", "left").select(
        "doc_id", F.coalesce("findings", none).alias("findings")
    )


def report(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    found = scan(docs, owner, repository)
    names = F.array(*[F.lit(k) for k in KINDS])

    def count(test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter("findings", test)).cast("long")

    def of_kind(number: int) -> Callable[[Column], Column]:
        return lambda x: x["kind"] == number

    def spelled(spans: Column) -> Column:
        one = F.transform(
            spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))
        )
        return F.array_join(one, ",")

    base = F.filter("findings", lambda x: x["kind"] < KINDS.index("bare"))
    return found.select(
        "doc_id",
        *[count(of_kind(i)).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("findings")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        # The widest spread of any of the values.
        F.array_max(F.transform("findings", lambda x: x["owners"])).alias("most_owners"),
        F.array_max(F.transform("findings", lambda x: x["repositories"])).alias("most_repositories"),
    )
