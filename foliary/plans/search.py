"""The index as written tables, and the search over it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foliary.operators.analyze import average_lengths, by_field, by_term, field_stats, row_stats, term_rows, term_stats
from foliary.operators.highlight import highlights
from foliary.operators.search import (
    best_fields,
    check_page,
    field_scores,
    query_terms,
    result_page,
    totals,
    weigh_terms,
)
from foliary.operators.topk import top_scores
from foliary.schemas import CORPUS_COLUMNS
from foliary.session import layout, materialize, rows_within, text_bytes, unsorted_writes
from foliary.settings import DEFAULTS, Settings
from foliary.sources.tables import current, numbers, publish


@dataclass(frozen=True)
class Index:
    """Written tables of one corpus, and the dictionary it was analysed with."""

    corpus: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    fields: DataFrame
    digits: int
    lemmas: DataFrame | None = None


def _shard(digits: int) -> Column:
    """The corpus folder of a hash; the letter keeps all-digit names text."""
    return F.concat(F.lit("h"), F.substring("sha256", 1, digits))


def write_index(
    corpus: DataFrame,
    path: str,
    lemmas: DataFrame | None = None,
    settings: Settings = DEFAULTS,
) -> Index:
    """Analyse a corpus, one row per hash, and write its index below `path`.

    Postings are laid out by term bucket, one row for a term of a document in all its fields, so a
    search reads the buckets of its terms only; a bucket is cut by document hash, so a term in a
    third of all documents is written by many tasks. Corpus rows are laid out by the first digits
    of the hash, so a page of hits reads few folders. Both widths follow the size of the input.
    """
    spark = corpus.sparkSession
    if numbers(spark, path, "segment-", "fields/_SUCCESS"):
        raise ValueError(f"{path} holds an index; extend it, or rebuild it elsewhere")
    total = text_bytes(corpus, "content")
    target = settings.target_partition_bytes
    buckets = layout(total, target, 8)
    digits = len(f"{layout(total, target, 2) - 1:x}")
    if lemmas is not None:
        lemmas.select("surface", "lemma").write.mode("overwrite").parquet(f"{path}/lemmas")
    widths = spark.createDataFrame(
        [(buckets, digits, lemmas is not None)], "buckets int, digits int, lemmas boolean"
    )
    widths.write.mode("overwrite").parquet(f"{path}/layout")
    _write_segment(corpus, path, settings, total)
    return open_index(spark, path)


def extend_index(corpus: DataFrame, path: str, settings: Settings = DEFAULTS) -> Index:
    """Upsert corpus rows, one per hash, into an index.

    What is written never changes: new documents, and known ones under a new name or place,
    become a segment of their own that hides the earlier rows of its hashes. Rows that are in
    the index as they are cost nothing. Rebuild the index when segments have become many.
    """
    spark = corpus.sparkSession
    known = open_index(spark, path).corpus.select(*CORPUS_COLUMNS)
    shown = ["filename", "s3_bucket", "s3_key"]
    recorded = known.select("sha256", F.struct(*shown).alias("_shown"))
    rows = corpus.select(*CORPUS_COLUMNS).join(recorded, "sha256", "left")
    new = rows.filter(F.col("_shown").isNull() | ~F.struct(*shown).eqNullSafe(F.col("_shown")))
    new = materialize(new, "new-documents")
    if not new.isEmpty():
        moved = new.filter("_shown IS NOT NULL").select("sha256")
        old = materialize(known.join(moved, "sha256", "left_semi"), "old-documents")
        _write_segment(new, path, settings, text_bytes(new, "content"), old)
    return open_index(spark, path)


def _posts(corpus: DataFrame, buckets: int, lemmas: DataFrame | None, settings: Settings) -> DataFrame:
    """Packed term rows; hashes as 32 bytes rather than 64 digits, half the bytes."""
    docs = corpus.withColumn("sha256", F.unhex("sha256"))
    return term_rows(docs, lemmas, settings, positions=False, buckets=buckets)


def _write_segment(
    corpus: DataFrame, path: str, settings: Settings, total: int, old: DataFrame | None = None
) -> None:
    """Analyse documents into the next segment; it counts once its last table is written.

    `old` are the rows of earlier segments that it hides; their counts are taken off.
    """
    spark = corpus.sparkSession
    buckets, digits, lemmas = _layout(spark, path)
    done = numbers(spark, path, "segment-", "fields/_SUCCESS")
    folder = f"{path}/segment-{(done[-1] if done else 0) + 1:06d}"
    target = settings.target_partition_bytes
    cuts = layout(total, settings.sorted_text_bytes * buckets)
    tasks = max(layout(total, target), int(spark.conf.get("spark.sql.shuffle.partitions")))

    corpus.select(*CORPUS_COLUMNS, _shard(digits).alias("shard")).repartition(
        tasks, "shard"
    ).sortWithinPartitions("shard", "sha256").write.mode("overwrite").partitionBy(
        "shard"
    ).parquet(f"{folder}/corpus", compression="zstd")

    posts = _posts(spark.read.parquet(f"{folder}/corpus"), buckets, lemmas, settings)
    cut = F.pmod(F.xxhash64("sha256"), F.lit(cuts))
    # A task for every cut of a bucket, so none writes two of them, and its rows need no sorting. Terms are
    # unpacked once they have moved; those of a document stay together, so its hash takes next to no room.
    posts = by_term(posts.repartitionById(buckets * cuts, F.col("bucket") * cuts + cut.cast("int")))
    with unsorted_writes(spark):
        posts.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings", compression="zstd")

    written = spark.read.parquet(f"{folder}/postings")
    vocabulary = row_stats(written, average_lengths(written))
    if old is not None and not old.isEmpty():
        gone = term_stats(by_field(by_term(_posts(old, buckets, lemmas, settings))))
        less = [(-F.col(c)).alias(c) if c in _COUNTS else F.col(c) for c in gone.columns]
        vocabulary = _summed(vocabulary.unionByName(gone.select(*less), allowMissingColumns=True))
        old.select(F.unhex("sha256").alias("sha256")).write.mode("overwrite").parquet(f"{folder}/hidden")
    vocabulary.write.mode("overwrite").parquet(f"{folder}/vocabulary")
    sums = spark.read.parquet(f"{folder}/vocabulary").groupBy("field")
    sums.agg(F.sum("opens").alias("opens"), F.sum("total_tf").alias("total_tf")).write.mode(
        "overwrite"
    ).parquet(f"{folder}/fields")


_COUNTS = ("doc_freq", "total_tf", "opens")


def _summed(vocabulary: DataFrame) -> DataFrame:
    """Counts add up; the largest peak with the smallest reference bounds the shares of all segments."""
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    if "peak" in vocabulary.columns:
        sums += [F.max("peak").alias("peak"), F.min("reference").alias("reference")]
    return vocabulary.groupBy("field", "bucket", "term").agg(*sums)


def _layout(spark: SparkSession, path: str) -> tuple[int, int, DataFrame | None]:
    buckets, digits, has_lemmas = spark.read.parquet(f"{path}/layout").first()
    return buckets, digits, spark.read.parquet(f"{path}/lemmas") if has_lemmas else None


def open_index(spark: SparkSession, path: str) -> Index:
    """The index written below `path`, with all its complete segments."""
    _, digits, lemmas = _layout(spark, path)
    found = numbers(spark, path, "segment-", "fields/_SUCCESS")
    hiding = [n for n in numbers(spark, path, "segment-", "hidden/_SUCCESS") if n in found]

    def read(name: str, n: int) -> DataFrame:
        return spark.read.parquet(f"{path}/segment-{n:06d}/{name}")

    def table(name: str) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(name, n) for n in found])

    def rows(name: str, key: Callable[[Column], Column]) -> DataFrame:
        """A table of all segments without the rows that a later segment hides."""
        if not hiding:
            return table(name)
        parts = [read("hidden", n).select(F.col("sha256").alias("_hidden"), F.lit(n).alias("_by")) for n in hiding]
        hidden = reduce(DataFrame.unionByName, parts).groupBy("_hidden").agg(F.max("_by").alias("_by"))
        hidden = hidden.withColumn("_hidden", key(F.col("_hidden")))
        if rows_within(hidden, DEFAULTS.broadcast_rows):
            hidden = F.broadcast(hidden)
        every = reduce(DataFrame.unionByName, [read(name, n).withColumn("_segment", F.lit(n)) for n in found])
        gone = (F.col("sha256") == F.col("_hidden")) & (F.col("_segment") < F.col("_by"))
        return every.join(hidden, gone, "left_anti").drop("_segment")

    vocabulary = table("vocabulary")
    if len(found) > 1:
        vocabulary = _summed(vocabulary).filter("doc_freq > 0")
    return Index(
        corpus=rows("corpus", lambda h: F.lower(F.hex(h))),
        postings=by_field(rows("postings", lambda h: h)),
        vocabulary=vocabulary,
        fields=field_stats(table("fields")),
        digits=digits,
        lemmas=lemmas,
    )


def upsert_index(
    corpus: DataFrame, path: str, lemmas: DataFrame | None = None, settings: Settings = DEFAULTS
) -> Index:
    """Extend the index below `path`, or write its first segment."""
    if numbers(corpus.sparkSession, path, "segment-", "fields/_SUCCESS"):
        return extend_index(corpus, path, settings)
    return write_index(corpus, path, lemmas, settings)


def rebuild_index(
    corpus: DataFrame, root: str, lemmas: DataFrame | None = None, settings: Settings = DEFAULTS
) -> Index:
    """Write an index of its own below `root`, then let `current_index` open that one.

    Searches go on in the old one until the new one is whole; a run that dies leaves it current.
    """
    spark = corpus.sparkSession
    path = f"{root}/index-{uuid.uuid4().hex[:12]}"
    index = write_index(corpus, path, lemmas, settings)
    publish(spark.createDataFrame([(path,)], "path string"), f"{root}/pointer")
    return index


def current_index(spark: SparkSession, root: str) -> Index:
    """The index that `rebuild_index` wrote last below `root`."""
    pointer = current(spark, f"{root}/pointer", StructType([StructField("path", StringType())])).first()
    if pointer is None:
        raise ValueError(f"no index below {root}")
    return open_index(spark, pointer["path"])


def weighted_terms(queries: DataFrame, index: Index, settings: Settings = DEFAULTS) -> DataFrame:
    """The weighted vocabulary terms of every query, written once: they are query-sized."""
    terms = materialize(query_terms(queries, index.lemmas, settings), "query-terms")
    weighted = weigh_terms(terms, index.vocabulary, index.fields, settings)
    return materialize(weighted, "weighted-terms")


def _readable(rows: DataFrame) -> DataFrame:
    """Packed hashes as hexadecimal digits; both sort alike."""
    return rows.withColumn("sha256", F.lower(F.hex("sha256")))


def scoring(weighted: DataFrame, index: Index, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, sha256, field, score) of every matching document and field."""
    return _readable(field_scores(weighted, index.postings, settings))


def ranking(weighted: DataFrame, index: Index, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, sha256, score) of every matching document."""
    return _readable(best_fields(weighted, index.postings, settings))


def _page(
    weighted: DataFrame, index: Index, offset: int, size: int, settings: Settings
) -> DataFrame:
    ranked = top_scores(weighted, index.postings, offset + size, settings)
    return _readable(result_page(ranked, offset, size, settings))


def search(
    queries: DataFrame,
    index: Index,
    offset: int = 0,
    size: int = DEFAULTS.page_size,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """(query_id, rank, sha256, score) of one page of every query (query_id, q)."""
    check_page(offset, size, settings)
    return _page(weighted_terms(queries, index, settings), index, offset, size, settings)


def search_totals(
    queries: DataFrame, index: Index, cap: int | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """(query_id, total) of every query, 0 without a hit."""
    found = totals(ranking(weighted_terms(queries, index, settings), index, settings), cap)
    every = queries.select("query_id").distinct().join(found, "query_id", "left")
    return every.select("query_id", F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def hit_documents(page: DataFrame, index: Index) -> DataFrame:
    """The corpus rows of a written result page; only the folders of its hashes are read."""
    # Ranks start at one; saying so lets the page prune the corpus folders at run time.
    hits = page.withColumn("shard", _shard(index.digits)).filter("rank > 0")
    return index.corpus.join(hits, ["shard", "sha256"])


def search_hits(
    queries: DataFrame,
    index: Index,
    offset: int = 0,
    size: int = DEFAULTS.page_size,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One row per hit: rank, filename, score, highlights and where the object is."""
    check_page(offset, size, settings)
    weighted = weighted_terms(queries, index, settings)
    page = materialize(_page(weighted, index, offset, size, settings), "page")
    found = hit_documents(page, index)
    marked = highlights(
        found.select("query_id", "sha256", "content"), weighted, index.lemmas, settings
    )
    # At most a few fragments per hit, so this list is bounded.
    per_hit = marked.groupBy("query_id", "sha256").agg(
        F.sort_array(F.collect_list(F.struct("fragment_no", "highlight"))).alias("_marked")
    )
    return (
        found.drop("content")
        .join(per_hit, ["query_id", "sha256"], "left")
        .select(
            "query_id",
            "rank",
            "sha256",
            "filename",
            F.coalesce("score", F.lit(0.0)).alias("score"),
            F.coalesce(
                F.transform("_marked", lambda m: m["highlight"]),
                F.array().cast("array<string>"),
            ).alias("highlights"),
            "s3_bucket",
            "s3_key",
        )
    )
