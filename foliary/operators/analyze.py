"""Analysed fields of documents and queries, postings and term statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions.text import tokens, whole_words
from foliary.operators.grouping import SEPARATOR, asked_words, field_groups, pack_words, term_groups
from foliary.session import arrow_batches, layout, lookup_join, rows_within, spread, text_bytes
from foliary.settings import DEFAULTS, Settings

RAW, LEMMA, FOLDED, FILENAME = "content.raw", "content", "content.folded", "filename"
FIELDS = (RAW, LEMMA, FOLDED, FILENAME)


def kept_word(word: Column, settings: Settings) -> Column:
    """Whether the content field keeps a word (it is no stop word)."""
    return ~word.isin(list(settings.stopwords)) if settings.stopwords else F.lit(True)


def with_lemmas(
    words: DataFrame, lemmas: DataFrame | None, spread_by: str, settings: Settings
) -> DataFrame:
    """Add `lemmas`, the lemmas of `word`; a word the dictionary lacks is its own lemma.

    `lemmas` is a frame (surface, lemma). Surfaces match without regard to case.
    """
    own = F.array("word")
    if lemmas is None:
        return words.withColumn("lemmas", own)
    small = rows_within(lemmas, settings.broadcast_rows)
    found = lookup_join(words, _entries(lemmas), ["word"], "left", spread_by, small, settings.salts)
    return found.withColumn("lemmas", F.coalesce("_lemmas", own)).drop("_lemmas")


def _entries(lemmas: DataFrame) -> DataFrame:
    """(word, _lemmas): the dictionary with one row per surface."""
    return lemmas.groupBy(F.lower("surface").alias("word")).agg(
        F.sort_array(F.collect_set(F.lower("lemma"))).alias("_lemmas")
    )


def packed_parts(corpus: DataFrame, settings: Settings, positions: bool) -> tuple[DataFrame, int]:
    """Texts as their distinct words, packed and placed by `part`, and the number of parts and tasks.

    Texts are cut into words where they are read. A part has about `text_bytes` of text, and all rows of
    its hashes; equal rows count as `copies`.
    """
    spark = arrow_batches(corpus.sparkSession)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = layout(text_bytes(corpus, "content"), settings.text_bytes, least)
    texts = spread(corpus).select("sha256", whole_words(F.col("content")).alias("words"))
    places = ", places array<int>" if positions else ""
    schema = f"sha256 {_hash_type(corpus)}, dl int, kept_dl int, words string, tfs array<int>{places}"
    packed = texts.mapInArrow(partial(pack_words, stopwords=tuple(settings.stopwords), positions=positions), schema)
    return packed.withColumn("part", _part(tasks)).repartition(tasks, "part"), tasks


def _part(tasks: int) -> Column:
    return F.pmod(F.xxhash64("sha256"), F.lit(tasks)).cast("long")


def _hash_type(corpus: DataFrame) -> str:
    return corpus.schema["sha256"].dataType.simpleString()


def part_entries(placed: DataFrame, tasks: int, lemmas: DataFrame | None, settings: Settings) -> DataFrame:
    """(part, word, _lemmas): the entries of a dictionary for the words of each part.

    The words stay where their texts are: a part asks for its distinct words, and only the entries
    found move to it.
    """
    if lemmas is None:
        found = placed.sparkSession.createDataFrame([], "part long, word string, _lemmas array<string>")
        return found.repartition(tasks, "part")
    # This reads the shuffle of the packed texts that the parts come from, hence all its columns.
    asked = placed.mapInArrow(partial(asked_words, known=_known(lemmas)), "part long, word string")
    entries = _entries(lemmas)
    small = rows_within(lemmas, settings.broadcast_rows)
    found = asked.join(F.broadcast(entries) if small else entries, "word")
    return found.select("part", "word", "_lemmas").repartition(tasks, "part").dropDuplicates(["part", "word"])


#: Slots for the hashes of a dictionary's words, a power of two: two megabytes of bits, whatever its size.
SLOTS = 1 << 24


def _known(lemmas: DataFrame) -> np.ndarray:
    """A bit for each slot, set where a word of the dictionary has its hash: SLOTS / 2^15 rows at most."""
    # Bit 0 of the first bucket is number 1.
    slot = F.pmod(F.xxhash64(F.lower("surface")), F.lit(SLOTS)).cast("long") + 1
    slots = lemmas.filter("surface IS NOT NULL").select(slot.alias("slot"))
    bits = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    known = np.zeros(SLOTS // 8, np.uint8)
    for row in bits.collect():
        at = (row["bucket"] - 1) * len(row["bits"])
        known[at : at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return known




def of_parts(
    corpus: DataFrame, lemmas: DataFrame | None, settings: Settings, positions: bool, function: Callable, schema: str
) -> tuple[DataFrame, int]:
    """What a function of `grouping` makes of the texts and dictionary entries of each part."""
    placed, tasks = packed_parts(corpus, settings, positions)
    found = part_entries(placed, tasks, lemmas, settings)
    # Copies of a hash are many rows of one part; they meet as one. No row moves for that.
    texts = placed.groupBy("part", *[c for c in placed.columns if c != "part"]).agg(F.count(F.lit(1)).alias("copies"))
    return texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(function, schema), tasks


def stopword_filter(words: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Word rows without stop words; the positions of the others stay as they are."""
    return words.filter(kept_word(F.col("word"), settings))


def each_word(docs: DataFrame, words: str, *keep: str) -> DataFrame:
    """(pos, word) for every word of an array column, with some columns of its row.

    The outer form keeps Spark from testing the array for emptiness before the row is read,
    which would cut every text into words twice.
    """
    rows = docs.select(*keep, F.posexplode_outer(words).alias("pos", "word"))
    return rows.filter("pos IS NOT NULL")


def word_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, word) for every word of a text."""
    return each_word(docs.select(key, tokens(F.col(text)).alias("words")), "words", key)


def analyze(
    corpus: DataFrame, lemmas: DataFrame | None = None, settings: Settings = DEFAULTS, listed: bool = False
) -> DataFrame:
    """(sha256, field, pos, term): every term of the four searched fields at its position.

    Words are grouped where the texts of a part are, so no words move. With `listed`, one row for a
    document and field, whose `terms` have the positions and terms: no longer than its text.
    """
    corpus = corpus.select("sha256", "content", "filename")
    schema = f"sha256 {_hash_type(corpus)}, field string, terms array<struct<pos:int,term:string>>"

    def group(texts: pa.Table, found: pa.Table) -> pa.Table:
        return field_groups(texts, found, stopwords, (RAW, LEMMA, FOLDED))

    stopwords = tuple(settings.stopwords)
    rows, tasks = of_parts(corpus, lemmas, settings, True, group, schema)
    named = _placed_names(corpus, tasks).groupBy("part", "sha256").agg(
        F.collect_list(F.struct("pos", F.col("word").alias("term"))).alias("terms")
    )
    rows = rows.unionByName(named.select("sha256", F.lit(FILENAME).alias("field"), "terms"))
    return rows if listed else rows.select("sha256", "field", F.inline("terms"))


def _placed_names(corpus: DataFrame, tasks: int) -> DataFrame:
    """(part, sha256, dl, pos, word) for the words of names, which are short, placed by part."""
    names = corpus.select(_part(tasks).alias("part"), "sha256", "filename").repartition("part")
    names = names.select("part", "sha256", tokens(F.col("filename")).alias("words")).withColumn("dl", F.size("words"))
    return each_word(names, "words", "part", "sha256", "dl")


def postings(
    corpus: DataFrame,
    lemmas: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    positions: bool = True,
) -> DataFrame:
    """(field, term, sha256, tf, dl, opens, positions) for every term of every document.

    `dl` is the number of positions of the document's field, `opens` marks one posting per
    document and field.
    """
    return by_field(term_rows(corpus, lemmas, settings, positions))


def by_field(rows: DataFrame) -> DataFrame:
    """The postings of term rows: one for each field that has the term.

    The term rows stay at hand as `term_rows`, for those who want few terms of them.
    """
    extra = [c for c in ("bucket", "positions") if c in rows.columns]

    def entry(at: int, field: str) -> Column:
        dl = F.col("kept_dl" if field == LEMMA else "dl")
        opens = F.col("opens").bitwiseAND(F.lit(1 << at)) > 0
        named = [F.col(f"positions.p{at}").alias("positions")] if "positions" in extra else []
        return F.struct(
            F.lit(field).alias("field"),
            F.col(f"tf_{at}").alias("tf"),
            dl.alias("dl"),
            opens.cast("int").alias("opens"),
            *named,
        )

    entries = F.array(*[entry(at, field) for at, field in enumerate(FIELDS)])
    plain = [c for c in extra if c != "positions"]
    posts = rows.select("term", "sha256", *plain, F.inline(entries)).filter("tf IS NOT NULL")
    shown = ["positions"] if "positions" in extra else []
    posts = posts.select("field", "term", "sha256", "tf", "dl", "opens", *plain, *shown)
    posts.term_rows = rows
    return posts


def term_rows(
    corpus: DataFrame,
    lemmas: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    positions: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """Postings of all fields as one row per document and term: the fields share most terms.

    `tf_0` to `tf_3` are the frequencies in the fields of FIELDS, null where a field lacks the term;
    `dl` and `kept_dl` the positions of the field, without stop words for `content`; `opens` has a
    bit for each field. Names are rows of their own.

    Texts are cut into words once, grouped as they are, and placed by hash, packed (see `packed_parts`);
    the words of a part then group, and fold or lemmatise, in memory. No word moves as a row of its
    own, and only the entries of the dictionary that a part needs come to it.

    With `buckets`, the rows of a document and term bucket are packed into one (see `by_term`), where
    they are grouped: a document's hash is then moved and written once per bucket, not once per term.
    """
    corpus = corpus.select("sha256", "content", "filename")
    stopwords = tuple(settings.stopwords)

    def group(texts: pa.Table, found: pa.Table) -> pa.Table:
        return term_groups(texts, found, stopwords, buckets, positions)

    document = f"sha256 {_hash_type(corpus)}, dl int, kept_dl int"
    if buckets is None:
        counts = ", ".join(f"tf_{i} bigint" for i in range(len(FIELDS)))
        lists = ", ".join(f"p{i}:array<int>" for i in range(len(FIELDS)))
        schema = f"term string, {document}, {counts}, opens int" + (f", positions struct<{lists}>" if positions else "")
    else:
        schema = f"{document}, bucket int, term string, " + ", ".join(f"{c} array<int>" for c in _COUNTS)
    content, tasks = of_parts(corpus, lemmas, settings, positions and buckets is None, group, schema)

    names = _placed_names(corpus, tasks)
    number = FIELDS.index(FILENAME)
    no_list = F.array().cast("array<int>")
    at = F.sort_array(F.collect_list("pos"))
    lists = [at if i == number else no_list for i in range(len(FIELDS))]
    shown = [F.struct(*[c.alias(f"p{i}") for i, c in enumerate(lists)]).alias("positions")] if positions and buckets is None else []
    names = names.groupBy("part", F.col("word").alias("term"), "sha256", "dl", F.lit(0).alias("kept_dl")).agg(
        *[
            (F.count(F.lit(1)) if i == number else F.lit(None).cast("long")).alias(f"tf_{i}")
            for i in range(len(FIELDS))
        ],
        F.max(F.when(F.col("pos") == 0, F.lit(1 << number)).otherwise(0)).alias("opens"),
        *shown,
    )
    if buckets is not None:
        names = _pack(names, buckets)
    return content.unionByName(names.drop("part"))


_DOCUMENT = ("sha256", "dl", "kept_dl", "bucket")
_COUNTS = (*[f"tf_{i}" for i in range(len(FIELDS))], "opens")


def _pack(names: DataFrame, buckets: int) -> DataFrame:
    """Rows of names packed like the others: one for a document and term bucket, with its terms.

    The terms are one text: as a list each takes 16 bytes or more, which a shuffle hardly compresses.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    packed = names.withColumn("bucket", bucket).groupBy("part", *_DOCUMENT)
    packed = packed.agg(F.sort_array(F.collect_list(F.struct("term", *_COUNTS))).alias("e"))
    # Lists of whole numbers take half the room of their rows.
    counts = [F.col(f"e.{c}").cast("array<int>").alias(c) for c in _COUNTS]
    return packed.select("part", *_DOCUMENT, F.array_join("e.term", SEPARATOR).alias("term"), *counts)


def by_term(packed: DataFrame) -> DataFrame:
    """The term rows of packed ones."""
    # A term of the dictionary may be empty or hold the separator; such rows say so by their first letter.
    listed = F.from_json(F.expr("substring(term, 2)"), "array<string>")
    terms = F.when(F.col("term").startswith(SEPARATOR), listed).otherwise(F.split("term", SEPARATOR, -1))
    return packed.withColumn("term", terms).select(*_DOCUMENT, F.inline(F.arrays_zip("term", *_COUNTS)))


def term_stats(posts: DataFrame, lengths: dict[str, float] | None = None) -> DataFrame:
    """(field, term, doc_freq, total_tf, opens): the vocabulary with its frequencies.

    With average `lengths` of the fields, also `peak`, the largest share that a term has in any
    document (see `search.largest_share`), and `reference`, the average it was computed with.
    """
    keys = [c for c in ("field", "bucket", "term") if c in posts.columns]
    most = []
    if lengths is not None:
        average = F.create_map(*[F.lit(x) for pair in lengths.items() for x in pair])[F.col("field")]
        share = _share(F.col("tf"), F.col("dl"), average)
        most = [F.max(share).alias("peak"), F.max(average).alias("reference")]
    return posts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("doc_freq"),
        F.sum("tf").alias("total_tf"),
        F.sum("opens").alias("opens"),
        *most,
    )


def average_lengths(rows: DataFrame) -> dict[str, float]:
    """The average length of the fields, from term rows as they are: one row of sums."""
    sums = []
    for at in range(len(FIELDS)):
        tf, opens = F.col(f"tf_{at}"), F.col("opens").bitwiseAND(F.lit(1 << at)) > 0
        sums += [F.sum(tf).alias(f"total_{at}"), F.count(F.when(tf.isNotNull() & opens, 1)).alias(f"opens_{at}")]
    found = rows.agg(*sums).first()
    return {name: found[f"total_{at}"] / found[f"opens_{at}"] for at, name in enumerate(FIELDS) if found[f"opens_{at}"]}


def row_stats(rows: DataFrame, lengths: dict[str, float]) -> DataFrame:
    """`term_stats` of the postings of term rows: the fields of a term share one row in the shuffle."""
    parts, found = [], []
    for at, name in enumerate(FIELDS):
        tf, dl = F.col(f"tf_{at}"), F.col("kept_dl" if name == LEMMA else "dl")
        average = F.lit(lengths.get(name)).cast("double")
        opens = F.col("opens").bitwiseAND(F.lit(1 << at)) > 0
        parts += [
            F.count(tf).alias(f"doc_freq_{at}"),
            F.sum(tf).alias(f"total_tf_{at}"),
            F.sum(F.when(tf.isNotNull(), opens.cast("int"))).alias(f"opens_{at}"),
            F.max(_share(tf, dl, average)).alias(f"peak_{at}"),
        ]
        counts = [F.col(f"{c}_{at}").alias(c) for c in ("doc_freq", "total_tf", "opens", "peak")]
        found.append(F.struct(F.lit(name).alias("field"), *counts, average.alias("reference")))
    stats = rows.groupBy("bucket", "term").agg(*parts).select("bucket", "term", F.inline(F.array(*found)))
    stats = stats.filter("doc_freq > 0")
    return stats.select("field", "bucket", "term", "doc_freq", "total_tf", "opens", "peak", "reference")


def _share(tf: Column, dl: Column, average: Column) -> Column:
    """The share of a term in a document, with the usual parameters."""
    norm = F.lit(DEFAULTS.k1) * (F.lit(1 - DEFAULTS.b) + F.lit(DEFAULTS.b) * dl / average)
    return tf / (tf + norm)


def field_stats(terms: DataFrame) -> DataFrame:
    """(field, docs, avg_length) from the vocabulary or sums of it: a handful of rows."""
    return terms.groupBy("field").agg(
        F.sum("opens").alias("docs"),
        (F.sum("total_tf") / F.sum("opens")).alias("avg_length"),
    )
