"""Line dedup by a segment-partition edit join.

A line is dropped if an earlier line of the corpus is equal to it, or is at most EDITS edits away
and both have MIN_CHARS characters or more. "Earlier" is the order of (doc_id, hash of the text,
line number) of a line's first occurrence.

Equal lines meet as one row that carries the text, so a line that stands in a third of all
documents is as cheap as any other. After that, every distinct line is cut into EDITS + 1
segments. A line within EDITS edits has at least one of these segments unchanged, at a position that
both lengths limit; so every line probes the few substrings that can match, for every length that can
match. A line that meets another is kept once, not as pairs. The lines that met are verified by
edit distance, computed in a band of diagonals whose differences are the bits of two numbers, until
one earlier witness is found.

All of it is DataFrame functions. Texts of lines move once, when equal lines meet; the prints move with
a hash and a sketch of the line only.

Defined results: a null text stays null and has no lines; an empty or blank line is never dropped;
rows that repeat id and text are one document and keep the same lines; null ids come first; very
long lines are handled whole; an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.session import discard, hot_key_join, materialize, rows_within

EDITS = 2
MIN_CHARS = 24
#: Rows up to which a side is broadcast, line numbers in such rows (four bytes each), and rows of
#: one key that a task joins.
SMALL_ROWS = 500_000
SMALL_NUMBERS = 16 * SMALL_ROWS
ROWS_PER_TASK = 50_000

#: Letters whose counts two lines with a common print must nearly share.
COUNTED = "nrsdlu"
#: More of them, counted only for lines that met another one.
COUNTED_LATER = "etaoihcmpgwy"

SEGMENTS = EDITS + 1
LINE = ["line_a", "line_b"]


def _print(line: Column, length: Column, segment: Column) -> Column:
    """The hash of the substring that `segment` describes: (fewer, number, shift).

    It equals a segment of a line with `fewer` fewer characters, moved by `shift`; null if the line has
    no such substring.
    """
    other = length - segment["fewer"]
    short = F.call_function("div", other, F.lit(SEGMENTS)).cast("int")
    longer = SEGMENTS - other % SEGMENTS  # from this segment on they have one more
    number = segment["number"]
    start = short * number + F.greatest(number - longer, F.lit(0)) + segment["shift"]
    size = short + (number >= longer).cast("int")
    found = F.xxhash64(other, number, F.substring(line, start + 1, size))
    return F.when((start >= 0) & (start + size <= length), found)


def _array(segments: list[tuple[int, int, int]]) -> Column:
    names = ("fewer", "number", "shift")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s, strict=True)]) for s in segments])


def index_segments() -> Column:
    """The segments of a line itself."""
    return _array([(0, i, 0) for i in range(SEGMENTS)])


def probe_segments() -> Column:
    """Those that can equal a segment of a line with at most EDITS edits and no more characters."""
    segments = []
    for fewer in range(EDITS + 1):
        for i in range(SEGMENTS):
            low, high = max(-i, fewer - (EDITS - i)), min(i, fewer + EDITS - i)
            segments += [(fewer, i, shift) for shift in range(low, high + 1)]
    return _array(segments)


def with_prints(df: DataFrame, segments: Column) -> DataFrame:
    """A row with the column `print` for each of the segments that a line has, in place of `line`.

    A row a segment keeps the generated code short enough to be compiled; an array of all prints does not.
    """
    rows = df.withColumn("length", F.length("line")).withColumn("segment", F.explode(segments))
    rows = rows.withColumn("print", _print(F.col("line"), F.col("length"), F.col("segment")))
    return rows.filter("print IS NOT NULL").drop("line", "length", "segment")


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def within_edits(one: Column, two: Column) -> Column:
    """Whether two lines are at most EDITS edits apart.

    The table of distances is walked in a band of diagonals, a column for each character of `two`.
    Bit k of the numbers is row column - EDITS + k: `up` and `down` say where a cell is one more or
    one less than the cell above it, and all rows of a column change at once by a few operations
    on whole numbers. `score` follows the lowest diagonal, then the last row; a pair whose score
    shows that no cell of the band can be small enough is walked no further.
    """
    width, mask = 2 * EDITS + 1, (1 << (2 * EDITS + 1)) - 1
    a, b = F.split(one, ""), F.split(two, "")
    a, b = (F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(y) for x, y in ((one, a), (two, b)))
    # Row by row beside the band; an empty string stands for what lies outside the line.
    padding = F.array_repeat(F.lit(""), EDITS)
    padded = F.concat(padding, a, padding, padding)
    numbers = F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.array().cast("array<int>"))
    columns = F.arrays_zip(b, *[F.slice(padded, k + 1, F.size(b)) for k in range(width)], numbers)
    number = str(width + 1)

    def flip(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(F.lit(mask))

    def equal(signs: Column) -> Column:
        bits = [F.when(signs["0"] == signs[str(k + 1)], F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)]
        return reduce(Column.__add__, bits)

    def turned(state: Column, column: Column, same: Column) -> Column:
        up, down = state["up"], state["down"]
        right_up = down.bitwiseOR(flip(same.bitwiseOR(up)))
        right_down = same.bitwiseAND(up)
        row = state["rows"] - column[number] + EDITS  # the bit of the last row, once it is in the band
        below = F.lit(1) - F.shiftright(same, 2 * EDITS)
        bit = F.call_function("shiftleft", F.lit(1), row)
        across = (right_up.bitwiseAND(bit) != 0).cast("int") - (right_down.bitwiseAND(bit) != 0).cast("int")
        shifted = F.shiftright(same, 1)
        return F.struct(
            right_down.bitwiseOR(flip(shifted.bitwiseOR(right_up))).alias("up"),
            shifted.bitwiseAND(right_up).alias("down"),
            (state["score"] + F.when(row >= 2 * EDITS, below).otherwise(across)).alias("score"),
            state["rows"].alias("rows"),
        )

    def diagonal(state: Column, same: Column) -> Column:
        up = state["up"]
        carried = (same.bitwiseAND(up) + up).bitwiseXOR(up)
        return carried.bitwiseOR(same).bitwiseOR(state["down"]).bitwiseAND(F.lit(mask))

    def step(state: Column, column: Column) -> Column:
        cells = _named(equal(column), lambda e: diagonal(state, e))
        after = _named(cells, lambda d: turned(state, column, d))
        return F.when(state["score"] > 3 * EDITS, state).otherwise(after)

    start = F.struct(
        F.lit(mask & ~((1 << EDITS) - 1)).alias("up"),
        F.lit(0).alias("down"),
        F.least(F.size(a), F.lit(EDITS)).alias("score"),
        F.size(a).alias("rows"),
    )
    near = F.abs(F.length(one) - F.length(two)) <= EDITS
    return near & (F.aggregate(columns, start, step)["score"] <= EDITS)


def _counts(line: Column, letters: str, bits: int) -> list[Column]:
    """Counts of letters, each in `bits` bits of its own."""
    taken = [F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in letters]
    return [F.shiftleft(n.cast("long") % (1 << bits), bits * i) for i, n in enumerate(taken)]


def _apart(one: Column, two: Column, letters: str, bits: int) -> Column:
    """How far the counts of two lines are apart at least; known modulo 2 ** bits, so around the circle."""
    apart = []
    for i in range(len(letters)):
        parts = [F.shiftright(x, bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for x in (one, two)]
        between = F.abs(parts[0] - parts[1])
        apart.append(F.least(between, F.lit(1 << bits) - between))
    return reduce(Column.__add__, apart)


def sketch(line: Column, length: Column) -> Column:
    """Counts of letters, four bits for each, and above them three bits of the length."""
    parts = [*_counts(line, COUNTED, 4), F.shiftleft(length.cast("long") % 8, 4 * len(COUNTED))]
    return reduce(Column.bitwiseOR, parts)


def sketches_allow(one: Column, two: Column) -> Column:
    """Whether the counts of two lines can be at most EDITS edits apart: an edit changes two by one."""
    return _apart(one, two, COUNTED, 4) <= 2 * EDITS


def finer_sketch(line: Column) -> Column:
    """Counts of other letters, for the lines whose distance may have to be computed."""
    return reduce(Column.bitwiseOR, _counts(line, COUNTED_LATER, 5))


def _lines(docs: DataFrame) -> DataFrame:
    """A row for every line that can be dropped: its place, its two hashes and its text."""
    texts = docs.filter("text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    texts = texts.filter(F.length(F.trim("line")) > 0)
    return texts.withColumn("line_a", F.xxhash64("line")).withColumn("line_b", F.xxhash64(F.lit(1), "line"))


def _distinct(lines: DataFrame) -> DataFrame:
    """Per distinct line: its hashes, its first place, how often it occurs, its text and its sketch."""
    first = F.min(F.struct("doc_id", "text_key", "line_no")).alias("first")
    met = lines.groupBy(*LINE).agg(first, F.count(F.lit(1)).alias("times"), F.first("line").alias("line"))
    return met.withColumn("sketch", sketch(F.col("line"), F.length("line")))


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if rows_within(df, SMALL_ROWS) else df


def _side(lines: DataFrame, name: str, segments: Column) -> DataFrame:
    found = with_prints(lines, segments)
    return found.select("print", *[F.col(c).alias(f"{name}_{c}") for c in found.columns if c != "print"])


def _same_length() -> Column:
    bits = 4 * len(COUNTED)
    return F.shiftright("one_sketch", bits) == F.shiftright("two_sketch", bits)


def _met(long_enough: DataFrame) -> DataFrame:
    """(line_a, print) of the lines that probe a segment of another line with similar letters.

    A row is kept or not, however many lines it meets, so a block of many lines gives no pairs. Lines
    that share `line_a` are told apart later, by their texts.
    """
    slim = long_enough.select("line_a", "sketch", "line")
    one, two = _side(slim, "one", index_segments()), _side(slim, "two", probe_segments())
    other = F.col("one_line_a") != F.col("two_line_a")
    allowed = other & sketches_allow(F.col("one_sketch"), F.col("two_sketch"))
    met = two.join(one, (one["print"] == two["print"]) & allowed, "left_semi")
    return met.select(F.col("two_line_a").alias("line_a"), "print")


def _near(distinct: DataFrame) -> DataFrame:
    """The hashes of distinct lines that are near an earlier one.

    Only lines that met take their texts along. A line is verified up to its first earlier witness.
    """
    long_enough = distinct.filter(F.length("line") >= MIN_CHARS)
    met = materialize(_met(long_enough), "met")
    hits = materialize(met.select("print").distinct(), "hits")
    kept = long_enough.select(*LINE, "sketch", "first", F.col("line").alias("text"))
    one = with_prints(kept.withColumn("line", F.col("text")), index_segments())
    one = one.join(_checked(hits), "print", "left_semi")
    two = kept.join(_checked(met), "line_a")
    # The distance is work for many tasks, however few bytes the rows are.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [
        materialize(x.withColumn("finer", finer_sketch(F.col("text"))).select(
            "print", *[F.col(c).alias(f"{n}_{c}") for c in (*LINE, "sketch", "finer", "first", "text")]
        ), f"{n}-side")
        for n, x in (("one", one), ("two", two))
    ]
    discard(hits, met)
    one, two = (x.repartition(tasks, "print") for x in sides)
    apart = _apart(F.col("one_sketch"), F.col("two_sketch"), COUNTED, 4)
    apart += _apart(F.col("one_finer"), F.col("two_finer"), COUNTED_LATER, 5)
    same = (one["print"] == two["print"]) & (apart <= 2 * EDITS)
    close = within_edits(F.col("one_text"), F.col("two_text"))
    # Lines of the same length probe each other; the later one as the probe is enough.
    probing = two.join(one, same & (F.col("one_first") < F.col("two_first")) & close, "left_semi")
    probed = one.join(two, same & ~_same_length() & (F.col("two_first") < F.col("one_first")) & close, "left_semi")
    later = [x.select(*[F.col(f"{n}_{c}").alias(c) for c in LINE]) for n, x in (("two", probing), ("one", probed))]
    near = materialize(later[0].unionByName(later[1]).distinct(), "near")
    discard(*sides)
    return near


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_numbers) of the documents that lose lines; numbers from 0."""
    lines = _lines(docs)
    distinct = materialize(_distinct(lines), "lines")
    near = _near(distinct)

    marked = _checked(near).withColumn("near", F.lit(True))
    known_near = distinct.select(*LINE, "first", "times").join(marked, LINE, "left")
    decided = known_near.filter("times > 1 OR near").select(*LINE, "first", F.coalesce("near", F.lit(False)).alias("near"))
    decided = materialize(decided, "decided")
    discard(distinct, near)
    places = lines.select("doc_id", "text_key", "line_no", *LINE)
    if rows_within(decided, SMALL_ROWS):
        met = places.join(F.broadcast(decided), LINE)
    else:
        met = hot_key_join(places, decided, LINE, "text_key", ROWS_PER_TASK)
    place = F.struct("doc_id", "text_key", "line_no")
    gone = met.filter(F.col("near") | ~place.eqNullSafe(F.col("first")))
    gone = gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line_no")).alias("line_numbers"))
    gone = materialize(gone, "gone")
    discard(decided)
    return gone


def dedup(docs: DataFrame, *more: str, drop_empty: bool = False) -> DataFrame:
    """The documents with what is left of their texts, and the columns named in `more`:
    `n_lines`, and `line_numbers` of the dropped lines (they replace columns of these names).

    With `drop_empty`, documents go that lost lines and have no other line that is not blank.
    """
    gone = dropped_lines(docs)
    numbers = gone.agg(F.sum(F.size("line_numbers"))).first()[0] or 0
    gone = _checked(gone) if numbers <= SMALL_NUMBERS else gone
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_key"])
    numbers = gone["line_numbers"]
    lines = F.split(docs["text"], "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(numbers, i)), "\n")
    text = F.when(numbers.isNull(), docs["text"]).otherwise(kept)
    extra = {
        "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
        "line_numbers": F.coalesce(numbers, F.array().cast("array<int>")),
    }
    own = [text.alias("text") if c == "text" else docs[c] for c in docs.columns if c not in more]
    joined = docs.join(gone, same, "left")
    if drop_empty:
        blank = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) == 0))
        joined = joined.filter(numbers.isNull() | (F.size(numbers) + blank < F.size(lines)))
    return joined.select(*own, *[extra[m].alias(m) for m in more])


def report(docs: DataFrame) -> DataFrame:
    """Per document: its lines, the dropped ones, and a hash of what is left."""
    found = dedup(docs.select("doc_id", "text"), "n_lines", "line_numbers")
    return found.select(
        "doc_id",
        "n_lines",
        F.size("line_numbers").cast("long").alias("n_dropped"),
        F.array_join(F.col("line_numbers").cast("array<string>"), ",").alias("dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
