"""Quality rules: robust multivariate outliers among the statistics of documents.

Every document is described by six transformed shares, with a few words' worth of typical text mixed
in so that short texts are not extreme. Square roots of shares: symbols, capitals, characters that are
no letters, words per character. Plain shares, since one repeated title is no fault: words in
repeated windows, words equal to the one before.
For each language and source the minimum covariance determinant gives a centre and a scatter that
outliers can't move: of the documents that pass the base rules, the three quarters that lie together most
tightly are sought by concentration steps, from two robust starts, and the one of smaller determinant
stays. A document is rejected when its Mahalanobis distance from that centre is over LIMIT.

All of it is DataFrame functions. Texts are read once and never shuffled. Vectors are whole units,
and equal vectors of a group are counted once, so sums are exact and the result doesn't depend on the
partitioning. Distances are counted in narrow bins, so no group is sorted or collected; a step reads
the distinct vectors once and shuffles sums by group and bin.

A group of fewer than MIN_ROWS documents can't be estimated by itself; it takes the estimate of its language,
or else of all documents, which are built from all their documents. Without enough documents at
all, the base rules alone decide. SPREAD is added to every variance, so a share that hardly varies
(most texts have no symbols) doesn't make others infinitely far.

Defined results: a null or empty text has no words and fails the base rules; null languages and
sources are groups like others; repeated rows repeat their result, and count as often as they
occur; an empty table gives an empty result. Only the columns named here are read, so others
may have any name. Texts of any length are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.llm.common import text_of
from foliary.session import materialize, rows_within

#: Words of a window; words a text needs; hundredths of its words that may stand in repeated windows.
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
#: Units of a share, and the smallest spread of a share, in units.
UNITS, SPREAD = 1024, 20.0
#: Documents that an estimate needs, the part of them it rests on, and concentration steps.
MIN_ROWS, CORE, STEPS = 200, 0.75, 10
#: The distance beyond which a document is rejected, and bins for a factor of two in distances.
LIMIT, BINS = 10.0, 32
#: Estimates up to which a side is broadcast: some 600 bytes each.
SMALL_GROUPS = 20_000

SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("symbols", "capitals", "others", "gaps", "repeats", "doubled")
SIZE = len(FEATURES)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i + 1)]


def _shifted(array: str, by: int) -> Column:
    """The array without its first elements, as long as there are any."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def _joined(array: str, by: int) -> Column:
    """Hashes of each element with the one `by` places on."""
    size = F.greatest(F.size(array) - by, F.lit(0))
    return F.zip_with(F.slice(array, 1, size), _shifted(array, by), lambda a, b: F.xxhash64(a, b))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and the counts that the shares need; the text is dropped.

    Repeated windows are found inside the row: hashes of eight words in a row, by doubling; only a
    text in which one occurs twice has them sorted, and what its repeated windows cover is added up
    along their places.
    """
    keep = [c for c in docs.columns if c != text]
    whole = text_of(text)
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(*keep, whole.alias("_text"))
    rows = rows.select(
        *keep,
        F.char_length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.char_length(F.regexp_replace("_text", r"[\p{L}\x20\x09-\x0D]+", "")).cast("long").alias("n_others"),
        lines.alias("_lines"),
        F.split("_text", SPACE, -1).alias("_parts"),
    )
    keep = [*keep, "word_chars", "n_symbols", "n_capitals", "n_others"]
    words = F.transform(F.filter("_parts", lambda w: w != ""), lambda w: F.xxhash64(w))
    rows = rows.select(
        *keep,
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        words.alias("_one"),
    )
    keep = [*keep, "n_dup_lines", "n_words", "n_doubled"]
    size = F.size("_one") - 1
    doubled = F.zip_with(F.slice("_one", 1, F.greatest(size, F.lit(0))), _shifted("_one", 1), lambda a, b: a == b)
    rows = rows.withColumn("n_words", F.size("_one").cast("long"))
    rows = rows.withColumn("n_doubled", F.size(F.filter(doubled, lambda x: x)).cast("long"))
    rows = rows.withColumn("_two", _joined("_one", 1))
    rows = rows.withColumn("_four", _joined("_two", 2)).withColumn("_eight", _joined("_four", 4))
    twice = F.size(F.array_distinct("_eight")) < F.size("_eight")
    rows = rows.select(*keep, F.when(twice, F.col("_eight")).alias("_eight"))
    placed = F.transform("_eight", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.select(*keep, F.sort_array(placed).alias("_sorted"))
    rows = rows.withColumn(
        "_same", F.zip_with("_sorted", _shifted("_sorted", 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    )
    before = F.concat(F.array(F.lit(False)), F.slice("_same", 1, F.size("_same") - 1))
    rows = rows.withColumn("_again", F.zip_with("_same", before, lambda a, b: a | b))
    found = F.zip_with("_sorted", "_again", lambda s, again: F.when(again, s["i"]))
    rows = rows.select(*keep, F.sort_array(F.array_compact(found)).alias("_places"))
    steps = F.zip_with("_places", _shifted("_places", 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)
    return rows.select(*keep, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def shares() -> list[Column]:
    """The transformed statistics as whole units from 0 to UNITS."""

    def whole(share: Column) -> Column:
        return F.least(F.round(share * UNITS), F.lit(UNITS)).cast("long")

    c = F.col
    chars = c("word_chars") + 50
    parts = (
        whole(F.sqrt(c("n_symbols") / chars)),
        whole(F.sqrt(c("n_capitals") / chars)),
        whole(F.sqrt(c("n_others") / chars)),
        whole(F.sqrt((c("n_words") + 10) / chars)),
        whole(c("n_repeat_words") / (c("n_words") + 50)),
        whole(c("n_doubled") / (c("n_words") + 50)),
    )
    return [p.alias(name) for p, name in zip(parts, FEATURES, strict=True)]


def chi_square(x: float, freedom: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, freedom // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def consistency(part: float) -> float:
    """What the covariance of the innermost part of a normal sample is multiplied by."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, SIZE) < part else (low, middle)
    return part / chi_square(low, SIZE + 2)


def _key(level: int) -> Column:
    """The name of the group that a row has on a level: language and source, language, or all."""
    own = F.to_json(F.struct(*["lang", "source"][: 2 - level])) if level < 2 else F.lit("")
    return F.concat(F.lit(f"{level}"), own)


def _checked(df: DataFrame, small: DataFrame) -> DataFrame:
    return F.broadcast(df) if rows_within(small, SMALL_GROUPS) else df


def _median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The smallest value that half of the counted rows (`n`) do not exceed."""
    whole = W.partitionBy(*keys)
    upto = whole.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = rows.groupBy(*keys, value).agg(F.sum("n").alias("n"))
    counted = counted.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(whole))
    return counted.filter("2 * _upto >= _all").groupBy(*keys).agg(F.min(value).alias("median"))


def _moments(values: list[Column]) -> list[Column]:
    """Weighted sums of whole numbers and of their products."""
    n = F.col("n")
    sums = [F.sum(n * v).alias(f"s{i}") for i, v in enumerate(values)]
    return sums + [F.sum(n * values[i] * values[j]).alias(f"p{i}_{j}") for i, j in PAIRS]


def _inverted(sums: DataFrame, keep: list[str], scale: float, spread: float) -> DataFrame:
    """From sums to means `m`, the inverse `w` of the scatter's lower triangle, and `det`, its log-determinant.

    A distance is then a sum of squares: of the rows of `w` times the difference from the means.
    """
    n = F.col("n")
    means = [(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(SIZE)]
    rows = sums.select(*keep, *means, *[(F.col(f"p{i}_{j}") / n).alias(f"p{i}_{j}") for i, j in PAIRS])
    scatter = {}
    for i, j in PAIRS:
        value = (F.col(f"p{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
        scatter[f"c{i}_{j}"] = F.greatest(value, F.lit(0.0)) + spread**2 if i == j else value
    rows = rows.select(*keep, *[f"m{i}" for i in range(SIZE)], *[c.alias(name) for name, c in scatter.items()])
    # Cholesky's factor, a column of the matrix at a time, then its inverse by substitution.
    for j in range(SIZE):
        inner = sum((F.col(f"l{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        least = F.lit(spread**2 / 1e6)
        rows = rows.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(F.col(f"c{j}_{j}") - inner, least)))
        lower = {}
        for i in range(j + 1, SIZE):
            inner = sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
            lower[f"l{i}_{j}"] = (F.col(f"c{i}_{j}") - inner) / F.col(f"l{j}_{j}")
        rows = rows.withColumns(lower) if lower else rows
    for i in range(SIZE):
        entries = {f"w{i}_{i}": 1 / F.col(f"l{i}_{i}")}
        for j in range(i):
            inner = sum((F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i)), F.lit(0.0))
            entries[f"w{i}_{j}"] = -inner / F.col(f"l{i}_{i}")
        rows = rows.withColumns(entries)
    det = sum((2 * F.ln(f"l{i}_{i}") for i in range(SIZE)), F.lit(0.0))
    return rows.select(*keep, *[f"m{i}" for i in range(SIZE)], *[f"w{i}_{j}" for i, j in PAIRS], det.alias("det"))


def distance() -> Column:
    """The squared Mahalanobis distance of a row that carries its vector and an estimate."""
    rows = []
    for i in range(SIZE):
        terms = [F.col(f"w{i}_{j}") * (F.col(FEATURES[j]) - F.col(f"m{j}")) for j in range(i + 1)]
        rows.append(sum(terms[1:], terms[0]) ** 2)
    return sum(rows[1:], rows[0])


def _starts(vectors: DataFrame) -> DataFrame:
    """Two estimates for each group: medians with absolute deviations, and the scatter of squashed values."""
    long = vectors.select("group", "n", F.posexplode(F.array(*FEATURES)).alias("at", "value"))
    long = materialize(long.groupBy("group", "at", "value").agg(F.sum("n").alias("n")), "values")
    centre = materialize(_median(long, ["group", "at"], "value"), "medians")
    off = long.join(centre, ["group", "at"]).withColumn("off", F.abs(F.col("value") - F.col("median")))
    wide = _median(off, ["group", "at"], "off").withColumnRenamed("median", "mad").join(centre, ["group", "at"])
    scale = F.sqrt((1.4826 * F.col("mad")) ** 2 + SPREAD**2)
    cells = [F.max(F.when(F.col("at") == i, F.col("median"))).cast("double").alias(f"m{i}") for i in range(SIZE)]
    cells += [F.max(F.when(F.col("at") == i, scale)).alias(f"d{i}") for i in range(SIZE)]
    centres = materialize(wide.groupBy("group").agg(*cells), "centres")

    means = [f"m{i}" for i in range(SIZE)]
    flat = [(1 / F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"w{i}_{j}") for i, j in PAIRS]
    plain = centres.select("group", F.lit(0).alias("start"), *means, *flat, F.lit(0.0).alias("det"))
    # Squashed to -1 ... 1 around the medians, in whole thousandths.
    met = vectors.join(_checked(centres, centres), "group")
    squashed = [
        F.round(1000 * F.tanh((F.col(name) - F.col(f"m{i}")) / F.col(f"d{i}"))).cast("long")
        for i, name in enumerate(FEATURES)
    ]
    sums = met.groupBy("group").agg(F.sum("n").alias("n"), *_moments(squashed))
    bent = _inverted(sums, ["group"], 1.0, 100.0).drop(*means, "det").join(centres, "group")
    skewed = [(F.col(f"w{i}_{j}") / F.col(f"d{j}")).alias(f"w{i}_{j}") for i, j in PAIRS]
    bent = bent.select("group", F.lit(1).alias("start"), *means, *skewed, F.lit(0.0).alias("det"))
    return materialize(plain.unionByName(bent), "starts")


def _concentrate(vectors: DataFrame, state: DataFrame) -> DataFrame:
    """One concentration step: the estimate from the CORE of a group that lies nearest to the last one.

    Distances are counted in bins; the core ends with the bin in which it is reached.
    """
    met = vectors.join(_checked(state, state), "group").withColumn("_d", distance())
    bin_ = F.floor(BINS * F.log2(F.sqrt("_d") + 0.01)).cast("int")
    sums = met.groupBy("group", "start", bin_.alias("bin")).agg(
        F.sum("n").alias("n"), *_moments([F.col(name) for name in FEATURES])
    )
    whole = W.partitionBy("group", "start")
    earlier = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    core = (
        sums.withColumn("_earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("_all", F.sum("n").over(whole))
        .filter(F.col("_earlier") < CORE * F.col("_all"))
    )
    totals = [F.sum(c).alias(c) for c in sums.columns if c not in ("group", "start", "bin")]
    return materialize(
        _inverted(core.groupBy("group", "start").agg(*totals), ["group", "start"], consistency(CORE), SPREAD), "estimates"
    )


def estimates(vectors: DataFrame) -> DataFrame:
    """(group, m.., w.., det): the robust centre and scatter of every group of (group, features.., n)."""
    state = _starts(vectors)
    last = None
    for _ in range(STEPS):
        state = _concentrate(vectors, state)
        mark = state.agg(F.bit_xor(F.xxhash64("group", "start", F.round("det", 9)))).first()[0]
        if mark == last:
            break
        last = mark
    best = F.row_number().over(W.partitionBy("group").orderBy("det", "start"))
    return state.withColumn("_best", best).filter("_best = 1").drop("_best", "start")


def judge(counted: DataFrame) -> DataFrame:
    """Add base_failed, group, distance and kept to documents (lang, source and counts).

    `counted` is a written table: it is read for the sizes of groups, the vectors and the verdicts.
    """
    rows = counted.withColumn("base_failed", base_failed()).select("*", *shares())
    fit = rows.filter("NOT base_failed")
    # The groups that can be estimated, level by level.
    names = [F.struct(F.lit(level).alias("level"), _key(level).alias("group")) for level in range(3)]
    own = fit.select(*[_key(level).alias(f"g{level}") for level in range(3)])
    own = materialize(own.groupBy("g0", "g1", "g2").agg(F.count(F.lit(1)).alias("n")), "groups")
    for level in range(3):
        own = own.withColumn(f"n{level}", F.sum("n").over(W.partitionBy(f"g{level}")))
    enough = [F.when(F.col(f"n{level}") >= MIN_ROWS, F.col(f"g{level}")) for level in range(3)]
    chosen = materialize(own.select("g0", F.coalesce(*enough).alias("group")), "chosen")
    wanted = chosen.select("group").filter("group IS NOT NULL").distinct()

    counts = fit.groupBy("lang", "source", *FEATURES).agg(F.count(F.lit(1)).alias("n"))
    vectors = counts.select(F.inline(F.array(*names)), *FEATURES, "n")
    vectors = vectors.join(_checked(wanted, wanted), "group", "left_semi")
    vectors = materialize(vectors.groupBy("group", *FEATURES).agg(F.sum("n").alias("n")), "vectors")
    found = chosen.join(estimates(vectors), "group") if not vectors.isEmpty() else None
    if found is None:
        return rows.select(
            *counted.columns, "base_failed", F.lit(None).cast("string").alias("group"),
            F.lit(None).cast("double").alias("distance"), (~F.col("base_failed")).alias("kept"),
        )
    found = materialize(found, "found")
    met = rows.withColumn("g0", _key(0)).join(_checked(found, found), "g0", "left")
    met = met.withColumn("distance", F.round(F.sqrt(distance()), 6))
    near = F.coalesce(F.col("distance") <= LIMIT, F.lit(True))
    return met.select(*counted.columns, "base_failed", "group", "distance", (~F.col("base_failed") & near).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    counted = materialize(with_counts(docs.select("doc_id", "lang", "source", "text")), "counted")
    return judge(counted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "distance", "group",
    )
