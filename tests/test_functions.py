import random

import pytest
from pyspark.sql import functions as F

from foliary.functions import objects as ob
from foliary.functions.distance import allowed_edits, swap_distance
from foliary.functions.text import ascii_fold, safe_highlight, tokens
from tests import model


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "text, words",
    [
        ("Smlouva.pdf č. 12-en.txt", ["smlouva.pdf", "č", "12", "en.txt"]),
        ("1,234.5 a.1 file2.pdf", ["1,234.5", "a", "1", "file2", "pdf"]),
        ("__x_y ___ it's 2026/001", ["__x_y", "it's", "2026", "001"]),
        ("漢字かな カタカナ", ["漢", "字", "か", "な", "カタカナ"]),
        ("  ...  ", []),
    ],
)
def test_words(spark, text, words):
    assert one(spark, tokens, text) == words


def test_words_of_long_runs(spark):
    text = "a." * 100_000 + " " + "x" * 600
    sizes = [len(w) for w in one(spark, tokens, text)]
    assert max(sizes) == 255
    assert sum(sizes) == 199_999 + 600


@pytest.mark.parametrize(
    "text, plain",
    [("Příliš žluťoučký", "Prilis zlutoucky"), ("straße ŁÓDŹ ﬁn", "strasse LODZ fin"), ("æøđ", "aeod"), ("漢字", "漢字")],
)
def test_fold(spark, text, plain):
    assert one(spark, ascii_fold, text) == plain


def test_safe_highlight(spark):
    assert (
        one(spark, safe_highlight, "<em>a</em> <script> & \" '")
        == "<em>a</em> &lt;script&gt; &amp; &quot; &#39;"
    )


@pytest.mark.parametrize(
    "name, ending",
    [
        ("smlouvy/2026/dodatek č. 1.pdf", ".pdf"),
        (".bashrc", ""),
        ("a.tar.gz", ".gz"),
        ("noext", ""),
        ("a.", "."),
        ("x/.b.PDF", ".PDF"),
        ("x.d/noext", ""),
    ],
)
def test_extension(spark, name, ending):
    assert one(spark, ob.extension, name) == ending


def test_names_and_etags(spark):
    assert one(spark, ob.base_name, "smlouvy/2026/dodatek č. 1.pdf") == "dodatek č. 1.pdf"
    assert one(spark, ob.bare_etag, '"abc-2"') == "abc-2"


def test_distance_edges(spark):
    pairs = [("smluova", "smlouva", 1), ("ca", "abc", 3), ("zaruca", "zaruka", 1), ("a", "a", 0)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    assert df.filter(swap_distance(F.col("a"), F.col("b")) != F.col("d")).isEmpty()


def test_distance_against_table(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abč", k=rng.randint(1, 7)))
    pairs = [(word(), word()) for _ in range(1500)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", swap_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(model.swap_distance(r.a, r.b) == r.d for r in got)


def test_allowed_edits(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("abcde",), ("abcdef",)], "t string")
    assert [r.e for r in df.select(allowed_edits(F.col("t")).alias("e")).collect()] == [0, 1, 1, 2]


@pytest.mark.parametrize(
    "key, kind",
    [("a/b.PDF", "application/pdf"), ("a.pdf/b", ob.UNKNOWN_TYPE), ("x.tar.html", "text/html"), ("x.", ob.UNKNOWN_TYPE), ("", ob.UNKNOWN_TYPE)],
)
def test_content_type(spark, key, kind):
    assert one(spark, ob.content_type, key) == kind
    assert one(spark, lambda v: ob.content_type(v, F.lit(" image/png ")), key) == "image/png"
    assert one(spark, lambda v: ob.content_type(v, F.lit("  ")), key) == kind


@pytest.mark.parametrize(
    "note, shown, bad",
    [
        (None, "2024-06-01 00:00:00", False), ("2024-02-01T10:00:00+02:00", "2024-02-01 08:00:00", False),
        ("2024-02-01T10:00", "2024-02-01 10:00:00", False), ("2024-02-01", "2024-02-01 00:00:00", False),
        ("2024-02-30T10:00:00", None, True), ("", None, True), ("10:00", None, True), ("2024", None, True),
    ],
)
def test_stored_stamp(spark, note, shown, bad):
    stamp, flag = ob.stored_stamp(F.col("v"), F.lit("2024-06-01").cast("timestamp"))
    row = spark.createDataFrame([(note,)], "v string").select(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("s"), flag.alias("b")).first()
    assert (row.s, row.b) == (shown, bad)
