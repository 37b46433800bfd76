import pytest
from pyspark.sql import functions as F

from foliary.operators import extract
from foliary.sources import messages

PDF, PAGES = extract.CHARS_PER_PAGE_KEY, extract.PAGES_KEY


@pytest.mark.parametrize(
    "meta, text, expected",
    [
        ({PDF: ["250.5"]}, "x", 250.5),
        ({PDF: ["abc"], PAGES: ["2"]}, "x" * 100, 50.0),
        ({PDF: []}, "x" * 7, 7.0),
        ({PDF: ["1d"]}, "x" * 7, 7.0),
        ({PAGES: ["0"]}, "x" * 9, 9.0),
        ({PAGES: ["1.0"]}, "x" * 9, 9.0),
        ({PAGES: ["3", "9"]}, "x" * 9, 3.0),
        ({PAGES: []}, " \n\t  ", 0.0),
        ({}, "\xa0 " + "x" * 99 + "\n", 99.0),
    ],
)
def test_chars_per_page(spark, meta, text, expected):
    df = spark.createDataFrame([(meta, text)], "m map<string,array<string>>, t string")
    assert df.select(extract.chars_per_page(F.col("m"), F.col("t")).alias("n")).first().n == expected


def test_gate_edges(spark):
    df = spark.createDataFrame([(99.0,), (100.0,), (101.0,), (float("nan"),)], "n double")
    got = [r.low for r in df.select(extract.low_text(F.col("n")).alias("low")).collect()]
    assert got == [True, False, False, False]


def test_markup(spark):
    page = (
        "<!DOCTYPE html><html lang='cs'><head><title>T &amp; U</title><style>p{}</style></head>"
        "<body><script>if (a<b) x();</script><!-- gone --><p>A&nbsp;b &#269;&#x10D; &#1114112;</p>"
        "<p>c &amp;lt; d<br>e</p></body></html>"
    )
    df = spark.createDataFrame([(page,), ("plain a < b &amp; text",)], "v string")
    marked, plain = [r.t for r in df.select(extract.extract_text(F.col("v")).alias("t")).collect()]
    assert marked.strip().split("\n") == ["T & U", "A\u00a0b čč &#1114112;", "c &lt; d", "e"]
    assert plain == "plain a < b &amp; text"


@pytest.mark.parametrize(
    "content, expected",
    [
        ("<!-- note -->\n<html><body><p>hello</p></body></html>", "hello"),
        ("<div><p>hello</p></div>", "hello"),
        ("<table><tr><td>alpha</td><td>beta</td></tr><tr><td>c</td></tr></table>", "alpha beta\nc"),
        ("<section>c</section><section>d</section>", "c\nd"),
        ("<head><link rel=x></head>e<b>f</b><pre>g</pre>", "ef\ng"),
        ("<p>caf&eacute; &ndash; &hellip; &amp;eacute; &unknown; a&b</p>", "café – … &eacute; &unknown; a&b"),
        ("if a < b and c > d", "if a < b and c > d"),
    ],
)
def test_markup_anywhere(spark, content, expected):
    df = spark.createDataFrame([(content,)], "v string")
    assert df.select(extract.extract_text(F.col("v")).alias("t")).first().t.strip() == expected


CZECH = "Příliš žluťoučký kůň úpěl ďábelské ódy"


@pytest.mark.parametrize(
    "content, expected",
    [
        (CZECH.encode(), CZECH),
        (b"\xef\xbb\xbf" + CZECH.encode(), CZECH),
        (CZECH.encode("utf-16"), CZECH),
        (CZECH.encode("utf-32"), CZECH),
        (CZECH.encode("cp1250"), CZECH),
        (b'<meta charset="windows-1250">' + CZECH.encode("cp1250"), CZECH),
        (b'<meta http-equiv="Content-Type" content="text/html; charset=iso-8859-2">' + CZECH.encode("iso-8859-2"), CZECH),
        (b"PK\x03\x04\x00\x00", None),
        (b"", ""),
    ],
)
def test_character_sets(spark, content, expected):
    df = spark.createDataFrame([("h", bytearray(content))], "sha256 string, content binary")
    row = extract.builtin_extractor(df).first()
    assert (row.text, row.http_code) == (expected, 422 if expected is None else 200)


def test_outcomes(spark):
    df = spark.createDataFrame([(200,), (404,), (503,), (None,)], "c int")
    got = df.select(
        extract.outcome_class(F.col("c")).alias("o"),
        extract.outcome_message(F.col("c"), F.lit("m" * 900)).alias("m"),
    ).collect()
    assert [r.o for r in got] == ["ok", "permanent", "retryable", "retryable"]
    assert got[0].m is None and got[1].m == "status 404: " + "m" * 500


def test_python_extractor(spark):
    def parse(content):
        if content == b"bad":
            raise ValueError("unsupported")
        if content == b"crash":
            raise RuntimeError("oops")
        return content.decode().upper(), {"kind": ["test"]}

    rows = [("1", b"ok"), ("2", b"bad"), ("3", b"crash")]
    df = spark.createDataFrame(rows, "sha256 string, content binary")
    got = {r.sha256: (r.text, r.http_code) for r in extract.python_extractor(parse)(df).collect()}
    assert got == {"1": ("OK", 200), "2": (None, 422), "3": (None, 500)}


def test_builtin_extractor_rejects_bytes(spark):
    df = spark.createDataFrame([("1", b"\xff\xfe\x00"), ("2", b"ok")], "sha256 string, content binary")
    got = {r.sha256: r.http_code for r in extract.builtin_extractor(df).collect()}
    assert got == {"1": 422, "2": 200}


def test_messages(spark):
    bodies = [
        ('{"Records":[{"s3":{"bucket":{"name":"b"},"object":{"key":"a%20b"}}},{"s3":{}}]}',),
        ('{"Records":[{"s3":{"bucket":{"name":""},"object":{"key":"k"}}}]}',),
        ('{"Event":"ping"}',),
        ('{"Records":[{"s3"',),
    ]
    df = spark.createDataFrame(bodies, "body string")
    assert [tuple(r) for r in messages.parse_notifications(df).collect()] == [("b", "a%20b")]
    jobs = messages.decode_jobs(messages.notification_jobs(df)).collect()
    assert [(r.s3_bucket, r.s3_key, r.reason) for r in jobs] == [("b", "a%20b", None)]
    bad = spark.createDataFrame([("nope",), ('{"bucket":"b"}',)], "payload string")
    assert [r.reason for r in messages.decode_jobs(bad).collect()] == ["not a job", "missing field"]


def test_uploads(spark):
    rows = [("a.txt", b"x"), ("", b"x"), (None, b"x"), ("b.txt", b"")]
    good, bad = messages.split_uploads(
        spark.createDataFrame(rows, "filename string, content binary")
    )
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == [
        "empty file", "filename is required", "filename is required",
    ]
    addressed = messages.address_uploads(good).first()
    assert addressed.s3_key == f"documents/{addressed.sha256}.txt" and addressed.size_bytes == 1
