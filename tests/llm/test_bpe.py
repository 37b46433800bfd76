import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from foliary.llm import bpe
from tests.llm import models

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.parse_ranks(bpe.read_ranks(PATH))
TOKENS = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def samples():
    rng = random.Random(5)
    kinds = [
        lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)),
        lambda n: rng.choice("a =-.x\n") * n * 3,
        lambda n: "".join(rng.choice(["the", "ing", "é", "ß", "日本", "  ", "\n", "'s", "12", "​", "\x1c"]) for _ in range(n)),
        lambda n: "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x600), 0x1F600])) for _ in range(n)),
        lambda n: "".join(rng.choice("ab") for _ in range(n * 3)),
    ]
    return [rng.choice(kinds)(rng.choice([1, 5, 30, 100, 400])) for _ in range(400)]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, PATTERN)


def test_equals_the_library_and_round_trips(codec):
    for text in samples():
        ids = list(codec.encode(text))
        assert ids == TOKENS.encode_ordinary(text), ascii(text)
        assert codec.decode(ids) == text.encode()


def test_tree_equals_plain_merging(codec):
    rng = random.Random(8)
    for _ in range(200):
        data = bytes(rng.choice(b"abcd \xc3\xa9") for _ in range(rng.randrange(1, 300)))
        assert codec.reduce(data) == codec.merge(data)


def test_long_matches(codec):
    text = "a" * 50_000 + "x" * 33_333 + "".join(random.Random(2).choice("abc") for _ in range(40_000))
    assert list(codec.encode(text)) == TOKENS.encode_ordinary(text)


def test_rows(spark):
    texts = [(1, "Hello, world"), (2, None), (3, ""), (1, "Hello, world"), (None, "x" * 3000)]
    docs = models.documents(spark, texts).withColumnsRenamed({"lang": "ids", "source": "decoded"})
    got = sorted(map(tuple, bpe.digest(docs, PATH, PATTERN).collect()), key=str)
    expected = []
    for key, text in texts:
        ids = TOKENS.encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((key, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    assert bpe.digest(docs.limit(0), PATH, PATTERN).count() == 0


def test_columns_pass_through(spark):
    docs = models.documents(spark, {1: "abc def"}).withColumnRenamed("lang", "ids")
    row = bpe.decode(bpe.encode(docs, "text", "ids", PATH, PATTERN), "ids", "bytes", PATH, PATTERN).first()
    assert row.ids == TOKENS.encode_ordinary("abc def") and bytes(row.bytes) == b"abc def" and row.source == "src1"


def test_words_of_documents_come_through_the_tree(spark):
    """Most long words are joined from halves, and what is remembered stays within its bound."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    codec = bpe.Codec(RANKS, PATTERN)
    texts = [r.text or "" for r in docs.select("text").collect()]
    assert all(list(codec.encode(t)) == TOKENS.encode_ordinary(t) for t in texts)
    assert codec.joins > 1000


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 20_000)
    monkeypatch.setattr(bpe, "KNOWN_PAIRS", 50)
    codec = bpe.Codec(RANKS, PATTERN)
    for text in samples():
        assert list(codec.encode(text)) == TOKENS.encode_ordinary(text)
        assert len(codec.known) + len(codec.older) < 250 and len(codec.stable) <= 50
