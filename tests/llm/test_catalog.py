"""The registered queries over the smallest given tables, and the pipeline's stages."""

import os

import duckdb
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry_points
import corpus_pipeline
from foliary.llm import bpe, toxicity
from foliary.llm.catalog import QUERIES, SQL
from foliary.llm.common import fold
from tests.llm import models

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert entry_points.queries().keys() >= QUERIES.keys() | {"pipeline"}
    assert entry_points.oracle_sql().keys() >= SQL.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    expected = connection.execute(SQL[name])
    columns = [d[0] for d in expected.description]
    rows = sorted(map(repr, expected.fetchall()))
    assert rows == sorted(repr(tuple(r)) for r in QUERIES[name](spark, SF_DIR).select(*columns).collect())


def test_stages(spark, tmp_path):
    """Every stage against a plain model, on its own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5

    def step(number, frame):
        frame.write.parquet(f"{tmp_path}/{number}")
        return spark.read.parquet(f"{tmp_path}/{number}")

    stages = [f for _, f in corpus_pipeline.STAGES]
    one = step(1, stages[0](spark, docs, SF_DIR))
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, labels, fold("doc_id", 5) != 0).collect()}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {k for k in texts if scores[k] < 0.5}

    two = step(2, stages[1](spark, one, SF_DIR))
    before, after = ({r.doc_id: r.text for r in f.collect()} for f in (one, two))
    assert two.columns == columns and after.keys() <= before.keys()
    lines = [x for t in after.values() for x in t.split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    assert {x for t in before.values() for x in t.split("\n")} >= set(lines)
    assert all(r.n_chars == len(r.text) for r in two.collect())

    three = step(3, stages[2](spark, two, SF_DIR))
    expected = {k for k, (_, c) in models.components(after).items() if k == c}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == expected

    four = step(4, stages[3](spark, three, SF_DIR))
    assert four.columns == columns and {r.doc_id for r in four.collect()} <= expected

    five = {r.doc_id: r.n_tokens for r in stages[4](spark, four, SF_DIR).collect()}
    ranks = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    tokens = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert five == {r.doc_id: len(tokens.encode_ordinary(r.text)) for r in four.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id").collect()} == five.keys()
