"""Every registered query against its SQL on the smallest given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from foliary.catalog import fixtures
from foliary.catalog.oracle import build
from foliary.catalog.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SQL = build()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


def test_entry_points_hold_every_query():
    assert entry_points.queries().keys() >= QUERIES.keys()
    assert entry_points.oracle_sql().keys() >= SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, name):
    got = QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    expected = tables.execute(SQL[name])
    order = [d[0] for d in expected.description]
    assert sorted(order) == columns
    rows = sorted(repr(tuple(r[order.index(c)] for c in columns)) for r in expected.fetchall())
    assert rows
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == rows


def test_stored_texts_move_only_when_copied(spark, tmp_path):
    texts = [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (4, None), (6, None), (7, "c"), (5, "d"), (None, "e")]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = fixtures.sidecars(spark, str(tmp_path))
    assert sorted(r.text or "" for r in found.collect()) == ["", "a", "b", "c"]
    # Texts without copies stay where they are: no aggregate is above them.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")
