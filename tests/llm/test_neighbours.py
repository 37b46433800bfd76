import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliary.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, rank int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 7) for i, v in vectors], SCHEMA)


def nearest(vectors, query, count):
    own = np.array(dict(vectors)[query], np.float32).astype(float)
    rest = {i: float((np.array(v, np.float32).astype(float) * own).sum()) for i, v in vectors if i != query}
    return sorted(rest, key=lambda i: (-rest[i], i))[:count]


def search(spark, vectors, every=10, count=5):
    found = neighbours.search(table(spark, vectors), "embedding", F.col("vec_id") % every == 0, count)
    out = {}
    for row in found.orderBy("query_id", "rank").collect():
        out.setdefault(row.query_id, []).append(row)
        assert row.rank == len(out[row.query_id])
    return out


def test_small_tables_are_exact_and_ties_go_to_the_smaller_id(spark):
    random = np.random.default_rng(1)
    vectors = [(i, random.standard_normal(8).tolist()) for i in range(60)]
    vectors += [(100 + i, vectors[3][1]) for i in range(8)]
    got = search(spark, vectors)
    assert set(got) == {i for i, _ in vectors if i % 10 == 0}
    for query, rows in got.items():
        assert [r.vec_id for r in rows] == nearest(vectors, query, 5)


def test_recall_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BASE_ROWS", 100)
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 150)
    random = np.random.default_rng(2)
    centres = random.standard_normal((12, 16))
    vectors = [(i, (centres[i % 12] + 0.7 * random.standard_normal(16)).tolist()) for i in range(1500)]
    got = search(spark, vectors, every=25, count=10)
    hits = [len({r.vec_id for r in rows} & set(nearest(vectors, q, 10))) for q, rows in got.items()]
    assert len(hits) == 60 and np.mean(hits) >= 9.0


def test_recall_holds_with_many_projections(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BASE_ROWS", 8)
    random = np.random.default_rng(5)
    vectors = random.standard_normal((2000, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = search(spark, vectors, every=50, count=10)
    hits = [len({r.vec_id for r in rows} & set(nearest(vectors, q, 10))) for q, rows in got.items()]
    assert len(hits) == 40 and np.mean(hits) >= 9.0


def test_a_query_with_few_candidates_is_searched_in_full(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BASE_ROWS", 2)
    monkeypatch.setattr(neighbours, "RECALL", 0.0, raising=False)
    random = np.random.default_rng(6)
    vectors = [(i, random.standard_normal(12).tolist()) for i in range(300)]
    monkeypatch.setattr(neighbours, "TABLES", 1)
    monkeypatch.setattr(neighbours, "PROBES", 1)
    got = search(spark, vectors, every=50, count=20)
    assert len(got) == 6 and all(len(rows) == 20 for rows in got.values())


def test_hot_bucket_is_searched_in_full(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 16)
    vectors = [(i, [1.0, float(i < 5)]) for i in range(100)]
    got = search(spark, vectors, every=50, count=6)
    assert [r.vec_id for r in got[50]] == [0, 1, 2, 3, 4, 5]


def test_rows_that_take_no_part(spark):
    vectors = [(0, [1.0, 2.0]), (10, None), (20, [0.0, 0.0]), (30, [1.0, None]), (40, [float("nan"), 1.0])]
    vectors += [(50, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [3.0, 1.0]), (8, [1.0, 2.0, 3.0]), (7, [3.0, 1.0])]
    got = search(spark, vectors)
    assert {q: [(r.vec_id, r.score) for r in rows] for q, rows in got.items()} == {0: [(7, 5.0)]}
    assert neighbours.search(table(spark, [(1, None)]), "embedding", F.lit(True), 5).count() == 0


@pytest.mark.parametrize("functions", [1, 3, 5])
def test_probes_come_in_order_of_their_cost(functions):
    position = np.random.default_rng(functions).uniform(-5, 5, functions)
    sets = neighbours.probes(position, 3**functions)
    inside = position - np.floor(position)
    costs = [sum(inside[i] ** 2 if d < 0 else (1 - inside[i]) ** 2 for i, d in s) for s in sets]
    assert costs == sorted(costs)
    assert len({tuple(sorted(s)) for s in sets}) == 3**functions


@pytest.mark.parametrize("bucket", [16, 20_000])
def test_an_id_with_many_vectors_takes_one_place(spark, monkeypatch, bucket):
    """Other rows of an id, all near the query, don't crowd out its other neighbours."""
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", bucket)
    random = np.random.default_rng(3)
    vectors = [(i, random.standard_normal(6).tolist()) for i in range(60)]
    vectors += [(1, [x * (2 + 0.1 * k) for x in vectors[0][1]]) for k in range(25)]
    got = search(spark, vectors, every=20, count=20)
    for query, rows in got.items():
        own = np.array(dict(vectors[:60])[query], np.float32).astype(float)
        best = {}
        for i, v in vectors:
            if i != query:
                best[i] = max(best.get(i, -np.inf), float((np.array(v, np.float32).astype(float) * own).sum()))
        expected = sorted(best, key=lambda i: (-best[i], i))[:20]
        assert len(rows) == 20 and len({r.vec_id for r in rows} & set(expected)) >= 18
        assert all(abs(best[r.vec_id] - r.score) < 1e-9 for r in rows)
    assert got[0][0].vec_id == 1


def test_the_smallest_tables_are_hashed():
    assert neighbours.Hashing.make(8, 10, 1.0, 10).planes.shape == (10, neighbours.LEAST, 9)


@pytest.mark.parametrize("query", [False, True])
def test_visits_are_handed_on_in_bounded_batches(query):
    """A batch of queries visits thousands of buckets each; their vectors never lie in memory at once."""
    random = np.random.default_rng(8)
    vectors = pa.array(random.standard_normal((40, 8)).tolist(), pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), vectors], names=["vec_id", "vector"])
    hashing = neighbours.Hashing.make(8, 1, 9.0, 10, functions=6)
    placed = list(neighbours._place(iter([batch]), hashing, 8, query, 500))
    assert max(b.num_rows for b in placed) <= 4096
    rows = [(r["bucket"], r["vec_id"]) for b in placed for r in b.to_pylist()]
    assert {i for _, i in rows} == set(range(40))
    assert len(rows) > 4 * 4096 if query else len(rows) == 400
    known = {i: v for i, v in enumerate(vectors.to_pylist())}
    assert all(r["vector"] == known[r["vec_id"]] for b in placed for r in b.to_pylist())


def test_far_neighbours_take_fewer_projections_not_more_probes(spark):
    random = np.random.default_rng(9)
    vectors = random.standard_normal((1500, 24))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rows = neighbours.usable(df, "embedding")
    usual = {"dimension": 24, "rows": 4000 << 8, "longest": 1.0}
    hashing, visited = neighbours._hashing(rows, rows.filter("vec_id % 30 = 0"), usual, 10)
    assert hashing.planes.shape[1] < 8 and visited == neighbours.PROBES
