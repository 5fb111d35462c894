import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import search

SCHEMA = "vec_id long, embedding array<float>, label int, score long, q int"


def brute(rows, k):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v)).all()]
    found = {}
    for i, v in ok:
        if i % 50 == 0:
            found[i] = sorted(((-int(v @ w), j) for j, w in ok if j != i and len(w) == len(v)))[:k]
    return {(i, r + 1, j, -s) for i, best in found.items() for r, (s, j) in enumerate(best)}


def test_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(160)]
    rows += [(200, rows[7][1]), (201, rows[7][1]), (202, None), (203, []), (204, [None] * 8), (205, [float("nan")] * 8), (250, [float("inf")] * 8)]
    rows += [(300, [0.0] * 8), (350, [1.0, 2.0]), (351, [2.0, 1.0]), (None, [1.0] * 8), (400, [0.5] * 3)]
    df = spark.createDataFrame([(i, v, 1, 1, 1) for i, v in rows], SCHEMA)
    for at_once in (8192, 20):
        got = {tuple(r) for r in search.top_k(df, F.col("vec_id") % 50 == 0, candidates_at_once=at_once, queries_at_once=2, block=2).collect()}
        assert got == brute(rows, 5)


def test_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = {tuple(r) for r in search.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == brute([(r.vec_id, list(r.embedding)) for r in df.collect()], 5)


def test_repeated_identifiers(spark):
    """A third of all rows are one row, which counts once; rows of one identifier with different vectors are candidates and queries of their own."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [rows[3]] * 40 + [rows[50]] * 5 + [(50, rng.normal(size=4).tolist()), (7, rng.normal(size=4).tolist())]
    df = spark.createDataFrame([(i, v, 1, 1, 1) for i, v in rows], SCHEMA)
    rows += [(0, [1.0, 2.0, 3.0, 4.0]), (0, [1.0009, 2.0, 3.0, 4.0])]  # other vectors with equal integers
    df = spark.createDataFrame([(i, v, 1, 1, 1) for i, v in rows], SCHEMA)
    vectors = sorted((i, tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist())) for i, v in {(i, tuple(v)) for i, v in rows})
    expected = []
    for i, v in vectors:
        if i % 50 == 0:
            best = sorted((-int(np.dot(v, w)), j) for j, w in vectors if j != i)[:5]
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    got = [tuple(r) for r in search.top_k(df, F.col("vec_id") % 50 == 0, candidates_at_once=20, block=2).collect()]
    assert sorted(got) == sorted(expected)


@pytest.mark.parametrize("levels", [1, 3, 12])
def test_index_alone(levels):
    rng = np.random.default_rng(levels)
    vectors = np.concatenate([rng.integers(-300, 300, (200, 16)), np.tile(rng.integers(-300, 300, 16), (50, 1))])
    queries = rng.integers(-300, 300, (9, 16))
    which, docs, scores = search.ImpactIndex(np.arange(250), vectors, levels).search(np.arange(1000, 1009), queries, 4)
    for q in range(9):
        expected = sorted((-int(s), i) for i, s in enumerate(vectors @ queries[q]))[:4]
        assert [(-s, d) for w, d, s in zip(which, docs, scores) if w == q] == expected


def test_nothing(spark):
    assert search.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_large_components(spark):
    """Exact as far as 63 bits hold every score; refused by name beyond, in place of wrapped scores."""
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=4) * 5e5).tolist()) for i in range(120)]
    df = spark.createDataFrame([(i, v, 1, 1, 1) for i, v in rows], SCHEMA)
    assert {tuple(r) for r in search.top_k(df, F.col("vec_id") % 50 == 0).collect()} == brute(rows, 5)
    for size in (3e7, 1e30, -1e30):
        df = spark.createDataFrame([(i, [size] * 8, 1, 1, 1) for i in range(3)], SCHEMA)
        with pytest.raises(ValueError, match="63 bits"):
            search.top_k(df, F.col("vec_id") % 50 == 0)
