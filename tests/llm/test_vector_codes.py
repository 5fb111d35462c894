import hashlib

import numpy as np
import pytest

from riskloom.llm import vector_codes
from tests.compare import rows_of, run_sql

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, x int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, vector, label). Plain loops over all entries in whole numbers."""
    kept = [(i, np.floor(scale * np.array(v, np.float32).astype(float)).astype(np.int64), y) for i, v, y in rows if v and None not in v and np.isfinite(np.array(v, float)).all()]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))[:entries]
    books = [[np.split(v, parts)[p] for _, v, _ in first] for p in range(parts)]

    def nearest(p, x):
        found = [int(((x - e) ** 2).sum()) for e in books[p]]
        return found.index(min(found)), min(found)

    for _ in range(rounds):
        chosen = [[nearest(p, np.split(v, parts)[p])[0] for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for e in set(chosen[p]):
                own = [np.split(v, parts)[p] for (_, v, _), c in zip(kept, chosen[p]) if c == e]
                books[p][e] = np.sum(own, axis=0) // len(own)
    last = [[nearest(p, np.split(v, parts)[p]) for p in range(parts)] for _, v, _ in kept]
    errors, by_label = [sum(d for _, d in x) for x in last], {}
    for (_, _, y), e in zip(kept, errors):
        by_label[y] = by_label.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(c) for part in books for e in part for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k, _ in x), e, by_label[y], sha) for (i, _, y), x, e in zip(kept, last, errors)), key=str)


def made(spark, rows):
    return spark.createDataFrame([(i, v, y, "a", "b", 1) for i, v, y in rows], SCHEMA).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_plain_loops(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.integers(-9, 9, 8) / 8).tolist(), int(i % 3)) for i in range(200)]  # many ties
    rows += [(1, rng.normal(size=8).tolist(), None), (1, rng.normal(size=8).tolist(), None), (None, rows[3][1], 1)]
    rows += [(7, rows[9][1], 0)] * 60  # one row repeated
    rows += [(300, None, 1), (301, [], 1), (302, [None] * 8, 1), (303, [float("nan")] * 8, 1), (304, [float("-inf")] * 8, 1)]
    for entries in (256, 20):
        assert got(vector_codes.compress(made(spark, rows), entries=entries)) == brute(rows, entries=entries)


def test_close_entries_are_told_apart():
    """Large components that differ in one unit lie far within float32's error; the intervals overlap and int64 decides."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**26), 2**26, 16)
    entries = base + rng.integers(-1, 2, (256, 16))
    rows = base + rng.integers(-1, 2, (500, 16))
    found, error = vector_codes.NearestEntry(entries)(rows)
    exact = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (error == exact.min(axis=1)).all() and (found == exact.argmin(axis=1)).all()


def test_intervals_hold_the_exact_value():
    rng = np.random.default_rng(2)
    for size in (10, 10**4, 10**7):
        entries, rows = rng.integers(-size, size, (64, 16)), rng.integers(-size, size, (300, 16))
        low, high = vector_codes.NearestEntry(entries).bounds(rows)
        exact = ((entries**2).sum(axis=1) - 2 * (rows @ entries.T)).astype(float)
        assert (low <= exact).all() and (exact <= high).all()


def test_refused_vectors(spark):
    for bad in ([[1.0] * 8, [1.0] * 4], [[1.0] * 6], [[3e30] * 8]):
        with pytest.raises(ValueError):
            vector_codes.compress(made(spark, [(i, v, 1) for i, v in enumerate(bad)]))


def test_decoding(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist(), 1) for i in range(50)]
    books = vector_codes.fit(vector_codes.integer_vectors(made(spark, rows), 1024))
    codes = np.tile(np.arange(50)[:, None], (1, 4))
    assert np.abs(books.decode(codes) - np.array([v for _, v, _ in rows])).max() < 2 / 1024  # an entry for each vector


def test_nothing(spark):
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0


def test_against_sql(spark):
    from riskloom.llm import entries

    sf_dir = "/root/testdata/sf0.01"
    found = entries.op11_exact_vector_codes(spark, sf_dir).toPandas()
    expected = run_sql(sf_dir, entries.oracle_sql()["op11_exact_vector_codes"])
    assert rows_of(found) == rows_of(expected) and len(found) == 500
