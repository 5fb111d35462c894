from collections import defaultdict

import duckdb
import numpy as np
import pytest

from riskloom.llm import mixing


def water(sizes):
    """Targets by resharing the excess, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.remove(s)
    return target


@pytest.mark.parametrize("name", ["small", "awkward"])
def test_targets_and_taken(request, name):
    df = request.getfixturevalue(name)
    rows = mixing.mix(df).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    assert len(rows) == df.count()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    expected = water(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= 2
    key = lambda r: (r.doc_id is not None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, rows), key=str) == sorted(map(key, mixing.mix(df.repartition(5)).collect()), key=str)


def test_equals_sql(small):
    documents = small.toPandas()  # noqa: F841
    expected = duckdb.sql(mixing.ORACLE_SQL).df().sort_values("doc_id")
    got = mixing.mix(small).toPandas().sort_values("doc_id")
    assert (got[expected.columns].values == expected.values).all()


def test_rows_of_the_mix(awkward, small):
    for df in (awkward, small):
        per_source = defaultdict(int)
        for r in mixing.mix(df).collect():
            per_source[r.source] += r.taken
        got = defaultdict(int)
        mixed = mixing.mixed_documents(df)
        assert mixed.columns == df.columns
        texts = {r.text for r in df.collect()}
        for r in mixed.collect():
            got[r.source] += len(r.text.encode().split())
            assert r.text in texts or any(t and t.startswith(r.text) for t in texts)
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in per_source.items() if v}


def test_many_sources_are_salted(small, monkeypatch):
    expected = sorted(map(tuple, mixing.mix(small).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(small).collect())) == expected


# the last source's target is 1.5, 20.5 and 19.5 words: half a word below once or twice its size
@pytest.mark.parametrize("sizes", [{"a": [1]}, {"a": [13], "b": [9], "c": [10, 11]}, {"a": [15], "b": [20, 14], "c": [4, 6]}])
def test_target_that_rounds_to_the_whole_source(spark, sizes):
    df = spark.createDataFrame([(10 * i + j, " ".join(["w"] * n), s) for i, (s, ns) in enumerate(sizes.items()) for j, n in enumerate(ns)], "doc_id long, text string, source string")
    documents = df.toPandas()  # noqa: F841
    expected = duckdb.sql(mixing.ORACLE_SQL).df().sort_values("doc_id")
    got = mixing.mix(df).toPandas().sort_values("doc_id")
    assert (got[expected.columns].values == expected.values).all()
    last = got[got.source == max(sizes)]
    assert set(last.taken / last["size"]) == {round(last.target.iloc[0] / sum(sizes[max(sizes)]))}
    assert sum(len(r.text.split()) for r in mixing.mixed_documents(df).collect()) == got.taken.sum()


def test_nothing(nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_inclusion_shares_are_those_of_the_solved_odds(spark):
    """300 equal sources are 300 draws: how often a document is drawn against the probability that its odds, with the factor that adds up to the open words, give."""
    sizes = np.array([3, 5, 8, 8, 12, 20, 20, 30, 45, 60, 80, 100, 150, 200] * 2)
    rows = [(s * 100 + i, "w " * int(n), f"s{s:03d}") for s in range(300) for i, n in enumerate(sizes)]
    taken = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,), share=1.4)
    drawn = np.zeros(len(sizes))
    for r in taken.collect():
        drawn[r.doc_id % 100] += (r.taken - r.copies * r.size) / r.size / 300
    odds, low, high = np.sqrt(sizes.mean() / sizes), 1e-6, 1e6
    for _ in range(200):
        factor = np.sqrt(low * high)
        p = factor * odds / (1 + factor * odds)
        low, high = (factor, high) if p @ sizes < 0.4 * sizes.sum() else (low, factor)
    assert abs(drawn @ sizes - 0.4 * sizes.sum()) < 1
    assert np.abs(drawn - p).max() < 0.12 and np.corrcoef(drawn, p)[0, 1] > 0.9
