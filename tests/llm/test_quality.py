import zlib

import numpy as np
import pytest

from riskloom.llm import quality


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels")]


@pytest.fixture(scope="module")
def model(tables):
    return quality.fit_on_folds(*tables)


def test_held_out_accuracy(tables, model):
    labels = {r.doc_id: r.quality for r in tables[1].collect()}
    rows = [r for r in quality.classify(tables[0], model).collect() if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = [r.predicted == labels[r.doc_id] for r in rows]
    junk = [r.predicted == 0 for r in rows if labels[r.doc_id] == 0]
    assert sum(right) / len(right) > 0.97 and sum(junk) / len(junk) > 0.9
    good, bad = ([r.score for r in rows if labels[r.doc_id] == y] for y in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad) > 0.98


def test_held_out_junk_of_the_larger_table(spark):
    """All 1,344 held-out labels of sf0.1: junk and clean documents told apart by neighbours alone."""
    tables = [spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels")]
    labels = {r.doc_id: r.quality for r in tables[1].where("quality IS NOT NULL").collect()}
    held = tables[0].join(tables[1].select("doc_id"), "doc_id", "left_semi")
    rows = [r for r in quality.classify(held, quality.fit_on_folds(*tables)).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    good, bad = (np.array([r.score for r in rows if labels[r.doc_id] == y]) for y in (1, 0))
    assert len(rows) == 1344 and ((good[:, None] > bad) + (good[:, None] == bad) / 2).mean() > 0.99
    assert (good >= 0.5).mean() > 0.995 and (bad < 0.5).mean() > 0.95


def test_votes_equal_brute_force(model, small):
    """Cosine by cosine, all that tie with the last neighbour among the voters."""
    counts = np.stack([quality.term_counts(r.text.encode()) for r in small.limit(20).collect()])
    vectors = model.embed(counts)
    for vector, score in zip(vectors, model.score(counts)):
        cosines = sorted(((float(vector @ x), float(y)) for x, y in zip(model.vectors, model.labels)), reverse=True)
        last = cosines[model.neighbours - 1][0]
        voters = [(max(c, 0) ** model.power, y) for c, y in cosines if c >= last - 1e-6]
        assert score == pytest.approx(sum(w * y for w, y in voters) / sum(w for w, _ in voters), abs=1e-3)


def test_projection_equals_whole_decomposition(tables):
    """The same singular space as numpy's whole decomposition of the weighted terms."""
    model = quality.fit_on_folds(*tables, dimensions=5)
    labels = [r.doc_id for r in tables[1].where("quality IS NOT NULL").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    texts = {r.doc_id: r.text for r in tables[0].collect()}
    counts = np.stack([quality.term_counts((texts[i] or "").encode()) for i in labels if i in texts]).astype(float)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
    weighted = np.sqrt(counts) * idf
    weighted /= np.linalg.norm(weighted, axis=1, keepdims=True)
    right = np.linalg.svd(weighted, full_matrices=False)[2][:3]
    assert model.idf == pytest.approx(idf, rel=1e-4)
    assert np.linalg.norm(right @ model.projection, axis=1) == pytest.approx(np.ones(3), abs=1e-2)


def test_counts_equal_brute_force():
    data = "Ab ab ab\nx!\nx!\né".encode()
    counts = quality.term_counts(data)
    words = data.lower().split()
    assert counts[: quality.PAIRS].sum() == len(data) - 1 and counts[quality.PAIRS :].sum() == sum(len(words) - d for d in (1, 2, 3))
    equal = sum(words[i] == words[i + d] for d in (1, 2, 3) for i in range(len(words) - d))
    assert equal == 4 and counts[quality.PAIRS] >= equal
    assert np.array_equal(quality.term_counts(b" ".join(words))[quality.PAIRS :], counts[quality.PAIRS :]) and not quality.term_counts(b"").any()


def test_repeated_identifiers_drop_no_label(spark, small):
    """One labelled identifier in very many rows: every other labelled text is still learned from, whatever the order of rows."""
    texts = [r.text for r in small.limit(12).collect()]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, label int")
    models = []
    for parts in (1, 3, 5):
        rows = [(0, texts[0])] * 200 + [(0, texts[5])] * 100 + list(enumerate(texts))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        models.append(quality.fit(docs, labels, sample=12))
    assert all(len(m.labels) == 12 and np.array_equal(m.vectors, models[0].vectors) for m in models)


def test_clashing_names_stay(small, model):
    df = small.limit(5).selectExpr("doc_id", "text", "1 as _text", "2 as __text", "3 as score")
    out = quality.classify(df, model, into=("s", "p"))
    assert out.columns == [*df.columns, "s", "p"] and {tuple(r)[2:5] for r in out.collect()} == {(1, 2, 3)}


def test_awkward_rows(spark, awkward, nothing, model):
    rows = quality.classify(awkward, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.classify(nothing, model).count() == 0
    no_labels = quality.fit(awkward, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, label int"))
    assert {r.score for r in quality.classify(awkward, no_labels).collect()} == {0.5}
