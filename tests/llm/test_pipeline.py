import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as pipeline
from riskloom.llm import entries, language, mixing, quality
from riskloom.llm.tokenizing import word_encoder
from test_jaccard import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The rows after each stage, read again as run() does."""
    docs, kept = small, [small]
    for name, stage in pipeline.STAGES:
        out = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, SMALL).write.parquet(out)
        docs = spark.read.parquet(out)
        kept.append(docs)
    return kept


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_named(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language", "quality", "duplicates", "mix", "pack"]
    assert all(df.columns == stages[0].columns for df in stages[1:5])


def test_language_stage(stages):
    labeller = language.Labeller(language.train_on_folds(stages[0]))
    rows = stages[0].collect()
    found = labeller.languages([r.text for r in rows])
    assert ids(stages[1]) == sorted(r.doc_id for r, (lang, _, known) in zip(rows, found) if lang != "und" and known >= 0.5)
    assert len(ids(stages[1])) > 0.95 * len(rows)


def test_quality_stage(spark, stages):
    model = quality.fit_on_folds(stages[1], spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = stages[1].collect()
    scores = model.score(np.stack([quality.term_counts(r.text.encode()) for r in rows]))
    assert ids(stages[2]) == sorted(r.doc_id for r, s in zip(rows, scores) if s >= 0.5)


def test_duplicate_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert ids(stages[3]) == sorted(doc_id for (_, doc_id), _, component in brute(rows, 5, 80, 100) if doc_id == component)


def test_mix_stage(stages):
    taken, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix(stages[3]).collect():
        taken[r.doc_id] += r.taken
    for r in stages[4].collect():
        got[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_pack_stage(stages):
    encoder = word_encoder(entries.tokenizer_file("word_bpe_49k.json"))
    rows = stages[5].collect()
    expected = Counter()
    for r in stages[4].collect():
        x = np.append(encoder.encode(r.text.encode()), 1)
        expected[r.doc_id] += len(x)
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == expected
    texts = Counter(r.doc_id for r in stages[4].collect())
    once = {r.doc_id: np.append(encoder.encode(r.text.encode()), 1).astype("<u4") for r in stages[4].collect() if texts[r.doc_id] == 1}
    for r in rows:
        if r.doc_id in once:
            assert r.ids_crc32 == zlib.crc32(once[r.doc_id][r.start : r.start + r.length].tobytes())
    windows = Counter()
    for r in rows:
        windows[r.sequence_id] += r.length
    assert max(windows.values()) <= 2048


def test_run_gives_the_last_stage(spark, stages):
    """Where a document is cut depends on the files that a stage before was written as; what is packed, id by id, does not."""
    encoder = word_encoder(entries.tokenizer_file("word_bpe_49k.json"))
    known = defaultdict(list)
    for r in stages[4].collect():
        known[r.doc_id].append(np.append(encoder.encode(r.text.encode()), 1).astype("<u4"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in pipeline.run(spark, SMALL).collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 in {zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in known[r.doc_id] if len(x) == r.doc_tokens}
    assert {k: sum(n for _, n, _ in v) for k, v in pieces.items()} == {k: sum(map(len, v)) for k, v in known.items()}
    for own in places.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 2048


def test_clashing_names_and_repeated_identifiers(spark, small):
    """Columns called like a stage's own come out unchanged; a text that shares another's doc_id is kept, whatever the order of rows."""
    docs = small.where("doc_id < 40").selectExpr("*", "1 as _lang", "2 as _score", "3 as _predicted", "4 as _text", "5 as _mark", "6 as size", "7 as target")
    other = docs.where("doc_id = 39").selectExpr("cast(38 as long) as doc_id", *[f"`{c}`" for c in docs.columns[1:]])
    results = set()
    for parts in (1, 3, 5):
        rows = docs.union(other).union(docs.where("doc_id = 3")).repartition(parts)
        for name, stage in pipeline.STAGES[:4]:
            rows = spark.createDataFrame(stage(spark, rows, SMALL).collect(), docs.schema)
            assert rows.columns == docs.columns, name
        out = rows.collect()
        assert {tuple(r)[5:] for r in out} == {(1, 2, 3, 4, 5, 6, 7)}
        results.add(frozenset((r.doc_id, r.text) for r in out))
    assert len(results) == 1


def test_awkward_rows(spark, awkward, nothing, tmp_path):
    """What each stage keeps of null, empty, blank, repeated and very long texts."""
    long_text = next(r.text for r in awkward.collect() if r.doc_id == 5)
    repeated, rest = "one two three four five six", {(5, long_text), (6, "word"), (None, "no identifier at all"), (7, next(r.text for r in awkward.collect() if r.doc_id == 7))}
    kept = [(r.doc_id, r.text) for r in pipeline.keep_languages(spark, awkward, SMALL).collect()]
    assert {x for x in kept if x[0] in (2, 3, 4)} == set() and kept.count((1, repeated)) == 2 and (5, long_text) in kept  # no letters: out
    assert set(kept) <= {(1, repeated), (8, repeated)} | rest
    one_each = [(r.doc_id, r.text) for r in pipeline.keep_one_of_each_group(spark, awkward, SMALL).collect()]
    assert [x for x in one_each if x[1] == repeated] == [(1, repeated)]  # the smallest identifier of the group
    assert {x for x in one_each if (x[1] or "").split()} == {(1, repeated)} | rest and len(one_each) == 8  # rows without words all stay
    for docs in (awkward, nothing):
        columns = docs.columns
        for i, (name, stage) in enumerate(pipeline.STAGES):
            docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), stage(spark, docs, SMALL).schema)
            assert name == "pack" or docs.columns == columns
