import itertools
import re
import zlib

import numpy as np
import pytest

from riskloom.llm import language


@pytest.fixture(scope="module")
def model(small):
    return language.train_on_folds(small)


def test_held_out_accuracy(spark, model):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in language.identify(documents, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for penalty in (0.0, 0.7, 3.0):
        lengths = np.array([3, 0, 5, 1])
        scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
        labels = language.best_paths(scores, lengths, penalty)

        def value(path, own):
            return sum(own[i, x] for i, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))

        at = 0
        for n in lengths:
            own = scores[at : at + n]
            best = max((value(p, own) for p in itertools.product(range(3), repeat=int(n))), default=0)
            assert value(labels[at : at + n].tolist(), own) == pytest.approx(best, abs=1e-4)
            at += n


def test_spans_of_mixed_text(spark, small, model):
    texts = {r.lang: " ".join(r.text.split()[:60]) for r in small.where("n_chars > 900").collect() if "|" not in r.text and not r.text.isupper()}
    mixed = spark.createDataFrame([(1, " ".join(texts[x] for x in ("en", "de", "fr")), 7)], "doc_id long, text string, spans long")
    spans = language.language_spans(mixed, model).first().spans
    long = [s.lang for s in spans if s.last - s.first >= 20]
    assert long == ["en", "de", "fr"]
    for s, at in zip([s for s in spans if s.last - s.first >= 20], (0, 60, 120)):
        assert abs(s.first - at) <= 6
    assert [s.first for s in spans[1:]] == [s.last for s in spans[:-1]]


def test_scripts_narrow(spark):
    rows = [(i, "привет как дела мир", "ru") for i in range(30)] + [(100 + i, "hello how are you world", "en") for i in range(30)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    labeller = language.Labeller(model)
    assert labeller.languages(["щжщж", "zzqq", "日本", "123", "", "zzqq 日本"]) == [("ru", 1.0, 1.0), ("en", 1.0, 1.0), ("en", 0.0, 0.0), ("und", 0.0, 0.0), ("und", 0.0, 0.0), ("en", 4 / 6, 4 / 6)]


def test_word_scores_equal_a_sum_over_grams(model):
    """Word by word and gram by gram, as the docstring says it."""
    words = ["grün", "don't", "x", "abc123déf_ghi", "42", "日本語", "straße,", "e\u0301tude", "привет-hello", "𝒳yz", "a1b2", "Ⅷ", "²"]
    scores, counts = model.words(words)
    known = [dict(zip(k.tolist(), s)) for k, s in zip(model.keys, model.scores)]
    for word, score, (letters, in_known) in zip(words, scores, counts):
        total, n, n_known = np.zeros(len(model.languages)), 0, 0
        for run in re.findall(r"[^\W\d_]+", word):
            n += sum(map(str.isalpha, run))
            narrowed = model.scripts.get(language.script_of(run[0]))
            if narrowed is not None:
                n_known += sum(map(str.isalpha, run))
                total += narrowed
                for order in (1, 2, 3):
                    edged = run if order == 1 else f"^{run}$"
                    for i in range(len(edged) - order + 1):
                        total += known[order - 1].get(language.gram_key(edged[i : i + order]), 0) / 3
        assert (letters, in_known) == (n, n_known), word
        assert score == pytest.approx(total, rel=1e-4, abs=1e-3), word
    nothing, none = model.words([])
    assert nothing.shape == (0, len(model.languages)) and none.shape == (0, 2)


def test_parts_of_few_words_change_nothing(small, model):
    texts = [r.text for r in small.limit(60).collect()]
    parted = language.Labeller(model)
    parted.most = 1
    assert language.Labeller(model).languages(texts) == parted.languages(texts)


def test_clashing_names_stay(spark, small, model):
    """Columns called like the operator's own temporary ones come out unchanged."""
    df = small.limit(5).selectExpr("doc_id", "text", "1 as _text", "2 as __text", "3 as _lang", "4 as a_b", "'x' as SCORE_")
    out = language.identify(df, model)
    assert out.columns == [*df.columns, "lang_pred", "score"]
    assert {tuple(r)[2:7] for r in out.collect()} == {(1, 2, 3, 4, "x")}


def test_awkward_rows(awkward, nothing, model):
    rows = language.identify(awkward, model).collect()
    assert len(rows) == 10
    for r in rows:
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.languages
    assert language.identify(nothing, model).count() == 0
    unlearned = language.train_on_folds(nothing)
    assert {r.lang_pred for r in language.identify(awkward, unlearned).collect()} == {"und"}


def test_draw_with_repeated_and_missing_identifiers(spark):
    """Rows of one identifier, or of none, are drawn text by text; every language keeps a text, and the sample stays near its bound."""
    words = {"en": ["hello", "world", "are", "you"], "ru": ["привет", "мир", "как", "дела"]}
    rng = np.random.default_rng(2)
    texts = {k: [" ".join(rng.choice(w, 6)) + f" {k}{i}" for i in range(600)] for k, w in words.items()}
    for ids in (lambda i: 7, lambda i: None):
        rows = [(ids(i), x, k) for k, own in texts.items() for i, x in enumerate(own)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = language.train(df, docs_per_language=60)
        letters = np.expm1(model.scores[0][:-1].astype(float))
        assert model.languages == ["en", "ru"] and len(letters) > 20  # letters of both scripts were learned
        assert [x[0] for x in language.Labeller(model).languages(["hello you", "привет мир"])] == ["en", "ru"]
    one = spark.createDataFrame([(1, "hello world", "en")] * 500 + [(2, "привет мир", "ru")] * 500, "doc_id long, text string, lang string")
    assert [x[0] for x in language.Labeller(language.train(one, docs_per_language=1)).languages(["hello", "мир"])] == ["en", "ru"]


def test_words_are_told_apart_by_arrow(model, monkeypatch):
    """Each distinct word is scored once, in order of first occurrence, however many words a part holds."""
    asked, plain = [], language.LanguageModel.words
    monkeypatch.setattr(language.LanguageModel, "words", lambda self, words, *how: asked.append(words) or plain(self, words, *how))
    texts = ["Der Hund und der Hund", "", "und\x1cdie Katze", "é " * 25_000]
    found = language.Labeller(model).languages(texts)
    assert asked == [["é", "der", "hund", "und", "die", "katze"]] and [language.Labeller(model).languages([t])[0] for t in texts] == found
