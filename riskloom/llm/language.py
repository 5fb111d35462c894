"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Training counts letter 1- to 3-grams of words in Spark, over a sample of about `docs_per_language` whole texts of each
language, chosen by a hash: that parameter bounds the labelled rows learned from, and every gram of the sample counts. A
word's score for a language is the mean over gram orders of its grams' log-probabilities; languages that do not use the
script of a run of letters are no candidates for it. Viterbi's path over a text's words pays `switch_penalty` for each
change of language, so spans come out whole and lone odd words do not. In a task, texts of a bounded number of bytes go
together: their distinct words are scored at once, and their paths advance together, one word at a time, in numpy.

A text's language is the one with most letters in its spans (ties: by name); its score is that language's share of the
letters, counting only letters in a script that some language uses. `known` is the share of letters in such scripts, whatever
their language: a clean text in three languages scores low and is known all the same.

Cases: null texts and texts without a letter are `und` with score 0. Texts whose letters are all in unlearned scripts get the
first language, with score 0. Very long texts are read whole; one longer than a part's bytes makes a part of its own. A model
that learned from nothing calls every text `und`; an empty table gives no rows; repeated rows and null identifiers stay as
they are, and so do extra columns, whatever they are called, but for those that the results replace.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import in_training_folds, named, release, slices, unused

UNDETERMINED = "und"

#: First and last code point of blocks of letters, by script.
SCRIPT_RANGES = [
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0B80, 0x0BFF, "Tamil"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0x20000, 0x2FA1F, "Han"),
]
_FIRSTS = np.array([x[0] for x in SCRIPT_RANGES])
_LASTS = np.array([x[1] for x in SCRIPT_RANGES])
OTHER = "Other"
#: What stands for a run's ends in grams of two and three; neither is a letter.
START, END = ord("^"), ord("$")


def range_of(codes: np.ndarray) -> np.ndarray:
    """Position in SCRIPT_RANGES of each code point, -1 outside of all."""
    k = np.searchsorted(_FIRSTS, codes, "right") - 1
    return np.where((k >= 0) & (codes <= _LASTS[k]), k, -1)


def script_of(letter: str) -> str:
    k = int(range_of(np.array([ord(letter)]))[0])
    return SCRIPT_RANGES[k][2] if k >= 0 else OTHER


@cache
def _letter_kinds() -> np.ndarray:
    """Per code point: 0 no part of a run, 1 part of a run (a word character, but no digit and no underscore), 3 also a letter."""
    return np.fromiter((2 * c.isalpha() + (c.isalnum() and not c.isdecimal()) for c in map(chr, range(0x110000))), np.uint8, 0x110000)


def gram_key(gram: str) -> int:
    """A gram of one to three code points as 64 bits; its order is not part of it."""
    key = 0
    for c in gram:
        key = key << 21 | ord(c)
    return key


def _keys(*codes: np.ndarray) -> np.ndarray:
    key = codes[0].astype(np.int64)
    for x in codes[1:]:
        key = (key << 21) | x
    return key


@dataclass
class LanguageModel:
    languages: list[str]
    keys: list[np.ndarray]  # per order 1 to 3: its grams' keys, rising
    scores: list[np.ndarray]  # per order: (grams + 1) x languages; the last row, zeros, is for unknown grams
    scripts: dict[str, np.ndarray] = field(default_factory=dict)  # of a script: 0 for languages that use it, else a large negative score
    switch_penalty: float = 8.0

    def _found(self, order: int, keys: np.ndarray) -> np.ndarray:
        known = self.keys[order - 1]
        if not len(known):
            return self.scores[order - 1][np.zeros(len(keys), np.int64)]
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return self.scores[order - 1][np.where(known[place] == keys, place, len(known))]

    def words(self, words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Per word: a score for each language; number of letters and number of those in runs of a known script."""
        parts = [self._words(words[i : i + at_once]) for i in range(0, max(1, len(words)), at_once)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        total, counts = np.zeros((len(words), len(self.languages)), np.float32), np.zeros((len(words), 2), np.int64)
        codes = np.frombuffer("\n".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _letter_kinds()[codes]
        at = np.flatnonzero(kinds & 1)
        if not len(at):
            return total, counts
        word = (np.cumsum(codes == 10) - 1)[at]
        own, before, after = codes[at], codes[at - 1], codes[at + 1]
        first, last = (kinds[at - 1] & 1) == 0, (kinds[at + 1] & 1) == 0
        before, after = np.where(first, START, before), np.where(last, END, after)
        score = self._found(1, own.astype(np.int64)) + self._found(2, _keys(before, own)) + self._found(3, _keys(before, own, after))
        score[last] += self._found(2, _keys(own[last], np.full(int(last.sum()), END)))
        # runs, narrowed by the script of their first letter
        starts = np.flatnonzero(first)
        runs, letters = np.add.reduceat(score, starts) / 3, np.add.reduceat(kinds[at] >> 1, starts, dtype=np.int64)
        narrowings = np.stack([self.scripts.get(x, np.full(len(self.languages), np.nan, np.float32)) for x in [*(x[2] for x in SCRIPT_RANGES), OTHER]])
        narrowed = narrowings[range_of(own[starts])]
        unknown = np.isnan(narrowed[:, 0])
        runs = np.where(unknown[:, None], 0, runs + np.nan_to_num(narrowed))
        # words of at least one run
        of_run = word[starts]
        heads = np.flatnonzero(np.r_[True, of_run[1:] != of_run[:-1]])
        total[of_run[heads]] = np.add.reduceat(runs, heads)
        counts[of_run[heads]] = np.stack([np.add.reduceat(letters, heads), np.add.reduceat(np.where(unknown, 0, letters), heads)], axis=1)
        return total, counts


def train(labelled: DataFrame, docs_per_language: int = 1500, switch_penalty: float = 8.0) -> LanguageModel:
    """labelled: doc_id, text, lang."""
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    labelled = labelled.withColumn("chance", chance)
    counts = {r.lang: r for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("chance").alias("least")).collect()}
    languages = sorted(counts, key=lambda x: x.encode())
    if not counts:
        return LanguageModel([], [np.zeros(0, np.int64)] * 3, [np.zeros((1, 0), np.float32)] * 3, {}, switch_penalty)
    rates = labelled.sparkSession.createDataFrame([(k, docs_per_language / r.n, r.least) for k, r in counts.items()], "lang string, rate double, least double")
    sample = labelled.join(F.broadcast(rates), "lang").where("chance < rate OR chance = least")  # a row per language; every language keeps a text
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    edged = F.concat(F.lit("^"), "word", F.lit("$"))
    pieces = lambda s, k: F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))
    grams = (
        words.select("lang", "n", F.explode(F.concat(pieces(F.col("word"), 1), pieces(edged, 2), pieces(edged, 3))).alias("gram"))
        .groupBy("gram", "lang")
        .agg(F.sum("n").alias("n"))
        .groupBy("gram")
        .agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))  # a row per language at most
        .collect()  # the grams of the bounded sample
    )
    keys, scores, letters = [], [], {}
    for order in (1, 2, 3):
        own = sorted((gram_key(r.gram), r.by) for r in grams if len(r.gram) == order)
        table = np.array([[by.get(x, 0) for x in languages] for _, by in own], float).reshape(len(own), len(languages))
        smoothed = table + 0.5
        keys.append(np.array([k for k, _ in own], np.int64))
        scores.append(np.concatenate([np.log(smoothed / smoothed.sum(axis=0)), np.zeros((1, len(languages)))]).astype(np.float32))
        if order == 1:
            for (key, _), row in zip(own, table):
                letters[script_of(chr(key))] = letters.get(script_of(chr(key)), 0) + row
    total = np.maximum(sum(letters.values()), 1) if letters else 1
    uses = {k: v / total >= 0.01 for k, v in letters.items()}
    scripts = {k: np.where(v, 0, -50).astype(np.float32) for k, v in uses.items() if v.any()}
    return LanguageModel(languages, keys, scores, scripts, switch_penalty)


def best_paths(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi labels of texts laid end to end: scores is words x languages, lengths the words of each text."""
    n_labels = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    sizes, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
    back = np.empty((len(scores), n_labels), np.int8 if n_labels <= 127 else np.int32)
    value, own = np.zeros((len(sizes), n_labels), np.float32), np.arange(n_labels)
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")  # texts longer than t
    for t, n in enumerate(active):
        at, v = starts[:n] + t, value[:n]
        best = v.argmax(axis=1)
        moved = (v[np.arange(n), best] - np.float32(penalty))[:, None]
        stay = v >= moved
        back[at] = np.where(stay, own, best[:, None])
        value[:n] = np.where(stay, v, moved) + scores[at]
    labels, now = np.empty(len(scores), np.int32), value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return labels


class Labeller:
    """Texts to scored and labelled words. Holds nothing between calls."""

    def __init__(self, model: LanguageModel, words_at_once: int = 1_000_000):
        self.model = model
        self.most = max(20_000, words_at_once * 4 // max(4, len(model.languages)))

    def label(self, texts: list[str]):
        """For chunks of texts, longest texts together: their positions, numbers of words, and per word label, letters and known letters."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        while order:
            held, parts, sizes, n, k = [], [], [], 0, 0
            while k < len(order) and n < self.most:
                words = texts[order[k]].lower().split()
                held += words
                n += len(words)
                sizes.append(len(words))
                k += 1
                if len(held) >= 20_000:
                    parts.append(pa.array(held, pa.large_string()))
                    held = []
            chunk, order, lengths = order[:k], order[k:], np.array(sizes)
            parts = pa.chunked_array([*parts, pa.array(held, pa.large_string())]).combine_chunks().dictionary_encode()  # distinct words by first occurrence
            scores, counts = self.model.words(parts.dictionary.to_pylist())
            own = parts.indices.to_numpy()
            del held, parts, words
            yield chunk, lengths, best_paths(scores[own], lengths, self.model.switch_penalty), counts[own]

    def languages(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """Language, its share of the letters, and the share of letters in known scripts."""
        width, found = len(self.model.languages), [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        if not width:
            return found
        for chunk, lengths, labels, counts in self.label(texts):
            text_of = np.repeat(np.arange(len(chunk)), lengths)
            by = np.bincount(text_of * width + labels, counts[:, 1], len(chunk) * width).reshape(-1, width)
            letters = np.bincount(text_of, counts[:, 0], len(chunk))
            for i, row, n in zip(chunk, by, letters):
                if n:
                    k = int(row.argmax())
                    found[i] = (self.model.languages[k], float(row[k] / n), float(row.sum() / n))
        return found

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(first word, one past the last, language) per text."""
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not self.model.languages:
            return found
        for chunk, lengths, labels, _ in self.label(texts):
            at = 0
            for i, n in zip(chunk, lengths):
                own = labels[at : at + n]
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), int(n)] if n else []
                found[i] = [(a, b, self.model.languages[own[a]]) for a, b in zip(cuts, cuts[1:])]
                at += n
        return found


def _map_texts(df: DataFrame, text: str, model: LanguageModel, work, new: list[tuple[str, str]]) -> DataFrame:
    """Keeps all columns of df and adds those that work(labeller, texts) gives as Arrow arrays."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it learned from
    added = [x for x, _ in new]
    kept = [c for c in df.columns if c not in added]
    column = unused("_text", df.columns)

    def run(batches):
        release()
        labeller = Labeller(shared.value)
        for batch in slices(batches, 10_000, text=column):
            texts = [x or "" for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *work(labeller, texts)], names=[*kept, *added])

    columns = [named(c) for c in kept]
    schema = df.select(*columns, *(F.lit(None).cast(kind).alias(x) for x, kind in new)).schema
    return df.select(*columns, named(text).alias(column)).mapInArrow(run, schema)


def identify(df: DataFrame, model: LanguageModel, text: str = "text", into: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its score, and the known share too if `into` has a third name; columns of these names are replaced."""
    kinds = ["string", "double", "double"]

    def work(labeller, texts):
        columns = list(zip(*labeller.languages(texts))) if texts else [()] * 3
        return [pa.array(x, pa.string() if kind == "string" else pa.float64()) for x, kind, _ in zip(columns, kinds, into)]

    return _map_texts(df, text, model, work, list(zip(into, kinds)))


def language_spans(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds spans, an array of (first word, one past the last, language)."""

    def work(labeller, texts):
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))
        return [pa.array([[{"first": a, "last": b, "lang": x} for a, b, x in each] for each in labeller.spans(texts)], kind)]

    return _map_texts(df, text, model, work, [("spans", "array<struct<first:long,last:long,lang:string>>")])


def train_on_folds(documents: DataFrame, **how) -> LanguageModel:
    """Learns from documents outside the held-out fold."""
    return train(documents.where(in_training_folds(F.col("doc_id"))), **how)
