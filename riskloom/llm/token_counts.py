"""Word-piece token counts by a linear longest-match automaton.

Greedy longest-match word pieces are counted, never built: a trie of the vocabulary has, per node, a failure link and
the number of pieces that following this link pops. A word's bytes are read once. The counts of words met before are
remembered per worker, so the automaton runs on new words only.

Vocabulary: pieces that start a word and pieces that go on within it (of the public 32k sentence-piece file those with
and without the word mark; a bare mark is a piece that stands for a word's start). A word is a run of anything but ASCII
blanks. A word that the vocabulary cannot cover counts as one unknown token.

Cases: null and empty texts count 0; very long texts and words are read whole; rows are taken one by one, so repeated rows and
null identifiers stay as they are, and so do extra columns, whatever they are called, but for those that the results replace;
an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Remembered, named, slices, unused

MARK = "▁"


def load_pieces(model_file: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class LongestMatch:
    """count(word) -> number of pieces, or -1 if the word cannot be covered."""

    START, WITHIN = 0, 1

    def __init__(self, pieces: list[str]):
        self.next: list[dict[int, int]] = [{}, {}]
        piece_ends = [False, False]
        for piece in pieces:
            starts = piece.startswith(MARK)
            rest = piece[1:] if starts else piece
            if MARK in rest or (not rest and not starts):
                continue  # no word holds the mark
            node = self.START if starts else self.WITHIN
            for byte in rest.encode():
                child = self.next[node].get(byte)
                if child is None:
                    child = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    piece_ends.append(False)
                node = child
            piece_ends[node] = True
        #: Where to go on, and how many pieces that pops, when a byte has no edge; -1: the word can't be covered.
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        if piece_ends[self.START]:
            self.fail[self.START], self.pops[self.START] = self.WITHIN, 1
        queue = deque([self.START, self.WITHIN])
        while queue:
            node = queue.popleft()
            for byte, child in self.next[node].items():
                if piece_ends[child]:
                    self.fail[child], self.pops[child] = self.WITHIN, 1
                else:
                    at, popped = self.fail[node], self.pops[node]
                    while at >= 0 and byte not in self.next[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.pops[child] = self.next[at][byte], popped
                queue.append(child)

    def count(self, word: bytes) -> int:
        edges, fail, pops = self.next, self.fail, self.pops
        at, n = self.START, 0
        for byte in word:
            while byte not in edges[at]:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return -1
            at = edges[at][byte]
        while at != self.WITHIN:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return -1
        return n


@lru_cache(maxsize=1)
def _worker_counts(model_file: str) -> Remembered:
    """The worker's own automaton and the counts of words it met: both outlive a task, as the worker does."""
    return Remembered(LongestMatch(load_pieces(model_file)).count)


def count_tokens(df: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """Adds n_words, n_tokens (unknown words count 1) and n_unknown, in the place of text. The vocabulary file is read by each worker and must lie at the same path everywhere."""
    new = ["n_words", "n_tokens", "n_unknown"]
    rest = [x for x in df.columns if x not in (text, *new)]
    column = unused("_text", df.columns)

    def work(batches):
        counts = _worker_counts(model_file)
        for batch in slices(batches, text=column):
            words, tokens, unknown = [], [], []
            for data in batch.column(column).to_pylist():
                each = list(map(counts.__getitem__, (data or b"").split()))
                bad = each.count(-1)
                words.append(len(each))
                unknown.append(bad)
                tokens.append(sum(each) + 2 * bad)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=[*rest, *new])

    columns = list(map(named, rest))
    schema = df.select(*columns, *(F.lit(0).cast("long").alias(x) for x in new)).schema
    return df.select(*columns, named(text).cast("binary").alias(column)).mapInArrow(work, schema)
