"""Token ids of whole texts by a public tokenizer, one blank-separated word at a time.

The tokenizer of `word_bpe_49k.json` drops blanks and never looks across them, so the ids of a text are those of its
words in a row. Each worker remembers the ids of words it has met; the library encodes new ones. Upper-case ASCII letters
are lowered first (the tokenizer does so too, which makes more words equal), unless the text holds a special token's
opening or is not in normal form C, before or after lowering.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np

from riskloom.llm.common import Remembered, kept_by_worker

ID_TYPE = np.dtype("<u4")
_ENCODERS: dict[str, WordEncoder] = kept_by_worker()

#: Words of printable ASCII and Latin-1 letters are split here as the tokenizer's own pattern splits them.
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall


def _byte_marks() -> dict[int, str]:
    """Byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for the code points from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_MARKS = _byte_marks()


class WordEncoder:
    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.words = Remembered(self._word)

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if _PLAIN(text):
            pieces = _PIECES(text.lower())
            if not text.isascii():
                pieces = ["".join([_MARKS[b] for b in piece.encode()]) for piece in pieces]
        else:
            text = self.tokenizer.normalizer.normalize_str(text)
            pieces = [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return array("I", [token.id for piece in pieces for token in self.model.tokenize(piece)]).tobytes()

    def encode(self, data: bytes) -> np.ndarray:
        """Ids of a text in UTF-8."""
        if b"<|" not in data:
            lowered = data.lower()
            if data.isascii() or (unicodedata.is_normalized("NFC", data.decode()) and unicodedata.is_normalized("NFC", lowered.decode())):
                data = lowered
        return np.frombuffer(b"".join(map(self.words.__getitem__, data.split())), ID_TYPE)


def word_encoder(tokenizer_file: str) -> WordEncoder:
    """The worker's own encoder: it outlives a task, as the worker does."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = WordEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]
