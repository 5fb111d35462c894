"""Run-length index of a block of short strings: a run-compressed Burrows-Wheeler transform with sampled run ends.

The strings' suffixes are sorted (each suffix ends with its string; equal ones go by string), and the bytes before them form the
transform. It is kept as runs of equal bytes: where each starts, its byte, and the text positions of its first and last
suffix. Strings that repeat one another give few runs. Matching statistics are streamed from right to left for many patterns
at once: a pattern's state is a row, that row's text position and a match length. If the row's byte is the next byte of the
pattern, a backward step moves on; else the state jumps to the nearer end of a run of that byte, above or below, whichever
shares more with the current suffix, and takes that end's sampled position. All of it is numpy over the patterns.
"""

from __future__ import annotations

import numpy as np

#: Positions of an index this small and two ranks fit one 64-bit word, which sorts several times faster than an index of words.
PLACE = 21


def _ranked(n: int, high: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by high, then low, then position, and the ranks by high and low. Both are below n (high alone: below 2^42)."""
    if n <= 1 << PLACE:
        word = high << PLACE if low is None else (high << PLACE | low) << PLACE
        word |= np.arange(n)
        word.sort()
        order = (word & ((1 << PLACE) - 1)).astype(np.int32)
        word >>= PLACE
    else:
        word = high if low is None else high * (n + 1) + low
        order = np.argsort(word, kind="stable").astype(np.int32)
        word = word[order]
    ranks = np.empty(n, np.int32)
    ranks[order] = np.cumsum(np.r_[False, word[1:] != word[:-1]], dtype=np.int32)
    return order, ranks


class RunIndex:
    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        """data: the strings' bytes in a row; lengths: of each string, none empty."""
        n = len(data) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        #: 0 ends a string; the bytes that occur are 1, 2, ...
        self.code = np.zeros(256, np.int16)
        self.code[np.unique(data)] = np.arange(1, len(np.unique(data)) + 1)
        symbols = np.zeros(n, np.int16)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols[inside] = self.code[data]
        self.n, self.symbols = n, symbols
        #: which string each position is of, and where that ends
        self.string = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
        self.end = ends.astype(np.int32)[self.string]
        bits = int(symbols.max(initial=1)).bit_length()
        width, longest = 2 * PLACE // bits, int(lengths.max(initial=0))
        word, alive = symbols.astype(np.int64), symbols > 0
        for j in range(1, width):
            after = np.zeros(n, np.int64)
            after[:-j] = symbols[j:]
            alive &= after > 0
            word = word << bits | np.where(alive, after, 0)
        #: ranks by the first w, 2w, 4w, ... symbols; they also tell how far two suffixes agree
        rows, ranks = _ranked(n, word)
        self.levels = [(width, ranks)]
        at = np.arange(n)
        while width < longest:
            after = np.minimum(at + width, n - 1)
            second = np.where(at + width < self.end, ranks[after], 0).astype(np.int64)  # rank 0: the empty suffix
            rows, ranks = _ranked(n, ranks.astype(np.int64), second)
            width *= 2
            self.levels.append((width, ranks))
        self.rows = rows  # equal suffixes by string
        before = np.where(rows > 0, symbols[rows - 1], 0)  # a string's first byte stands after the end of another, so after a 0
        starts = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        self.starts, self.heads = starts, before[starts].astype(np.int64)
        self.sizes = np.diff(np.r_[starts, n])
        #: sampled run ends: text positions of the first and the last suffix of each run
        self.first_at, self.last_at = rows[starts].astype(np.int64), rows[starts + self.sizes - 1].astype(np.int64)
        #: directory from rows to runs
        self.run_of = np.repeat(np.arange(len(starts), dtype=np.int32), self.sizes)
        # runs by byte, then by place, and where each run's rows go in a backward step
        self.by_byte = np.argsort(self.heads, kind="stable")
        moved = np.cumsum(self.sizes[self.by_byte]) - self.sizes[self.by_byte]  # bytes in order fill the rows in order
        self.goes_to = np.empty(len(starts), np.int64)
        self.goes_to[self.by_byte] = moved
        self.byte_first = np.searchsorted(self.heads[self.by_byte], np.arange(258))
        self.keys = self.heads[self.by_byte] * (n + 1) + starts[self.by_byte]

    @property
    def runs(self) -> int:
        return len(self.starts)

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at two text positions share: by ranks, then symbol by symbol within the last word."""
        shared, last = np.zeros(len(a), np.int64), self.n - 1
        for width, ranks in reversed(self.levels):
            same = (a + shared < self.end[a]) & (b + shared < self.end[b])
            same &= ranks[np.minimum(a + shared, last)] == ranks[np.minimum(b + shared, last)]
            shared += np.where(same, width, 0)
        shared = np.minimum(shared, np.minimum(self.end[a] - a, self.end[b] - b))
        for _ in range(self.levels[0][0] - 1):
            more = (a + shared < self.end[a]) & (b + shared < self.end[b])
            shared += more & (self.symbols[np.minimum(a + shared, last)] == self.symbols[np.minimum(b + shared, last)])
        return shared

    def match(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of patterns (bytes in a row, and their lengths): for each byte, how long the longest match that starts there is,
        and a row whose suffix starts with it."""
        order = np.argsort(-lengths, kind="stable")
        stops, left = np.cumsum(lengths)[order], lengths[order]
        length, found = np.zeros(len(data), np.int32), np.zeros(len(data), np.int32)
        row, at, size = np.zeros(len(order), np.int64), np.full(len(order), self.first_at[0]), np.zeros(len(order), np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            active = int(np.searchsorted(-left, -step, "right"))  # patterns of at least `step` bytes come first
            place = stops[:active] - step
            byte = self.code[data[place]].astype(np.int64)
            r, q, k = row[:active], at[:active], size[:active]
            run = self.run_of[r].astype(np.int64)
            off = np.flatnonzero((self.heads[run] != byte) | (byte == 0))
            if len(off):
                b = byte[off]
                below = np.searchsorted(self.keys, b * (self.n + 1) + r[off], "right")
                has_up, has_down = (below > self.byte_first[b]) & (b > 0), (below < self.byte_first[b + 1]) & (b > 0)
                up, down = self.by_byte[np.where(has_up, below - 1, 0)], self.by_byte[np.where(has_down, below, 0)]
                up_at, down_at = self.last_at[up], self.first_at[down]
                up_size = np.where(has_up, self.agree(q[off], up_at), -1)
                down_size = np.where(has_down, self.agree(q[off], down_at), -1)
                go_up, lost = up_size >= down_size, ~has_up & ~has_down  # lost: a byte that the strings do not hold
                run[off] = np.where(go_up, up, down)
                r[off], q[off] = np.where(go_up, self.starts[up] + self.sizes[up] - 1, self.starts[down]), np.where(go_up, up_at, down_at)
                k[off] = np.minimum(k[off], np.maximum(up_size, down_size))
            row[:active], at[:active], size[:active] = self.goes_to[run] + (r - self.starts[run]), q - 1, k + 1
            if len(off):
                none = off[lost]
                row[none], at[none], size[none] = 0, self.first_at[0], 0
            length[place], found[place] = size[:active], row[:active]
        return length, found

    def families(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of rows by their first `span` symbols: for each row, the number of its family, and whether its suffix is as long as that."""
        if (self.end - np.arange(self.n)).max(initial=0) < span:
            return np.arange(self.n), np.zeros(self.n, bool)
        width, ranks = next((x for x in reversed(self.levels) if x[0] <= span), (0, None))
        rest = span - width
        if rest > width:
            raise ValueError(f"spans of {span} are not told apart")
        first, second = ranks[self.rows], ranks[np.minimum(self.rows + rest, self.n - 1)]
        whole = self.rows + span <= self.end[self.rows]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | ~whole[1:] | ~whole[:-1]]
        return np.cumsum(new) - 1, whole
