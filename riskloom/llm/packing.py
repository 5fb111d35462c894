"""Packing token ids into sequences by Karmarkar-Karp multiway differencing.

Each input partition is read as a stream. A document's full sequences of `capacity` ids stand alone. Its remainder is cut
into even pieces of at most `piece` ids, which gather in a pool of at most `windows` sequences' ids; a piece that crosses the
pool's limit is cut there. A full pool is dealt by differencing: partial partitions are merged, the fullest window of one
onto the emptiest of another, the two of largest spread first. If a window exceeds the capacity, the deal is made again
with one window more. A pool's limit leaves a small share of `slack`, so one window more is seldom needed. Memory is one
pool per task, whatever the corpus; there is no shuffle, and a lost task packs the same pieces again.

Cases: a null or empty text has only its end id and is packed as such; very long texts are read whole, their full sequences one
by one; repeated rows are packed each on its own; only doc_id and the text are read, so extra columns may have any name; an empty
table gives no rows. Sequence ids are unique (partition, then number within it), not dense; they, and where a document is cut,
depend on how the input's files are split.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import slices
from riskloom.llm.tokenizing import ID_TYPE, word_encoder

CAPACITY = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Positions of `sizes` dealt to `windows` windows of near-equal sums.

    A partial partition is its sums, falling, and the bag of each window. A bag is a position, or a pair of bags once two met.
    """
    if not sizes:
        return [[] for _ in range(windows)]
    heap = []
    for i, size in enumerate(sizes):
        sums, bags = np.zeros(windows, np.int64), np.full(windows, -1)
        sums[0], bags[0] = size, i
        heap.append((-size, i, sums, bags))
    heapq.heapify(heap)
    pairs: list[tuple[int, int]] = [(-1, -1)] * len(sizes)
    while len(heap) > 1:
        _, i, sums, bags = heapq.heappop(heap)
        _, j, others, more = heapq.heappop(heap)
        merged, more = sums + others[::-1], more[::-1]  # the fullest meets the emptiest
        both = np.flatnonzero((bags >= 0) & (more >= 0))
        bags_now = np.maximum(bags, more)
        bags_now[both] = np.arange(len(pairs), len(pairs) + len(both))
        pairs += zip(bags[both].tolist(), more[both].tolist())
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        heapq.heappush(heap, (int(merged[-1] - merged[0]), min(i, j), merged, bags_now[order]))
    dealt = []
    for top in heap[0][3].tolist():
        members, open_ = [], [top] if top >= 0 else []
        while open_:
            bag = open_.pop()
            if bag < len(sizes):
                members.append(bag)
            else:
                open_ += pairs[bag]
        dealt.append(members)
    return dealt


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few windows as hold all sizes, each of `capacity` at most, found by raising the window count."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, windows)
        if all(sum(sizes[i] for i in window) <= capacity for window in dealt):
            return [window for window in dealt if window]
        windows += 1


class Packer:
    """Takes (doc_id, ids) and gives rows of SCHEMA with the ids of each piece."""

    def __init__(self, capacity: int, piece: int, windows: int, slack: float, first_sequence: int):
        self.capacity, self.piece, self.sequence = capacity, piece, first_sequence
        self.limit = windows * capacity - int(windows * capacity * slack)
        self.pool: list[tuple] = []
        self.held = 0

    def _row(self, doc_id, ids, start, length, offset) -> tuple:
        part = ids[start : start + length]
        return (doc_id, start, length, zlib.crc32(part.astype(ID_TYPE).tobytes()), len(ids), self.sequence, offset, part)

    def add(self, doc_id, ids: np.ndarray):
        start = 0
        while len(ids) - start >= self.capacity:
            yield self._row(doc_id, ids, start, self.capacity, 0)
            self.sequence += 1
            start += self.capacity
        cuts = max(1, -(-(len(ids) - start) // self.piece))
        even = -(-(len(ids) - start) // cuts)  # pieces of many sizes balance better than many of one size
        while start < len(ids):
            length = min(even, len(ids) - start, self.limit - self.held)
            self.pool.append((doc_id, ids, start, length))
            self.held += length
            start += length
            if self.held >= self.limit:
                yield from self.flush()

    def flush(self):
        for window in deal([x[3] for x in self.pool], self.capacity) if self.pool else []:
            offset = 0
            for i in sorted(window):
                doc_id, ids, start, length = self.pool[i]
                yield self._row(doc_id, ids, start, length, offset)
                offset += length
            self.sequence += 1
        self.pool, self.held = [], 0


def pack(
    df: DataFrame, tokenizer_file: str, end_id: int, text: str = "text", capacity: int = CAPACITY, piece: int = 384, windows: int = 128, slack: float = 0.002, with_ids: bool = False
) -> DataFrame:
    """Rows of SCHEMA, one per piece; with_ids adds `ids array<int>`. The tokenizer's file must lie at the same path on every worker."""

    def work(batches):
        encoder = word_encoder(tokenizer_file)
        packer = Packer(capacity, piece, windows, slack, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], ID_TYPE)

        def batch_of(rows):
            columns = list(zip(*rows))
            arrays = [pa.array(x, pa.int64()) for x in columns[:7]]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        rows = []
        for batch in slices(batches):
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist()):
                rows += packer.add(doc_id, np.concatenate([encoder.encode(data or b""), end]))
                if len(rows) >= 2000:
                    yield batch_of(rows)
                    rows = []
        rows += packer.flush()
        if rows:
            yield batch_of(rows)

    names = [x.split(" ")[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text")).mapInArrow(work, SCHEMA + ", ids array<int>" * with_ids)
