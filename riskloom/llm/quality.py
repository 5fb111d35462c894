"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text's terms are its byte pairs (of 64 classes: single lower-case letters, upper case, digits, each ASCII mark, blanks, line
ends, the rest) and its word pairs: two words one to three places apart, lower-cased, by their hashes' difference in bits, in
1024 buckets. So unordered pairs share a bucket, and so do all pairs of equal words. Terms weigh the root of their count times
their inverse document frequency; a text's weights, of unit length, are projected on the leading singular vectors of a sample of
at most `sample` labelled documents (the first by a hash of their doc_id; a documented bound on what the driver fits and what is
broadcast). Every text's vector is multiplied with all labelled vectors, in blocks; the `neighbours` of largest cosine, and all
that tie with the last of them, vote with their label, weighted by a power of the cosine.

Cases: a null or empty text has no terms and gets the labelled share of label 1. Very long texts count whole. Conflicting labels
of one document count by their rounded mean; null labels are left out; a model without any label scores 0.5. Of rows that share
a labelled doc_id, the model learns from one, the text of smallest hash. Repeated rows get equal results; null identifiers and
extra columns stay as they are, whatever they are called, but for those that the results replace; an empty table gives no rows.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import in_training_folds, named, release, slices, unused

CLASSES = 64
PAIRS = CLASSES * CLASSES
WORD_PAIRS = 1024
REACH = 3
FIT_BLOCK = 256
TERMS = PAIRS + WORD_PAIRS


def _class_table() -> np.ndarray:
    table = np.full(256, 63, np.int32)
    for i, c in enumerate(string.ascii_lowercase):
        table[ord(c)] = i
    for c in string.ascii_uppercase:
        table[ord(c)] = 26
    for c in string.digits:
        table[ord(c)] = 27
    for i, c in enumerate(string.punctuation):
        table[ord(c)] = 31 + i
    table[[9, 11, 12, 13]] = 30
    table[ord(" ")], table[ord("\n")] = 28, 29
    return table


_TABLE = _class_table()


def term_counts(data: bytes) -> np.ndarray:
    """Counts of byte pairs, then of word pairs by bucket."""
    counts = np.zeros(TERMS, np.float32)
    if data:
        classes = _TABLE[np.frombuffer(data, np.uint8)]
        counts[:PAIRS] = np.bincount(classes[:-1] * CLASSES + classes[1:], minlength=PAIRS)
        words = np.fromiter(map(zlib.crc32, data.lower().split()), np.uint64)
        for apart in range(1, REACH + 1):
            # multiplied, as the low bits of two checksums' difference alone would hold less than all of it
            mixed = (words[:-apart] ^ words[apart:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)
            counts[PAIRS:] += np.bincount(mixed.astype(np.int64), minlength=WORD_PAIRS)
    return counts


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


@dataclass
class NeighbourModel:
    idf: np.ndarray
    projection: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled x dimensions, of unit length
    labels: np.ndarray
    neighbours: int
    power: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit((np.sqrt(counts) * self.idf) @ self.projection)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosines = self.embed(counts) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        last = np.partition(cosines, -k, axis=1)[:, -k]
        row, near = np.nonzero(cosines >= last[:, None] - 1e-6)
        weights = np.clip(cosines[row, near], 0, None).astype(float) ** self.power
        total = np.bincount(row, weights, len(counts))
        votes = np.bincount(row, weights * self.labels[near], len(counts)) / np.where(total > 0, total, 1)
        known = (total > 0) & counts.any(axis=1)
        return np.clip(np.where(known, votes, self.labels.mean()), 0, 1)


def _sparse_terms(df: DataFrame) -> DataFrame:
    """doc_id, hash, label and a text's terms as (places, counts) in bytes."""

    def work(batches):
        for batch in slices(batches):
            counts = [term_counts(x or b"") for x in batch.column("_text").to_pylist()]
            places = [np.flatnonzero(x) for x in counts]
            terms = [pa.array([p.astype("<u2").tobytes() for p in places], pa.binary()), pa.array([c[p].astype("<f4").tobytes() for c, p in zip(counts, places)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "hash", "label")), *terms], names=["doc_id", "hash", "label", "places", "counts"])

    return df.mapInArrow(work, "doc_id long, hash long, label int, places binary, counts binary")


def fit(documents: DataFrame, labels: DataFrame, sample: int = 6000, dimensions: int = 48, neighbours: int = 15, power: float = 8.0, text: str = "text") -> NeighbourModel:
    """labels: doc_id, label (0 or 1)."""
    one_each = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    chosen = one_each.select(F.col("doc_id").cast("long").alias("doc_id"), "label").orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(sample)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), named(text).cast("binary").alias("_text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    terms = _sparse_terms(texts.select("doc_id", F.xxhash64("_text").alias("hash"), "label", "_text"))
    one = F.min_by(F.struct("label", "places", "counts"), F.struct("hash", "places", "counts"))
    rows = [r.one for r in terms.groupBy("doc_id").agg(one.alias("one")).collect()]  # a row per chosen identifier
    if not rows:
        return NeighbourModel(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours, power)
    rows.sort(key=lambda r: (r.places, r.counts, r.label))
    documents_of = np.bincount(np.concatenate([np.frombuffer(r.places, "<u2") for r in rows]), minlength=TERMS)
    idf = np.log((1 + len(rows)) / (1 + documents_of)).astype(np.float32) + np.float32(1)

    def weighted():
        """The sample's weights, some hundred rows at a time: the driver never holds all of them."""
        for a in range(0, len(rows), FIT_BLOCK):
            dense = np.zeros((len(rows[a : a + FIT_BLOCK]), TERMS), np.float32)
            for x, r in zip(dense, rows[a : a + FIT_BLOCK]):
                x[np.frombuffer(r.places, "<u2")] = np.sqrt(np.frombuffer(r.counts, "<f4"))
            dense *= idf
            yield dense / np.maximum(np.sqrt(np.einsum("ij,ij->i", dense, dense)), 1e-12)[:, None]

    # leading right singular vectors by subspace iteration
    basis = np.random.default_rng(0).standard_normal((TERMS, min(dimensions + 16, len(rows)))).astype(np.float32)
    for _ in range(5):
        basis = np.linalg.qr(sum(x.T @ (x @ basis) for x in weighted()))[0]
    _, sizes, right = np.linalg.svd(np.concatenate([x @ basis for x in weighted()]), full_matrices=False)
    projection = (basis @ right[:dimensions].T).astype(np.float32)
    return NeighbourModel(idf, projection, _unit(np.concatenate([x @ projection for x in weighted()])), np.array([r.label for r in rows], float), neighbours, power)


def classify(df: DataFrame, model: NeighbourModel, text: str = "text", block: int = 128, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the score and the predicted label; columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kept = [c for c in df.columns if c not in into]
    column = unused("_text", df.columns)

    def work(batches):
        release()
        for batch in slices(batches, block, text=column):
            scores = shared.value.score(np.stack([term_counts(x or b"") for x in batch.column(column).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*kept, *into])

    columns = list(map(named, kept))
    schema = df.select(*columns, F.lit(0.0).alias(into[0]), F.lit(0).alias(into[1])).schema
    return df.select(*columns, named(text).cast("binary").alias(column)).mapInArrow(work, schema)


def fit_on_folds(documents: DataFrame, labels: DataFrame, **how) -> NeighbourModel:
    """Learns from labels outside the held-out fold."""
    known = labels.where(in_training_folds(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    return fit(documents, known, **how)
