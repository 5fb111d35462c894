"""Target-distribution importance resampling by external sort-count.

Documents that look like the target are drawn more often. A text's features are its runs of 1 to `order` words, hashed to
`buckets` buckets. Three passes, each over what the one before has written to the shared folder:

1. streams   a task writes the buckets of its documents as packed 16-bit numbers, many documents a row, with each document's
             offset in its row. Two bytes a feature: texts are read once.
2. counts    each stream is sorted and run-length encoded, a task's runs are merged, and Spark adds up the runs of all tasks:
             at most `buckets` rows a task reach the shuffle, and `buckets` rows the driver. The target's texts go the same way.
             A bucket's gain is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))).
3. scores    gains are gathered along each stream and summed by document with np.add.reduceat. A document's weight is the floored
             mean; its score adds Gumbel noise from a hash of its identifier, so the highest scores are a sample without
             replacement whose odds are the weights.

The draw is exact for any number of rows: scores are counted in steps of 64 (a few thousand of them, as gains and noise are
logarithms of 64-bit numbers), only rows from the step that holds the last drawn place are ranked, in slices of the order whose
counts are added to the slices after them. No task sorts more than its own slices.

Cases: null texts have no words. Documents without words weigh 0. Very long texts make a row of their own. A null doc_id counts as
empty text in the hash and comes after all others in ties. Repeated rows tie and are each drawn for themselves. An empty table
gives no rows; an empty target leaves every gain to the corpus alone. Only doc_id and text are read, so extra columns may have
any name.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ordering import global_rank
from riskloom.llm.common import Remembered, named, removed, shared_path, slices, written

#: Runs of ASCII digits, lower-case letters and bytes of other characters: what is left of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in UTF-8.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
STEP = 64


class Buckets:
    """Buckets of a text's features."""

    def __init__(self, order: int, buckets: int):
        if not 1 <= buckets <= 1 << 16:
            raise ValueError("buckets have to fit 16 bits")
        self.order, self.buckets = order, buckets
        self.known = Remembered(lambda feature: zlib.crc32(feature) % buckets)

    def __call__(self, text: bytes) -> np.ndarray:
        words = _WORDS(text.lower())
        found = list(map(self.known.__getitem__, words))
        for n in range(2, self.order + 1):
            found += [self.known[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
        return np.array(found, "<u2")


def write_streams(df: DataFrame, path: str, key: str, text: str = "text", order: int = 1, buckets: int = 10_000) -> DataFrame:
    """Rows ids, words, offsets (each document's start), stream (2 bytes a feature): the documents of one slice of a task."""

    def work(batches):
        bucket_of = Buckets(order, buckets)
        for batch in slices(batches):
            ids, parts = batch.column("_id"), [bucket_of(x or b"") for x in batch.column("_text").to_pylist()]
            lengths = np.array([len(x) for x in parts], np.int64)
            offsets = np.cumsum(lengths) - lengths
            listed = lambda x, kind: pa.array([x], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [listed(ids.to_pylist(), pa.int64()), listed(offsets, pa.int64()), pa.array([np.concatenate(parts).tobytes()], pa.binary())],
                names=["ids", "offsets", "stream"],
            )

    rows = df.select(F.col(key).cast("long").alias("_id"), named(text).cast("binary").alias("_text"))
    return written(rows.mapInArrow(work, "ids array<long>, offsets array<long>, stream binary"), path)


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts of a stream: sorted, then run-length encoded."""
    ordered = np.sort(stream)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return ordered[starts], np.diff(np.r_[starts, len(ordered)])


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, counts = (np.concatenate(x) for x in zip(*runs))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[starts], np.add.reduceat(counts, starts)


def bucket_counts(streams: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs: at most `buckets` rows a task are shuffled, and come to the driver."""

    def work(batches):
        runs = [(np.zeros(0, "<u2"), np.zeros(0, np.int64))]
        for batch in batches:
            for stream in batch.column("stream"):
                runs.append(run_lengths(np.frombuffer(stream.as_py(), "<u2")))
                if len(runs) > 64:
                    runs = [_merged(runs)]
        if any(len(v) for v, _ in runs):
            values, counts = _merged(runs)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32)), pa.array(counts)], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in streams.select("stream").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, s_all, t_all = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(corpus))
    return np.array([math.floor(1000 * math.log(((float(target[b]) + 1) * s_all) / ((float(corpus[b]) + 1) * t_all))) for b in range(n)], np.int64)


def noise_of(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(streams: DataFrame, gains: np.ndarray, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score."""
    shared = streams.sparkSession.sparkContext.broadcast(gains)  # a number a bucket

    def work(batches):
        for batch in batches:
            for ids, offsets, stream in zip(*(batch.column(c) for c in ("ids", "offsets", "stream"))):
                ids, stream = ids.as_py(), np.frombuffer(stream.as_py(), "<u2")
                starts = np.array(offsets.as_py(), np.int64)
                lengths = np.diff(np.r_[starts, len(stream)])
                some = lengths > 0  # reduceat has no empty segments
                weight = np.zeros(len(ids), np.int64)
                if some.any():
                    weight[some] = np.add.reduceat(shared.value[stream], starts[some]) // lengths[some]
                noise = np.array([noise_of(x, seed) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths), pa.array(weight), pa.array(weight + noise)], names=["doc_id", "n_features", "weight", "score"])

    return streams.mapInArrow(work, "doc_id long, n_features long, weight long, score long")


def draw(scored: DataFrame, n_words: str, percent: int = 10, min_words: int = 20) -> DataFrame:
    """Adds rank: 1, 2, ... for the floor(percent %) highest scores of rows with enough words, ties to smaller doc_id; null for the others."""
    enough = F.col(n_words) >= min_words
    steps = scored.where(enough).groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(F.count("*").alias("n")).collect()
    wanted, cut, above = sum(r.n for r in steps) * percent // 100, None, 0
    for r in sorted(steps, key=lambda r: -r.step):
        if above >= wanted:
            break
        cut, above = r.step, above + r.n
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = enough & (F.col("score") >= cut * STEP)
    ranked = global_rank(scored.where(near), -F.col("score"), [F.col("doc_id").asc_nulls_last()], "rank")
    place = F.when(F.col("rank") < wanted, F.col("rank") + 1)
    return ranked.withColumn("rank", place).unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(documents: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024, text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; `target` needs a text column only. With runs of several words, `min_words` counts features."""
    spark = documents.sparkSession
    paths = [shared_path(spark, x) for x in ("bucket-streams", "target-streams", "importance")]
    streams = write_streams(documents, paths[0], "doc_id", text, order, buckets)
    wanted = write_streams(target.withColumn("_none", F.lit(None).cast("long")), paths[1], "_none", text, order, buckets)
    gains = gains_of(bucket_counts(streams, buckets), bucket_counts(wanted, buckets))
    scored = written(scores(streams, gains, seed), paths[2])
    for path in paths[:2]:
        removed(spark, path)
    return draw(scored, "n_features", percent, min_words)


#: The same rows for order 1, 10000 buckets, 10 percent, 20 words and seed 2024. crc32 is DuckDB's to be built: from its table of 256 numbers.
ORACLE_SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS crc
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS MATERIALIZED (
  SELECT r, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM texts
), aims AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark
), hexed AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM words UNION SELECT w FROM aims)
), bucket AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                            lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295) % 10000 AS b FROM hexed, crc_table
), s AS (SELECT b, count(*) AS n FROM words JOIN bucket USING (w) GROUP BY b
), t AS (SELECT b, count(*) AS n FROM aims JOIN bucket USING (w) GROUP BY b
), gain AS (
  SELECT b, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1e0) * ((SELECT count(*) FROM words) + 1e4)) / ((s.n + 1e0) * ((SELECT count(*) FROM aims) + 1e4)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (b)
), means AS (
  SELECT r, count(*) AS n_features, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM words JOIN bucket USING (w) JOIN gain USING (b) GROUP BY r
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM texts LEFT JOIN means USING (r)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM ranked
"""
