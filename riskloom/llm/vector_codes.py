"""Vector code compression: product codes whose nearest entries are exact.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts. A round assigns every part to the nearest
entry of its codebook and moves each entry to its parts' floored mean. The nearest entry is found in two steps. A float32 matrix
product of a block of parts with all entries screens: |c|^2 - 2 x.c orders the entries, and its float32 error is at most
gamma |x| |c|, gamma = (n + 2) u / (1 - (n + 2) u), u = 2^-24, whatever the order of summing (Cauchy and Schwarz; two roundings
more for the conversion of both factors). Every entry whose interval reaches down to the least upper bound is evaluated again in
int64; the least of these exact distances wins, ties to the lower index. So codes do not depend on the machine's arithmetic.

A round is one pass: a task reads its vectors, assigns them to the broadcast codebooks (entries x dimensions numbers, fixed by
the parameters) and gives one row of integer sums for each part and entry, which Spark adds up. Integer vectors are written once
to the shared folder, so a lost executor costs its tasks only. The driver holds the codebooks, nothing that grows with the rows.

Cases: vectors that are null, empty or hold null or non-finite components are dropped. Rows without vec_id are coded; they come
last where codebooks start. Rows of one vec_id that share the starting rank are ordered by their vector. With fewer vectors than
entries, the codebooks are smaller. Repeated rows get equal codes and each counts. Null labels are one label. Only vec_id,
embedding and label are read, so extra columns may have any name. An empty table gives no rows. Vectors of unequal lengths, of a
length that the parts do not divide, or with components so large that a sum of squares might pass 63 bits raise ValueError.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import removed, shared_path, written

UNIT = 2.0**-24
BLOCK = 2048


@dataclass
class Codebooks:
    """entries[p]: the integer entries of part p, one a row."""

    entries: list[np.ndarray]
    scale: int

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Approximate vectors from rows of part indexes."""
        return np.concatenate([part[codes[:, p]] for p, part in enumerate(self.entries)], axis=1) / self.scale


class NearestEntry:
    """One part's codebook, ready to be searched. Of equal entries only the first can win, so the others are left out."""

    def __init__(self, entries: np.ndarray):
        _, first = np.unique(entries, axis=0, return_index=True)
        self.index = np.sort(first)
        self.entries = entries[self.index]
        self.squares = (self.entries * self.entries).sum(axis=1).astype(float)
        self.lengths = np.sqrt(self.squares) * (1 + 1e-9)
        self.single = np.ascontiguousarray(self.entries.T.astype(np.float32))
        n = (entries.shape[1] + 2) * UNIT
        self.gamma = n / (1 - n)

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals that hold |c|^2 - 2 x.c of every row and entry."""
        products = (rows.astype(np.float32) @ self.single).astype(float)
        lengths = np.sqrt((rows.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)
        middle = self.squares - 2 * products
        # the second term: what doubles lose in squares, products and their difference
        wide = 2 * self.gamma * lengths[:, None] * self.lengths + (self.squares + 2 * np.abs(products)) * 2.0**-50 + 1e-3
        return middle - wide, middle + wide

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the exact squared distance, of integer rows."""
        found, error = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for a in range(0, len(rows), BLOCK):
            part = rows[a : a + BLOCK]
            low, high = self.bounds(part)
            row, entry = np.nonzero(low <= high.min(axis=1)[:, None])  # by row, then by entry
            exact = np.empty(len(row), np.int64)
            for b in range(0, len(row), 1 << 16):
                off = part[row[b : b + (1 << 16)]] - self.entries[entry[b : b + (1 << 16)]]
                exact[b : b + (1 << 16)] = np.einsum("ij,ij->i", off, off)
            starts = np.searchsorted(row, np.arange(len(part)))
            least = np.minimum.reduceat(exact, starts)
            hits = np.flatnonzero(exact == least[row])
            best = hits[np.searchsorted(row[hits], np.arange(len(part)))]  # the first of each row has the lowest index
            found[a : a + BLOCK], error[a : a + BLOCK] = self.index[entry[best]], least
        return found, error


def _searchers(books: Codebooks) -> list[NearestEntry]:
    return [NearestEntry(x) for x in books.entries]


def assign(vectors: np.ndarray, searchers: list[NearestEntry]) -> tuple[np.ndarray, np.ndarray]:
    """Part indexes and squared distances of integer vectors, a column a part."""
    found = [s(np.ascontiguousarray(x)) for s, x in zip(searchers, np.split(vectors, len(searchers), axis=1))]
    return np.stack([f for f, _ in found], axis=1), np.stack([e for _, e in found], axis=1)


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and x (floor(scale * component) as integers) of the vectors that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(whole)
    scaled = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))))  # beyond the range, refused below
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", scaled.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _shape(rows: DataFrame, parts: int) -> int:
    """Length of the vectors, 0 without any. One small row comes to the driver."""
    most = F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))
    least_n, most_n, size = rows.agg(F.min(F.size("x")), F.max(F.size("x")), most).first()
    if least_n is None:
        return 0
    if least_n != most_n or least_n % parts:
        raise ValueError(f"vectors have {least_n} to {most_n} components; all need one length that {parts} divides")
    if 4 * most_n * size * size >= 2**63:
        raise ValueError(f"components reach {size} once scaled: squared distances would pass 63 bits")
    return most_n


def fit(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """rows: as `integer_vectors` gives them, written. None if there are none."""
    spark, dims = rows.sparkSession, _shape(rows, parts)
    if not dims:
        return None
    first = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()  # at most `entries` rows
    start = np.array([r.x for r in first], np.int64)
    books = Codebooks(np.split(start, parts, axis=1), scale)
    width = dims // parts
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)  # entries x dimensions numbers

        def sums(batches, shared=shared):
            searchers = _searchers(shared.value)
            total = [np.zeros((len(x), width), np.int64) for x in shared.value.entries]
            count = [np.zeros(len(x), np.int64) for x in shared.value.entries]
            for batch in batches:
                vectors = _matrix(batch.column("x"))
                found, _ = assign(vectors, searchers)
                for p, part in enumerate(np.split(vectors, parts, axis=1)):
                    order = np.argsort(found[:, p], kind="stable")
                    which, starts, n = np.unique(found[order, p], return_index=True, return_counts=True)
                    if len(which):
                        total[p][which] += np.add.reduceat(part[order], starts, axis=0)
                        count[p][which] += n
            for p in range(parts):
                used = np.flatnonzero(count[p])
                arrays = [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(count[p][used])]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(total[p][used, i]) for i in range(width))], names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

        partial = rows.select("x").mapInArrow(sums, "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(width)))
        moved = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))).collect()  # a row an entry
        after = [x.copy() for x in books.entries]
        for r in moved:
            after[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
        shared.unpersist()
        books = Codebooks(after, scale)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Adds code (two hex digits a part) and error (squared distances of all parts) in place of x."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kept = [c for c in rows.columns if c != "x"]
    schema = rows.select(*kept, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema

    def work(batches):
        searchers = _searchers(shared.value)
        for batch in batches:
            found, error = assign(_matrix(batch.column("x")), searchers)
            data, n = found.astype(np.uint8).tobytes().hex(), 2 * len(searchers)
            codes = [data[i : i + n] for i in range(0, len(data), n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(codes, pa.string()), pa.array(error.sum(axis=1))], names=[*kept, "code", "error"])

    return rows.mapInArrow(work, schema)


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error (summed over rows of one label) and codebooks_sha256 of every vector that takes part."""
    if entries > 256:
        raise ValueError("two hex digits name 256 entries")
    spark, path, coded_path = vectors.sparkSession, shared_path(vectors.sparkSession, "integer-vectors"), shared_path(vectors.sparkSession, "vector-codes")
    rows = written(integer_vectors(vectors, scale), path)
    books = fit(rows, parts, entries, rounds, scale)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(encode(rows, books), coded_path)
    removed(spark, path)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.struct("label").alias("_label"), "label_error")
    # a label may hold any share of the rows: joined by a struct, both sides get exchanges that Spark can split
    joined = coded.withColumn("_label", F.struct("label")).join(totals.hint("merge"), "_label")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _round_sql(k: int, parts: int) -> str:
    """Assignment to codebooks `b{k}` and the entries after it, `b{k+1}`."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT DISTINCT ON (p, x) p, x, e, d FROM (
    SELECT q.p, q.x, b.e, CAST(list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM (SELECT DISTINCT p, x FROM part) q JOIN b{k} b ON q.p = b.p
  ) ORDER BY p, x, d, e
), b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT p, e, list(CAST(floor_sum AS BIGINT) ORDER BY i) AS x FROM (
      SELECT a.p, a.e, i, (sum(t.x[i]) - ((sum(t.x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum
      FROM part t JOIN a{k} a ON t.p = a.p AND t.x = a.x, unnest(range(1, len(t.x) + 1)) AS u(i) GROUP BY a.p, a.e, i
    ) GROUP BY p, e
  ) m ON b.p = m.p AND b.e = m.e
)"""


def oracle_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same rows in DuckDB."""
    steps = ",".join(_round_sql(k, parts) for k in range(rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT r, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM kept, unnest(range({parts})) AS u(p)
), b0 AS MATERIALIZED (
  SELECT p, e, t.x FROM (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM kept) s JOIN part t USING (r) WHERE e < {entries}
),{steps}, coded AS (
  SELECT k.r, string_agg(format('{{:02x}}', a.e), '' ORDER BY t.p) AS code, CAST(sum(a.d) AS BIGINT) AS error
  FROM kept k JOIN part t USING (r) JOIN a{rounds} a ON t.p = a.p AND t.x = a.x GROUP BY k.r
), sha AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), sha
"""
