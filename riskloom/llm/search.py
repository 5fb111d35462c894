"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Components become integers, floor(scale * x). Candidates and queries are dealt by hash into groups of bounded size, and
each candidate group meets each query group in one task (two keys, one shuffle; no cross join). There, the candidates'
components are quantised to `levels` signed impacts; a posting segment holds the candidates of one dimension and impact.
Segments are processed by falling impact for a block of queries at once: each adds impact x query component to the
accumulators of its candidates. What an accumulator still misses is at most |query| x |rest of the candidate| (Cauchy and
Schwarz; the rests' lengths are kept per level). Processing stops when this proves that few candidates of the block can
still be among a query's k best; these possible members, all of them, are scored exactly. With no proof, all segments are
processed, and every possible member is scored all the same.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without identifier;
vectors of different lengths never meet. Rows that repeat both identifier and vector, component by component, count once (they
are combined before the shuffle, so no group holds them all). Rows that share an identifier only, even if their integers are
equal, are each a candidate, and each a query with ranks of its own. A candidate with the query's own identifier is skipped.
Ties go to the smaller identifier. Only vec_id and embedding are read, so extra columns may have any name. Components so large
that a score might leave 63 bits raise ValueError before any search: dims * max|floor(scale * x)|^2 has to stay below 2^62, so
all scores are exact. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import settled


class ImpactIndex:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = 12):
        self.ids, self.vectors = ids, vectors
        self.step = max(1, -(-int(np.abs(vectors).max(initial=0)) // levels))
        impacts = np.rint(vectors / self.step).astype(np.int64)
        docs, dims = np.nonzero(impacts)
        values = impacts[docs, dims]
        order = np.lexsort((docs, values, dims, -np.abs(values)))
        docs, dims, values = docs[order], dims[order], values[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(dims) != 0) | (np.diff(values) != 0)]) if len(docs) else np.zeros(0, int)
        #: (impact's size, dimension, impact, candidates), by falling size
        self.segments = [(abs(int(values[a])), int(dims[a]), int(values[a]), docs[a:b]) for a, b in zip(starts, [*starts[1:], len(docs)])]
        self.impacts = impacts
        self.rest: dict[int, np.ndarray] = {}

    def rest_after(self, level: int) -> np.ndarray:
        """Length of what is missing of each candidate once impacts of that size and more are processed."""
        if level not in self.rest:
            done = np.where(np.abs(self.impacts) >= level, self.impacts, 0) * self.step
            self.rest[level] = np.sqrt(((self.vectors - done).astype(float) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-6
        return self.rest[level]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """Query number, candidate number and exact score of the k best of each query, or more where they tie out later."""
        by_dimension = np.ascontiguousarray(queries.T)
        sums = np.zeros((len(self.ids), len(queries)), np.int64)
        own = self.ids[:, None] == query_ids[None, :]
        lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)
        sizes = sorted({x[0] for x in self.segments}, reverse=True)
        proofs = {x for x in (4, 2, 1) if x in sizes} | set(sizes[-1:])
        possible = ~own
        for i, (size, dimension, impact, docs) in enumerate(self.segments):
            sums[docs] += impact * self.step * by_dimension[dimension]
            last_of_size = i + 1 == len(self.segments) or self.segments[i + 1][0] < size
            if last_of_size and size in proofs:
                slack = self.rest_after(size)[:, None] * lengths[None, :]
                low = np.where(own, -np.inf, sums - slack)
                at = len(self.ids) - min(k, len(self.ids))
                bar = np.partition(low, at, axis=0)[at]
                possible = ~own & (sums + slack >= bar)
                if possible.sum() <= 8 * k * len(queries):
                    break
        docs, asked = np.nonzero(possible)
        exact = np.empty(len(docs), np.int64)
        for a in range(0, len(docs), 1 << 16):
            exact[a : a + (1 << 16)] = np.einsum("ij,ij->i", self.vectors[docs[a : a + (1 << 16)]], queries[asked[a : a + (1 << 16)]])
        order = np.lexsort((self.ids[docs], -exact, asked))
        docs, asked, exact = docs[order], asked[order], exact[order]
        rank = np.arange(len(asked)) - np.searchsorted(asked, asked, "left")
        keep = rank < k
        return asked[keep], docs[keep], exact[keep]


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, key (of the row), dims, x (integers) of the vectors that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    integers = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))))  # beyond that, refused
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        .where(whole)
        .select("vec_id", "embedding")
        .distinct()
        .select("vec_id", F.xxhash64("embedding").alias("key"), F.size("embedding").alias("dims"), integers.alias("x"))
    )


def in_range(rows: DataFrame) -> None:
    """Refuses components whose scores might leave 63 bits. One small row comes to the driver."""
    dims, size = rows.agg(F.max("dims"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()
    if dims and dims * size * size >= 2**62:
        raise ValueError(f"components reach {size} once scaled: scores of {dims} of them might pass 63 bits")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, levels: int = 12, candidates_at_once: int = 8192, queries_at_once: int = 2048, block: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `vectors` that is_query holds for, the k best of all other rows."""
    rows = settled(quantised(vectors, scale))
    in_range(rows)
    asked = rows.where(is_query)
    groups = lambda df, most: max(1, math.ceil(df.count() / most))
    n_candidates, n_queries = groups(rows, candidates_at_once), groups(asked, queries_at_once)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id", "key"), F.lit(n)).cast("int")
    candidates = rows.withColumn("c", own(n_candidates)).withColumn("q", spread(n_queries))
    wanted = asked.withColumn("q", own(n_queries)).withColumn("c", spread(n_candidates))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64),) * 4]
        if len(left) and len(right):
            index = ImpactIndex(left["vec_id"].to_numpy(np.int64), np.stack(left["x"].to_numpy()).astype(np.int64), levels)
            ids, queries = right["vec_id"].to_numpy(np.int64), np.stack(right["x"].to_numpy()).astype(np.int64)
            for a in range(0, len(ids), block):
                which, docs, scores = index.search(ids[a : a + block], queries[a : a + block], k)
                found.append((ids[a:][which], right["key"].to_numpy(np.int64)[a:][which], index.ids[docs], scores))
        return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("query_id", "key", "vec_id", "score"), zip(*found))})

    found = candidates.groupBy("c", "q", "dims").cogroup(wanted.groupBy("c", "q", "dims")).applyInPandas(meet, "query_id long, key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows for k = 5, scale = 256 and queries whose vec_id 50 divides.
ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM (
    SELECT DISTINCT vec_id, embedding FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  )
), p AS (
  SELECT q.vec_id AS query_id, q.key, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
