"""Connected components by alternating large and small stars. Each half of a round is a written table of edges, so every plan is a short one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import removed, shared_path, written


def _edges(*pairs: Column) -> Column:
    """Rows u, v of those pairs that are not null, from one pass over a table."""
    return F.explode(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("e")


def _edge(u: str, v: str) -> Column:
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _with_least(edges: DataFrame) -> DataFrame:
    """u, v and the least of u's neighbours and u. The minimum is combined before the shuffle. A vertex of many edges is a skewed key of the
    join only: joined by a struct, both sides get an exchange of their own, which Spark can split; by u, the sums' exchange would serve, which it can't.
    Merged, as only merged joins are split, and tables sent to all tasks round after round would fill the driver."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.struct("u").alias("_of"), F.least("u", "m").alias("m"))
    return edges.withColumn("_of", F.struct("u")).join(least.hint("merge"), "_of").drop("_of")


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v of any one orderable type, in any direction. Gives node, root (the least node of its component) for all nodes of edges between two different nodes."""
    spark, paths = edges.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        paths.append(shared_path(spark, "edges"))
        return written(df, paths[-1])

    now = kept(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = now.select(_edges(_edge("u", "v"), _edge("v", "u"))).select("e.*")
        large = kept(_with_least(both).where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _with_least(large).select(_edges(F.when(F.col("v") != F.col("m"), _edge("v", "m")), _edge("u", "m"))).select("e.*")
        now = kept(small.distinct())
        while len(paths) > 1:
            removed(spark, paths.pop(0))
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
