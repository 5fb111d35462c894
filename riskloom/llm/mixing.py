"""Mixing sources to target weights by Pareto order sampling; DataFrame operations only.

1. Sources by code point (null last) weigh 5, 2, 1 in turn and share 150 % of all words; a target stops at twice its
   source's words, the excess goes to the others by weight (solved in one pass over the sources in order of limit/weight).
2. A source's whole copies, floor(target / words), go to each of its documents.
3. The rest is a sample of fixed size in words: documents are ranked by random odds over inclusion odds, u/(1-u) : p/(1-p).
   u comes from the identifier's md5, so reruns agree. p/(1-p) is proportional to sqrt(mean words / words): copies beyond
   the certain ones prefer shorter documents, which keeps more distinct ones and leaves less to one huge document. The factor
   that makes the inclusion probabilities times words add up to the open words is one for all of a source's documents, so it
   does not change their order and need not be solved for; f/(1-f), f being the open share, stands in its place (the realised
   shares of inclusion are tested against the solved ones). Taking follows the rank until the source's words are reached; the last document is
   taken in part, so a source's words are its target, rounded. Where the rounded rest is the whole source, nothing is left
   to draw: every document is taken once more.

The place where taking ends is found without sorting a source: its documents fall into about sqrt(n) rank buckets, the
buckets are added up (combined before the shuffle), and only the bucket that holds the end is sorted. What is joined back
is one row per source, sent to all tasks while their counted number is small and salted beyond, so a source with a third
of all rows is spread like any other.

Cases: null and empty texts have size 0 and taken 0; a null source is a source of its own; rows that tie in rank,
identifier and size share what is left equally (rounded down); very long texts count whole; only doc_id, source and the text
are read, so extra columns may have any name; an empty table gives no rows; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, settled

WEIGHTS, SHARE, LIMIT, SEED = (5, 2, 1), 1.5, 2, "mix"
#: Up to so many sources, their table (some 100 bytes a row) is sent to all tasks; beyond, documents are joined under a salt.
BROADCAST_SOURCES, SALTS = 50_000, 64


def with_size(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """One row per source: source, n_docs, source_size, target. Its windows run over one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    # the lowest limit per weight fills up first
    filling = Window.orderBy(F.expr("most / weight"), F.col("source").asc_nulls_last())
    before, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    return (
        sizes.groupBy("source")
        .agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * limit)
        .withColumn("place", F.row_number().over(filling))
        .withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct("place", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level") * F.col("weight")).otherwise(F.col("most").cast("double")))
        .select("source", "n_docs", "source_size", "target")
    )


def _with_source(df: DataFrame, sources: DataFrame, n_sources: int, more: Column | None = None) -> DataFrame:
    """df with the columns of its source; `sources` has `_source` in place of source. No source's rows go to one task."""
    same = df["source"].eqNullSafe(sources["_source"]) if more is None else df["source"].eqNullSafe(sources["_source"]) & more
    if n_sources <= BROADCAST_SOURCES:
        return df.join(F.broadcast(sources), same).drop("_source")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    spread = sources.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, same & (F.col("_salt") == F.col("_salt_of"))).drop("_source", "_salt", "_salt_of")


def _ranked(sizes: DataFrame, sources: DataFrame, n_sources: int, seed: str) -> DataFrame:
    """sizes with its source's columns, rank (null where nothing is sampled) and bucket."""
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)
    drawn = (F.col("size") > 0) & (F.col("open_words") > 0) & (F.col("open_words") < F.col("source_size"))
    inclusion = F.col("open_words") / (F.col("source_size") - F.col("open_words")) * F.sqrt(F.col("source_size") / F.col("n_docs") / F.col("size"))
    return (
        _with_source(sizes, sources.withColumnRenamed("source", "_source"), n_sources)
        .withColumn("rank", F.when(drawn, u / (1 - u) / inclusion))
        .withColumn("bucket", F.floor(F.col("rank") / (F.col("rank") + 1) * F.ceil(F.sqrt("n_docs"))))
    )


def mixing_plan(sizes: DataFrame, seed: str = SEED, **how) -> tuple[DataFrame, int]:
    """The number of sources, and one row for each: its target, whole copies, and the rank, identifier and size of the document at which sampling ends, with the words taken of it."""
    sources = settled(
        source_targets(sizes, **how)
        .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("open_words", F.round("target").cast("long") - F.col("copies") * F.col("source_size"))
    )
    n = sources.count()
    ranked = _ranked(sizes, sources, n, seed).where("rank IS NOT NULL")
    buckets = ranked.groupBy("source", "bucket", "open_words").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = buckets.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).where("before < open_words AND before + words >= open_words")
    last = last.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "before")
    tied = Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        _with_source(ranked, last, n, F.col("bucket") == F.col("_bucket"))
        .groupBy("source", "rank", "doc_id", "size", "before", "open_words")
        .agg(F.count("*").alias("rows"))
        .withColumn("left", F.col("open_words") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("rows")).over(tied), F.lit(0)))
        .where("left > 0 AND left <= size * rows")
        .select(F.col("source").alias("_source"), F.struct("rank", "doc_id", "size").alias("end"), F.floor(F.col("left") / F.col("rows")).alias("end_words"))
    )
    return settled(sources.join(ends, sources["source"].eqNullSafe(ends["_source"]), "left").drop("_source")), n


def apply_plan(sizes: DataFrame, plan: tuple[DataFrame, int], seed: str = SEED) -> DataFrame:
    """sizes with source_size, target, copies and taken."""
    place = F.struct("rank", "doc_id", "size")
    sampled = F.when(F.col("open_words") == F.col("source_size"), F.col("size")).when(F.col("rank").isNull() | (place > F.col("end")), 0).when(place < F.col("end"), F.col("size")).otherwise(F.col("end_words"))
    return _ranked(sizes, *plan, seed).withColumn("taken", F.col("copies") * F.col("size") + F.coalesce(sampled, F.lit(0))).drop("n_docs", "open_words", "rank", "bucket", "end", "end_words")


def mix(documents: DataFrame, text: str = "text", seed: str = SEED, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document. Sizes are counted once and kept in the shared folder."""
    sizes = settled(with_size(documents.select("doc_id", "source", F.col(text).alias("_text")), "_text").drop("_text"))
    return apply_plan(sizes, mixing_plan(sizes, seed, **how), seed)


def mixed_documents(documents: DataFrame, text: str = "text", seed: str = SEED, **how) -> DataFrame:
    """The mix itself, with the columns of `documents`: a row per whole copy, and one with the first words of a document taken in part."""
    sizes = settled(with_size(documents.select("doc_id", "source", F.col(text).alias("_text")), "_text").drop("_text"))
    plan = mixing_plan(sizes, seed, **how)
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row")
    wide = with_size(documents.select("doc_id", "source", F.col(text).alias("_text"), row), "_text").drop("_text")
    taken = apply_plan(wide, plan, seed)
    parts = F.filter(F.array(*(F.least(F.col("size"), F.col("taken") - k * F.col("size")) for k in range(how.get("limit", LIMIT)))), lambda x: x > 0)
    rows = taken.select("_row", "size", F.explode(parts).alias("part"))
    whole = F.col(f"_row.`{text}`")
    words = F.regexp_extract_all(whole, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    first = F.when(F.col("part") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")).otherwise(whole)
    return rows.select(*(first.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in documents.columns))


#: The same rows in DuckDB, by plain windows over whole sources.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s0 AS (
  SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), s1 AS (
  SELECT *, 2 * source_size AS most, CAST(2 * source_size AS DOUBLE) / weight AS per FROM s0
), s2 AS (
  SELECT *, row_number() OVER (ORDER BY per, source NULLS LAST) AS place,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0
          - CAST(coalesce(sum(most) OVER (ORDER BY per, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER (ORDER BY per, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM s1
), s3 AS (
  SELECT *, (SELECT arg_min(level, place) FROM s2 WHERE level * weight < most) AS common FROM s2
), s4 AS (
  SELECT source, n_docs, source_size, CASE WHEN common * weight < most THEN common * weight ELSE CAST(most AS DOUBLE) END AS target FROM s3
), s AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM s4
), r0 AS (
  SELECT d.*, s.n_docs, s.source_size, s.target, s.copies, CAST(round(s.target) AS BIGINT) - s.copies * s.source_size AS open_words,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0 AS u
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), r AS (
  SELECT *, CASE WHEN size > 0 AND open_words > 0 THEN
    u / (1 - u) / (CAST(open_words AS DOUBLE) / CAST(source_size - open_words AS DOUBLE)
                   * sqrt(CAST(source_size AS DOUBLE) / CAST(n_docs AS DOUBLE) / CAST(size AS DOUBLE))) END AS rank
  FROM r0
), g AS (
  SELECT source, rank, doc_id, size, count(*) AS n_rows,
         coalesce(sum(size * count(*)) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r WHERE rank IS NOT NULL GROUP BY source, rank, doc_id, size
)
SELECT r.doc_id, r.source, r.size, r.source_size, r.target, r.copies,
       CAST(r.copies * r.size + CASE WHEN g.rank IS NULL OR r.open_words - g.before <= 0 THEN 0
            ELSE least(r.size, (r.open_words - g.before) // g.n_rows) END AS BIGINT) AS taken
FROM r LEFT JOIN g ON r.source IS NOT DISTINCT FROM g.source AND r.rank = g.rank AND r.doc_id IS NOT DISTINCT FROM g.doc_id AND r.size = g.size
"""
