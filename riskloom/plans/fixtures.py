"""Views over the test tables that the registered queries work on, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import ratio, sigmoid
from riskloom.sources.catalog import Feature, FeatureCatalog
from riskloom.sources.readers import read_parquet

WORD = r"[^\x20\x09-\x0D]+"

ADDRESS_CATALOG = FeatureCatalog(
    key="address",
    target="flag",
    row_id="row_id",
    features=(
        Feature("n_orders", "frequency", unit="orders"),
        Feature("min_val", "monetary", unit="currency"),
        Feature("max_val", "monetary", unit="currency"),
        Feature("avg_val", "monetary", unit="currency"),
        Feature("sum_val", "monetary", unit="currency"),
        Feature("life_min", "time interval", unit="minutes"),
        Feature("avg_gap_min", "time interval", unit="minutes"),
        Feature("tok_n", "token activity", "frequency", "events"),
        Feature("tok_val", "token activity", "monetary", "value", needs_verification=True),
        Feature("tok_max", "token activity", "monetary", "value"),
        Feature("const_zero", "token activity", "constant", needs_verification=True),
        Feature("tok_top_type", "token activity", "category"),
    ),
)

#: Fixed linear model over lines, so that scores need no training.
SCORE = {"l_quantity": 0.02, "l_extendedprice": 0.000004, "l_discount": -6.0, "l_tax": 4.0}
SCORE_INTERCEPT = -1.1
LINE_FEATURES = list(SCORE)
#: Fixed linear model over addresses.
RISK = {"n_orders": 0.1, "avg_gap_min": -0.000002, "max_val": 0.000003}
RISK_INTERCEPT = -0.4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def address_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    o = orders.groupBy(F.col("o_custkey").alias("row_id")).agg(
        F.count("*").alias("n_orders"), F.min("o_totalprice").alias("min_val"), F.max("o_totalprice").alias("max_val"), F.round(F.avg("o_totalprice"), 6).alias("avg_val"),
        F.round(F.sum("o_totalprice"), 2).alias("sum_val"), (F.date_diff(F.max("o_orderdate").cast("date"), F.min("o_orderdate").cast("date")).cast("long") * 1440).alias("life_min"),
    )
    by_type = events.groupBy(F.col("user_id").alias("row_id"), "event_type").agg(F.count("*").alias("k"), F.sum("value").alias("v"), F.max("value").alias("m"))
    e = by_type.groupBy("row_id").agg(F.sum("k").alias("tok_n"), F.round(F.sum("v"), 4).alias("tok_val"), F.max("m").alias("tok_max"), F.min_by("event_type", F.struct(-F.col("k"), "event_type")).alias("tok_top_type"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("address"), (F.col("c_acctbal") < 0).cast("int").alias("flag"))
    gap = F.when(F.col("n_orders") > 1, F.round(F.col("life_min") / (F.col("n_orders") - 1), 4)).when(F.col("n_orders") == 1, 0.0)
    return c.join(o, "row_id", "left").join(e, "row_id", "left").select(
        "row_id", "address", "flag", "n_orders", "min_val", "max_val", "avg_val", "sum_val", "life_min", gap.alias("avg_gap_min"), "tok_n", "tok_val", "tok_max", "tok_top_type",
        F.when(F.col("tok_n").isNotNull(), F.lit(0).cast("long")).alias("const_zero"),
    )


def labeled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = table(spark, sf_dir, "documents"), F.col("text")
    digits = F.length(text) - F.length(F.regexp_replace(text, "[0-9]", ""))
    d = d.select("doc_id", "text", "lang", "source", "n_chars", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), ratio(digits, F.length(text)).alias("digit_share"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("flag"), "quality"), "doc_id")


def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), *LINE_FEATURES, "l_linestatus", "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey")


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.lit(SCORE_INTERCEPT)
    for f, b in SCORE.items():
        z = z + F.lit(b) * F.col(f)
    return line_flags(spark, sf_dir).withColumn("p", F.round(sigmoid(z), 4))


ADDRESS_SQL = """
ao AS (
  SELECT o_custkey AS row_id, count(*) AS n_orders, min(o_totalprice) AS min_val, max(o_totalprice) AS max_val,
         round(avg(o_totalprice), 6) AS avg_val, round(sum(o_totalprice), 2) AS sum_val,
         CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS BIGINT) * 1440 AS life_min
  FROM orders GROUP BY 1
), ak AS (
  SELECT user_id AS row_id, event_type, count(*) AS k, sum(value) AS v, max(value) AS m FROM events GROUP BY 1, 2
), ae AS (
  SELECT row_id, CAST(sum(k) AS BIGINT) AS tok_n, round(sum(v), 4) AS tok_val, max(m) AS tok_max FROM ak GROUP BY 1
), ap AS (
  SELECT row_id, event_type AS tok_top_type FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY k DESC, event_type) AS place FROM ak) WHERE place = 1
), address AS (
  SELECT c_custkey AS row_id, c_name AS address, CAST(c_acctbal < 0 AS INTEGER) AS flag, n_orders, min_val, max_val, avg_val, sum_val, life_min,
         CASE WHEN n_orders > 1 THEN round(CAST(life_min AS DOUBLE) / (n_orders - 1), 4) WHEN n_orders = 1 THEN 0.0 END AS avg_gap_min,
         tok_n, tok_val, tok_max, tok_top_type, CASE WHEN tok_n IS NOT NULL THEN CAST(0 AS BIGINT) END AS const_zero
  FROM customer LEFT JOIN ao ON c_custkey = ao.row_id LEFT JOIN ae ON c_custkey = ae.row_id LEFT JOIN ap ON c_custkey = ap.row_id
)"""

DOCS_SQL = r"""
docs AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words,
         CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS BIGINT) AS n_lines,
         coalesce(CAST(length(d.text) - length(regexp_replace(d.text, '[0-9]', '', 'g')) AS DOUBLE) / nullif(length(d.text), 0), 0) AS digit_share,
         l.toxic AS flag, l.quality
  FROM documents d JOIN labels l USING (doc_id)
)"""

LINES_SQL = f"""
lines AS (
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_linenumber, l_orderkey, l_partkey, l_suppkey,
         round(1 / (1 + exp(-({SCORE_INTERCEPT}e0{"".join(f" + {b:.6f}e0 * {f}" for f, b in SCORE.items())}))), 4) AS p
  FROM lineitem
)"""
