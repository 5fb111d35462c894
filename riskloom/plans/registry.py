"""Every query of the engine by name, with its SQL where there is one.

A query is a function of (spark, sf_dir); `query(sql)` registers it under its own name. Doubles are rounded to six digits in
both engines, counts are 64-bit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import scalars
from riskloom.functions.ordering import exact_quantiles
from riskloom.operators import explain, folds, logistic, metrics, models, prepare, profile, thresholds, woe
from riskloom.plans.fixtures import ADDRESS_CATALOG as CATALOG
from riskloom.plans.fixtures import ADDRESS_SQL, DOCS_SQL, LINE_FEATURES, LINES_SQL, RISK, RISK_INTERCEPT, address_profile, labeled_docs, line_flags, scored_lines, table
from riskloom.plans.woe_sql import BAND, categorical, numeric
from riskloom.session import discard, scratch_path, scratch_root
from riskloom.sources.readers import materialized, preview, read_csv, source_mark

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

NUMERIC = [f.name for f in CATALOG.features if f.name != "tok_top_type"]
KNOWN = [f for f in NUMERIC if f != "const_zero"]
RISK_SQL = f"{RISK_INTERCEPT}e0" + "".join(f" + {b:.8f}e0 * {f}" for f, b in RISK.items())
#: Addresses with all of the risk model's inputs and its score.
RISK_CTE = ADDRESS_SQL + f", risk AS (SELECT *, round(1 / (1 + exp(-({RISK_SQL}))), 6) AS p FROM address WHERE n_orders IS NOT NULL)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({f.name: F.round(F.col(f"`{f.name}`"), digits) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def query(sql: str | None = None):
    def register(function):
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(function(spark, sf_dir))

        _QUERIES[function.__name__] = run
        if sql:
            _SQL[function.__name__] = sql
        return run

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- scans, projections, expressions


@query("SELECT l_orderkey, l_partkey, l_extendedprice, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem WHERE l_returnflag = 'R' AND NOT (l_tax = 0)")
def scan_project(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.where((F.col("l_returnflag") == "R") & ~(F.col("l_tax") == 0)).select("l_orderkey", "l_partkey", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("SELECT n_nationkey AS id, n_name AS name, CAST(n_nationkey AS DOUBLE) / 4 AS share FROM nation")
def csv_scan(spark, sf_dir):
    """A CSV written with blanks around its names and NaN for a missing number, and read back."""
    path = scratch_path(spark, "csv")
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(" id"), F.col("n_name").alias("name "), (F.col("n_nationkey").cast("double") / 4).alias(" share "))
    t.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_csv(spark, path).withColumn("id", F.col("id").cast("long"))


@query("SELECT CAST(count(*) AS INTEGER) AS n_columns, count_if(column_name = 'o_totalprice') > 0 AS has_target, (SELECT count(*) FROM (SELECT * FROM orders LIMIT 5)) AS n_rows FROM (DESCRIBE orders)")
def table_preview(spark, sf_dir):
    """What a preview says of a table: its width, whether the target is there, how many rows it shows."""
    rows, width, there = preview(table(spark, sf_dir, "orders"), "o_totalprice")
    return rows.agg(F.lit(width).alias("n_columns"), F.lit(there).alias("has_target"), F.count("*").alias("n_rows"))


@query("SELECT l_orderkey, l_linenumber, round_even(CAST(l_quantity AS DOUBLE) / 2, 0) AS half, round_even(CAST(l_quantity AS DOUBLE) / 8, 2) AS eighth FROM lineitem")
def half_even_rounding(spark, sf_dir):
    """Halves go to the even neighbour."""
    q = F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.round_half_even(q / 2, 0).alias("half"), scalars.round_half_even(q / 8, 2).alias("eighth"))


@query(f"WITH {ADDRESS_SQL} SELECT * REPLACE (round(min_val, 6) AS min_val) FROM address")
def address_view(spark, sf_dir):
    return address_profile(spark, sf_dir)


@query(f"""WITH {RISK_CTE} SELECT row_id, p, round(ln(p / (1 - p)), 6) AS logit, round(ln(1 + greatest(max_val, 0)), 6) AS log_max, round(avg_gap_min / 60 / 24, 6) AS gap_days,
  CASE WHEN p >= 0.5e0 THEN 1 ELSE 0 END AS alarm, substr(address, 1, 12) AS short_name, CASE WHEN tok_n IS NULL THEN 'missing' WHEN tok_n = 0 THEN 'zero' WHEN tok_n > 0 THEN 'positive' END AS state,
  round(coalesce(CAST(tok_n AS DOUBLE) / nullif(tok_max, 0), 0), 6) AS tok_per_value FROM risk""")
def scalar_functions(spark, sf_dir):
    p, c = F.col("p"), F.col
    return risk_scores(spark, sf_dir).select(
        "row_id", "p", scalars.logit(p).alias("logit"), scalars.log1p_clipped(c("max_val")).alias("log_max"), scalars.minutes_to_days(c("avg_gap_min")).alias("gap_days"), scalars.decision(p, 0.5).alias("alarm"),
        scalars.shortened(c("address"), 12).alias("short_name"), scalars.state_of(c("tok_n")).alias("state"), scalars.ratio(c("tok_n"), c("tok_max")).alias("tok_per_value"),
    )


# ---- profiling


@query(f"WITH {ADDRESS_SQL} SELECT count(*) AS n, count_if(flag = 0) AS n_negative, count_if(flag = 1) AS n_positive, round(100e0 * count_if(flag = 1) / count(*), 2) AS positive_pct, round(CAST(count_if(flag = 0) AS DOUBLE) / nullif(count_if(flag = 1), 0), 2) AS imbalance FROM address".replace("count_if(flag = 0) AS n_negative", "CAST(count_if(flag = 0) AS BIGINT) AS n_negative").replace("count_if(flag = 1) AS n_positive", "CAST(count_if(flag = 1) AS BIGINT) AS n_positive"))
def class_balance(spark, sf_dir):
    return profile.class_balance(address_profile(spark, sf_dir), "flag")


@query(f"WITH {ADDRESS_SQL}, m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_missing, count(*) AS n FROM address" for c in [*NUMERIC, "tok_top_type", "flag"]) + ') SELECT "column", n_missing, round(100e0 * n_missing / n, 2) AS missing_pct FROM m WHERE n_missing > 0')
def missing_table(spark, sf_dir):
    return profile.missing_table(address_profile(spark, sf_dir), [*NUMERIC, "tok_top_type", "flag"])


@query(f"WITH {ADDRESS_SQL}, m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS d FROM address" for c in [*NUMERIC, "tok_top_type"]) + ') SELECT "column" FROM m WHERE d <= 1')
def constant_columns(spark, sf_dir):
    return profile.constant_columns(address_profile(spark, sf_dir), [*NUMERIC, "tok_top_type"])


@query(f"""WITH {ADDRESS_SQL}, x AS (SELECT CASE WHEN tok_n IS NULL THEN 'missing' ELSE 'present' END AS r, flag FROM address)
SELECT coalesce(r, 'total') AS "row", CAST(count_if(flag = 0) AS BIGINT) AS n_negative, CAST(count_if(flag = 1) AS BIGINT) AS n_positive, count(*) AS total FROM x GROUP BY ROLLUP (r)""")
def crosstab_margins(spark, sf_dir):
    return profile.crosstab(address_profile(spark, sf_dir), F.when(F.col("tok_n").isNull(), "missing").otherwise("present"), "flag")


@query("SELECT l_quantity AS value, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1")
def value_histogram(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "lineitem"), "l_quantity")


@query(f"WITH {ADDRESS_SQL} SELECT CAST({' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in [*NUMERIC, 'tok_top_type'])} AS INTEGER) AS n_missing, count(*) AS n FROM address GROUP BY 1")
def row_null_histogram(spark, sf_dir):
    return profile.row_null_histogram(address_profile(spark, sf_dir), [*NUMERIC, "tok_top_type"])


@query(f"WITH {ADDRESS_SQL} SELECT tok_n IS NULL AS condition, count(*) AS n, CAST(sum(flag) AS BIGINT) AS n_positive, round(avg(flag), 6) AS rate FROM address GROUP BY 1")
def conditional_rate(spark, sf_dir):
    return profile.conditional_rate(address_profile(spark, sf_dir), F.col("tok_n").isNull(), "flag")


@query("""WITH x AS (SELECT CASE WHEN l_tax IS NULL THEN 'missing' WHEN l_tax = 0 THEN 'zero' WHEN l_tax > 0 THEN 'positive' END AS state, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)
SELECT state, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, round(100e0 * sum(y) / count(*), 1) AS rate_pct, sum(y) = 0 OR sum(y) = count(*) AS is_perfect FROM x WHERE state IS NOT NULL GROUP BY state""")
def state_leakage(spark, sf_dir):
    return profile.state_leakage(line_flags(spark, sf_dir), "l_tax", "y")


_GROUP = "CASE WHEN flag = 0 THEN 'negative' WHEN tok_n IS NULL THEN 'positive without history' ELSE 'positive with history' END"


@query(f"""WITH {ADDRESS_SQL}, x AS (SELECT *, {_GROUP} AS g FROM address) """ + " UNION ALL ".join(f"SELECT g AS \"group\", '{f}' AS feature, round(quantile_cont(CAST({f} AS DOUBLE), 0.5), 6) AS median FROM x WHERE {f} IS NOT NULL GROUP BY g" for f in KNOWN))
def subgroup_medians(spark, sf_dir):
    return profile.group_medians(address_profile(spark, sf_dir), F.expr(_GROUP), KNOWN)


_LINES_LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v, y FROM lines" for f in LINE_FEATURES) + ")"


@query(f"""WITH {LINES_SQL}, {_LINES_LONG}, m AS (SELECT feature, quantile_cont(CASE WHEN y = 0 THEN v END, 0.5) AS a, quantile_cont(CASE WHEN y = 1 THEN v END, 0.5) AS b, stddev_samp(v) AS s FROM l GROUP BY feature)
SELECT feature, round(a, 6) AS median_negative, round(b, 6) AS median_positive, round(s, 6) AS deviation, round(CASE WHEN s > 0 THEN (b - a) / s ELSE 0 END, 6) AS effect FROM m""")
def median_effect_size(spark, sf_dir):
    return profile.median_effect_size(line_flags(spark, sf_dir), LINE_FEATURES, "y")


_CATALOG_SQL = "cat AS (SELECT * FROM (VALUES " + ", ".join(f"('{f.name}', '{f.group}', '{f.axis or f.group}', {str(f.needs_verification).lower()})" for f in CATALOG.features) + ') AS c("column", "group", axis, needs_verification))'
_PROFILE_SQL = f"{ADDRESS_SQL}, {_CATALOG_SQL}, m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_missing, round(100e0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS n_distinct FROM address" for c in CATALOG.names()) + ')'


@query(f'WITH {_PROFILE_SQL} SELECT "column", n_missing, missing_pct, n_distinct, n_distinct <= 1 AS is_constant, "group", axis, needs_verification FROM m JOIN cat USING ("column")')
def column_profile(spark, sf_dir):
    return profile.column_profile(address_profile(spark, sf_dir), CATALOG.names(), CATALOG.table(spark))


@query(f'WITH {_PROFILE_SQL} SELECT "group", count(*) AS n, CAST(count_if(n_distinct <= 1) AS BIGINT) AS n_constant, CAST(count_if(needs_verification) AS BIGINT) AS n_verify FROM m JOIN cat USING ("column") GROUP BY "group"')
def group_summary(spark, sf_dir):
    return profile.group_summary(profile.column_profile(address_profile(spark, sf_dir), CATALOG.names(), CATALOG.table(spark)))


@query(f"WITH {ADDRESS_SQL} SELECT CAST(floor(row_id / 1000) AS BIGINT) AS chunk, count(*) AS n, round(avg(flag), 6) AS rate, round(avg(CAST(tok_n IS NULL AS INTEGER)), 6) AS missing_rate FROM address GROUP BY 1")
def row_order_chunks(spark, sf_dir):
    return profile.row_order_chunks(address_profile(spark, sf_dir), "row_id", "flag", "tok_n")


@query(f"WITH {DOCS_SQL} SELECT count(*) AS n, count(DISTINCT text) AS n_keys, count(*) - count(DISTINCT text) AS n_duplicates FROM docs")
def duplicate_keys(spark, sf_dir):
    return profile.duplicate_keys(labeled_docs(spark, sf_dir), "text")


@query("SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS k FROM documents GROUP BY text, lang, n_chars)")
def full_row_duplicates(spark, sf_dir):
    return profile.full_row_duplicates(table(spark, sf_dir, "documents"), ["text", "lang", "n_chars"])


@query(f"WITH {DOCS_SQL}, k AS (SELECT text, count(*) AS k, count(DISTINCT flag) AS d FROM docs GROUP BY text HAVING count(*) > 1) SELECT count(*) AS n_repeated_keys, CAST(count_if(d > 1) AS BIGINT) AS n_conflicts FROM k")
def label_conflicts(spark, sf_dir):
    return profile.label_conflicts(labeled_docs(spark, sf_dir), "text", "flag")


@query(f"WITH {DOCS_SQL} SELECT doc_id, lang, source, flag, n_words FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place FROM docs) WHERE place = 1")
def dedup_keep_first(spark, sf_dir):
    return profile.keep_first(labeled_docs(spark, sf_dir), "text", "doc_id").select("doc_id", "lang", "source", "flag", "n_words")


@query(f"""WITH {LINES_SQL}, {_LINES_LONG}, c AS (SELECT feature, v, count(*) AS n, avg(y) AS rate, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, v) AS place FROM l GROUP BY feature, v)
SELECT feature, CAST(place AS INTEGER) AS place, round(v, 6) AS value, n, round(rate, 6) AS rate FROM c WHERE place <= 3""")
def top_repeated_values(spark, sf_dir):
    return profile.top_repeated_values(line_flags(spark, sf_dir), LINE_FEATURES, "y")


@query("SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL")
def distinct_values(spark, sf_dir):
    return profile.distinct_values(table(spark, sf_dir, "events"), "event_type")


# ---- tracks

_TRACK_COLUMNS = ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), 0), 6) AS {c}" for c in KNOWN)


@query(f"WITH {ADDRESS_SQL} SELECT row_id, address, flag, {_TRACK_COLUMNS} FROM address")
def track_no_leak(spark, sf_dir):
    return prepare.build_track(address_profile(spark, sf_dir), CATALOG, prepare.NO_LEAK, "tok_n").data


@query(f"WITH {ADDRESS_SQL} SELECT row_id, address, flag, {_TRACK_COLUMNS}, CAST(tok_n IS NULL AS INTEGER) AS history_missing, tok_top_type FROM address")
def track_full(spark, sf_dir):
    return prepare.build_track(address_profile(spark, sf_dir), CATALOG, prepare.FULL, "tok_n", include_strings=True).data


_LOG = f"CAST({' + '.join(f'sum(CAST({c} IS NULL AS INTEGER))' for c in KNOWN)} AS BIGINT)"
_LOGS_SQL = f"""{ADDRESS_SQL}, logs AS (
  SELECT t.track, count(*) AS rows_in, CAST(count(*) - count(DISTINCT address) AS BIGINT) AS duplicates_removed, CAST(1 AS BIGINT) AS constants_removed, CAST(1 AS BIGINT) AS strings_removed,
         {_LOG} AS cells_filled, count(DISTINCT address) AS rows_out, CAST({len(KNOWN)} + t.more AS BIGINT) AS n_features, round(100 * avg(flag), 2) AS positive_pct
  FROM address, (VALUES ('full', 1), ('no_leak', 0)) AS t(track, more) GROUP BY t.track, t.more
)"""


def _logs(spark, sf_dir):
    df = address_profile(spark, sf_dir)
    return [prepare.build_track(df, CATALOG, t, "tok_n").log for t in (prepare.FULL, prepare.NO_LEAK)]


@query(f"WITH {_LOGS_SQL} SELECT * FROM logs")
def processing_log(spark, sf_dir):
    full, no_leak = _logs(spark, sf_dir)
    return full.unionByName(no_leak)


@query(f"""WITH {_LOGS_SQL}, u AS (UNPIVOT (SELECT track, CAST(rows_in AS VARCHAR) AS rows_in, CAST(duplicates_removed AS VARCHAR) AS duplicates_removed, CAST(constants_removed AS VARCHAR) AS constants_removed,
  CAST(strings_removed AS VARCHAR) AS strings_removed, CAST(cells_filled AS VARCHAR) AS cells_filled, CAST(rows_out AS VARCHAR) AS rows_out, CAST(n_features AS VARCHAR) AS n_features, CAST(positive_pct AS VARCHAR) AS positive_pct FROM logs)
  ON COLUMNS(* EXCLUDE track) INTO NAME metric VALUE value)
SELECT metric, max(CASE WHEN track = 'full' THEN value END) AS "full", max(CASE WHEN track = 'no_leak' THEN value END) AS no_leak FROM u GROUP BY metric""")
def processing_log_transposed(spark, sf_dir):
    return prepare.transposed_logs(_logs(spark, sf_dir))


_EVENTLESS = ["tok_n", "tok_val", "tok_max"]


@query(f"WITH {ADDRESS_SQL} SELECT row_id, flag FROM address WHERE coalesce(tok_n, 0) = 0 AND coalesce(tok_val, 0) = 0 AND coalesce(tok_max, 0) = 0")
def shell_rows(spark, sf_dir):
    t = prepare.build_track(address_profile(spark, sf_dir), CATALOG).data
    return t.where(prepare.is_shell(_EVENTLESS)).select("row_id", "flag")


@query(f"""WITH {ADDRESS_SQL}, x AS (SELECT coalesce(tok_n, 0) = 0 AND coalesce(tok_val, 0) = 0 AND coalesce(tok_max, 0) = 0 AS is_shell, flag FROM address)
SELECT b.is_shell, count(x.flag) AS n, CAST(coalesce(sum(x.flag), 0) AS BIGINT) AS n_positive, round(avg(x.flag), 6) AS rate FROM (VALUES (true), (false)) AS b(is_shell) LEFT JOIN x USING (is_shell) GROUP BY 1""")
def residual_leakage(spark, sf_dir):
    return prepare.residual_leakage(prepare.build_track(address_profile(spark, sf_dir), CATALOG).data, _EVENTLESS, "flag")


# ---- bins and evidence

_LINE_WOE = f"{LINES_SQL}, {numeric('lines', 'y', LINE_FEATURES)}"
_TRACK_SQL = f"{ADDRESS_SQL}, track AS (SELECT row_id, address, flag, {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0) AS {c}' for c in KNOWN)}, CAST(tok_n IS NULL AS INTEGER) AS history_missing, tok_top_type FROM address)"


def _line_edges(spark, sf_dir):
    return woe.fit_edges(profile.long_numeric(line_flags(spark, sf_dir), LINE_FEATURES, []), features=LINE_FEATURES)


def _line_table(spark, sf_dir, edges):
    return woe.woe_table(woe.wide_bins(line_flags(spark, sf_dir), edges, ["y"]), "y", ["bin_kind", "bin_number"])


@query(f"WITH {LINES_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(quantile_cont({f}, 0.1), 4) AS q10, round(quantile_cont({f}, 0.25), 4) AS q25, round(quantile_cont({f}, 0.5), 4) AS q50, round(quantile_cont({f}, 0.95), 4) AS q95 FROM lines" for f in LINE_FEATURES))
def exact_percentiles(spark, sf_dir):
    long = profile.long_numeric(line_flags(spark, sf_dir), LINE_FEATURES, [])
    q = exact_quantiles(long, ["feature"], "v", [0.1, 0.25, 0.5, 0.95])
    return rounded(q.select("feature", *(F.col("quantiles")[i].alias(n) for i, n in enumerate(["q10", "q25", "q50", "q95"]))), 4)


@query(f"WITH {_LINE_WOE} SELECT feature, use_zero, CAST(len(edges) AS INTEGER) AS n_edges FROM edges")
def quantile_edges(spark, sf_dir):
    return _line_edges(spark, sf_dir).select("feature", "use_zero", F.size("edges").alias("n_edges"))


@query(f"WITH {_LINE_WOE} SELECT feature, bin_kind, bin_number, count(*) AS n, round(min(v), 6) AS least, round(max(v), 6) AS most FROM binned GROUP BY ALL")
def bin_assignment(spark, sf_dir):
    return woe.wide_bins(line_flags(spark, sf_dir), _line_edges(spark, sf_dir), [], values=True).groupBy("feature", "bin_kind", "bin_number").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


_INTERVALS = "CASE WHEN i = 1 THEN '-inf' ELSE CAST(edges[i] AS VARCHAR) END AS lo, CASE WHEN i = len(edges) - 1 THEN 'inf' ELSE CAST(edges[i + 1] AS VARCHAR) END AS hi"


@query(f"""WITH {_LINE_WOE}, x AS (SELECT feature, CAST(i - 1 AS INTEGER) AS bin_number, {_INTERVALS} FROM edges, unnest(range(1, len(edges))) AS u(i) WHERE feature IN ('l_quantity', 'l_discount', 'l_tax'))
SELECT feature, bin_number, '(' || lo || ', ' || hi || ']' AS label, CASE WHEN lo = '-inf' THEN -1e308 ELSE CAST(lo AS DOUBLE) END AS left_bound FROM x""")
def interval_labels(spark, sf_dir):
    """The bins as they are shown, and the left bounds read back from what is shown."""
    edges = _line_edges(spark, sf_dir).where("feature IN ('l_quantity', 'l_discount', 'l_tax')")
    bounds = F.concat(F.array(F.lit(None).cast("double")), "interior", F.array(F.lit(None).cast("double")))
    each = edges.select("feature", bounds.alias("b"), F.posexplode(F.slice(bounds, 1, F.size("interior") + 1)).alias("bin_number", "lo"))
    label = scalars.interval_label(F.col("lo"), F.col("b")[F.col("bin_number") + 1])
    return each.select("feature", "bin_number", label.alias("label")).withColumn("left_bound", F.greatest(scalars.interval_left_bound(F.col("label")), F.lit(-1e308)))


_PLAIN = ["always_one", "one_or_null", "zero_or_null", "zero_or_one"]
_PLAIN_SQL = "plain AS (SELECT l_linenumber * 0 + 1e0 AS always_one, CASE WHEN l_tax > 0 THEN 1e0 END AS one_or_null, CASE WHEN l_tax > 0 THEN 0e0 END AS zero_or_null, CASE WHEN l_tax > 0 THEN 0e0 ELSE 1e0 END AS zero_or_one, y FROM lines)"


@query(f"WITH {LINES_SQL}, {_PLAIN_SQL}, {numeric('plain', 'y', _PLAIN)} SELECT feature, bin_kind, bin_number, n, n_positive, round(woe, 6) AS woe FROM woe")
def degenerate_bins(spark, sf_dir):
    """Columns that leave no interval: one value, one value or none, zero or none, two values of which zero has its own bin."""
    taxed = F.col("l_tax") > 0
    columns = {"always_one": F.col("l_linenumber") * 0 + 1.0, "one_or_null": F.when(taxed, 1.0), "zero_or_null": F.when(taxed, 0.0), "zero_or_one": F.when(taxed, 0.0).otherwise(1.0)}
    df = line_flags(spark, sf_dir).withColumns(columns)
    return woe.WoeModel.fit(df, _PLAIN, "y").table.select("feature", "bin_kind", "bin_number", "n", "n_positive", "woe")


_DOC_CATEGORIES = ["lang", "source"]
_DOC_WOE = f"{DOCS_SQL}, {categorical('docs', 'flag', _DOC_CATEGORIES, least=0.04)}"


def _doc_categories(spark, sf_dir):
    p = woe.WoeParameters(min_category_share=0.04)
    long = profile.long_strings(labeled_docs(spark, sf_dir), _DOC_CATEGORIES, ["flag"])
    return woe.fold_categories(long, woe.kept_categories(long, p)), p


@query(f"WITH {_DOC_WOE} SELECT feature, bin_kind, category, count(*) AS n FROM binnedc GROUP BY ALL")
def rare_category_fold(spark, sf_dir):
    return _doc_categories(spark, sf_dir)[0].groupBy("feature", "bin_kind", "category").agg(F.count("*").alias("n"))


_WOE_COLUMNS = "n, n_positive, n_negative, round(n_positive / n, 6) AS rate, round(positive_share, 6) AS positive_share, round(negative_share, 6) AS negative_share, round(woe, 6) AS woe, round(iv_term, 6) AS iv_term"
_WOE_NAMES = ["n", "n_positive", "n_negative", "rate", "positive_share", "negative_share", "woe", "iv_term"]


@query(f"WITH {_DOC_WOE} SELECT feature, bin_kind, category, {_WOE_COLUMNS} FROM woec")
def woe_table_categories(spark, sf_dir):
    binned, p = _doc_categories(spark, sf_dir)
    return woe.woe_table(binned, "flag", ["bin_kind", "category"], p).select("feature", "bin_kind", "category", *_WOE_NAMES)


@query(f"""WITH {_LINE_WOE} SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY bin_kind = 'missing',
  CASE WHEN bin_kind <> 'interval' THEN 0e0 WHEN bin_number > 0 THEN edges[bin_number + 1] ELSE -1e308 END, bin_kind <> 'zero', bin_number) AS INTEGER) AS position, bin_kind, bin_number, {_WOE_COLUMNS} FROM woe JOIN edges USING (feature)""")
def woe_table(spark, sf_dir):
    edges = _line_edges(spark, sf_dir)
    return woe.numeric_order(_line_table(spark, sf_dir, edges), edges).select("feature", "position", "bin_kind", "bin_number", *_WOE_NAMES)


@query(f"WITH {_LINE_WOE} SELECT CAST(row_number() OVER (ORDER BY iv DESC, feature) AS INTEGER) AS rank, feature, round(iv, 6) AS iv, {BAND} AS band, n_bins FROM iv")
def iv_ranking(spark, sf_dir):
    return woe.iv_ranking(woe.information_values(_line_table(spark, sf_dir, _line_edges(spark, sf_dir))))


_FULL_WOE = f"{_TRACK_SQL}, {numeric('track', 'flag', [*KNOWN, 'history_missing'])}, {categorical('track', 'flag', ['tok_top_type'])}, all_iv AS (SELECT * FROM iv UNION ALL SELECT * FROM ivc)"


def _kept_profile(spark, sf_dir):
    """The address profile, joined once and then read: fits take several passes over it, and queries on the same files share it."""
    mark = source_mark(spark, [f"{sf_dir}/{n}.parquet" for n in ("customer", "orders", "events")])
    return materialized(spark, lambda: address_profile(spark, sf_dir), f"{scratch_root(spark)}/profile-{mark}")


def _written(spark, df):
    """A table that several passes read, written once; it stays in the scratch folder, as results are read from it later."""
    path = scratch_path(spark, "track")
    df.write.parquet(path)
    return spark.read.parquet(path)


def _full_track_values(spark, sf_dir):
    t = prepare.build_track(_kept_profile(spark, sf_dir), CATALOG, prepare.FULL, "tok_n", include_strings=True)
    return woe.information_values(woe.WoeModel.fit(t.data, t.features, "flag", t.strings).table)


@query(f"WITH {_FULL_WOE} SELECT {BAND} AS band, count(*) AS n, round(sum(iv), 6) AS total FROM all_iv GROUP BY 1")
def iv_bands(spark, sf_dir):
    return _full_track_values(spark, sf_dir).groupBy(scalars.iv_band(F.col("iv")).alias("band")).agg(F.count("*").alias("n"), F.sum("iv").alias("total"))


_WOE_OF = "(SELECT max(w.woe) FROM woe w WHERE w.feature = b.feature AND w.bin_kind = b.bin_kind AND w.bin_number = b.bin_number)"


@query(f"""WITH {_LINE_WOE}, m AS (SELECT b.feature, b.v, b.y, w.woe FROM binned b JOIN woe w USING (feature, bin_kind, bin_number))
SELECT feature, round(v, 6) AS value, count(*) AS n, round(avg(woe), 6) AS woe FROM m GROUP BY ALL""")
def woe_transform(spark, sf_dir):
    df, names = line_flags(spark, sf_dir), LINE_FEATURES
    out = woe.WoeModel.fit(df, LINE_FEATURES, "y").transform(df, "_woe")
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.col(f"{f}_woe").alias("woe")) for f in names))
    return out.select(F.explode(pairs).alias("r")).select("r.*").groupBy("feature", "value").agg(F.count("*").alias("n"), F.avg("woe").alias("woe"))


@query(f"""WITH {LINES_SQL}, seen AS (SELECT * FROM lines WHERE l_linestatus = 'F'), {numeric('seen', 'y', ['l_tax', 'l_discount'])},
x AS (SELECT * FROM (VALUES ('l_tax', -5.0e0), ('l_tax', 0.0e0), ('l_tax', 99.0e0), ('l_tax', NULL), ('l_discount', 0.05e0), ('l_discount', NULL)) AS t(feature, v)),
b AS (SELECT feature, v, CASE WHEN v IS NULL THEN 'missing' WHEN use_zero AND v = 0 THEN 'zero' ELSE 'interval' END AS bin_kind, CASE WHEN v IS NULL OR (use_zero AND v = 0) THEN 0 ELSE len(list_filter(edges[2:len(edges) - 1], lambda e: v > e)) END AS bin_number FROM x JOIN edges USING (feature))
SELECT b.feature, b.v AS value, round(coalesce(w.woe, 0), 6) AS woe FROM b LEFT JOIN woe w ON b.feature = w.feature AND b.bin_kind = w.bin_kind AND b.bin_number = w.bin_number""")
def woe_transform_unseen(spark, sf_dir):
    model = woe.WoeModel.fit(line_flags(spark, sf_dir).where("l_linestatus = 'F'"), ["l_tax", "l_discount"], "y")
    rows = [("l_tax", -5.0), ("l_tax", 0.0), ("l_tax", 99.0), ("l_tax", None), ("l_discount", 0.05), ("l_discount", None)]
    t = spark.createDataFrame(rows, "feature string, value double").withColumn("l_tax", F.col("value")).withColumn("l_discount", F.col("value"))
    return t.select("feature", "value", F.when(F.col("feature") == "l_tax", model.expression("l_tax")).otherwise(model.expression("l_discount")).alias("woe"))


@query(f"WITH {_FULL_WOE} SELECT feature, bin_kind, bin_number, n, n_positive FROM woe WHERE n >= 5 AND (n_positive = 0 OR n_negative = 0)")
def perfect_bins(spark, sf_dir):
    """Bins of at least 5 rows, where the operator's default is 30: the test tables are small."""
    t = prepare.build_track(_kept_profile(spark, sf_dir), CATALOG, prepare.FULL, "tok_n")
    return woe.perfect_bins(woe.WoeModel.fit(t.data, t.features, "flag").table, 5).select("feature", "bin_kind", "bin_number", "n", "n_positive")


@query(f"""WITH {_TRACK_SQL}, raw AS (SELECT row_id, flag, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in KNOWN)} FROM address),
{numeric('track', 'flag', [*KNOWN, 'history_missing'], '_a')}, {numeric('raw', 'flag', KNOWN, '_b')}
SELECT feature, round(a.iv, 6) AS iv_left, round(b.iv, 6) AS iv_right, round(a.iv - b.iv, 6) AS difference FROM iv_a a FULL JOIN iv_b b USING (feature) WHERE a.iv - b.iv IS NULL OR abs(a.iv - b.iv) > 1e-9""")
def iv_two_tracks(spark, sf_dir):
    df = _kept_profile(spark, sf_dir)
    t = prepare.build_track(df, CATALOG, prepare.FULL, "tok_n")
    raw = df.select("flag", *(F.col(c).cast("double").alias(c) for c in KNOWN))
    left, right = woe.WoeModel.fit(_written(spark, t.data), t.features, "flag"), woe.WoeModel.fit(raw, KNOWN, "flag")
    return woe.iv_difference(woe.information_values(left.table), woe.information_values(right.table))


@query(f"""WITH {_TRACK_SQL}, rest AS (SELECT * FROM track WHERE NOT (tok_n = 0 AND tok_val = 0 AND tok_max = 0)), {numeric('track', 'flag', KNOWN, '_a')}, {numeric('rest', 'flag', KNOWN, '_b')}
SELECT feature, round(a.iv, 6) AS iv_left, round(b.iv, 6) AS iv_right, round(a.iv - b.iv, 6) AS difference FROM iv_a a FULL JOIN iv_b b USING (feature) WHERE a.iv - b.iv IS NULL OR abs(a.iv - b.iv) > 1e-9""")
def iv_shell_effect(spark, sf_dir):
    t = prepare.build_track(_kept_profile(spark, sf_dir), CATALOG)
    rest = t.data.where(~prepare.is_shell(_EVENTLESS))
    a, b = (woe.information_values(woe.WoeModel.fit(d, KNOWN, "flag").table) for d in (t.data, rest))
    return woe.iv_difference(a, b)


# ---- folds

_KEYED = f"{ADDRESS_SQL}, ranked AS (SELECT row_id, flag, row_number() OVER (PARTITION BY flag ORDER BY (row_id * 7919) % 104729, row_id) - 1 AS r, count(*) OVER (PARTITION BY flag) AS k FROM address)"


@query(f"WITH {_KEYED} SELECT row_id, flag, CAST(r % 5 AS INTEGER) AS fold FROM ranked")
def stratified_folds(spark, sf_dir):
    df = address_profile(spark, sf_dir).select("row_id", "flag")
    return folds.stratified_folds(df, "row_id", "flag", 5, folds.arithmetic_key(F.col("row_id")))


@query(f"WITH {_KEYED} SELECT row_id, flag, r < round(k * 0.2e0) AS is_test FROM ranked")
def stratified_split(spark, sf_dir):
    df = address_profile(spark, sf_dir).select("row_id", "flag")
    return folds.stratified_split(df, "row_id", "flag", 0.2, folds.arithmetic_key(F.col("row_id")))


@query()
def permuted_labels(spark, sf_dir):
    return folds.permuted_labels(address_profile(spark, sf_dir), "row_id", "flag")


@query(f"WITH {ADDRESS_SQL} SELECT flag, count(*) AS n, count(DISTINCT row_id) AS n_rows FROM address GROUP BY flag")
def permuted_label_counts(spark, sf_dir):
    """Dealing labels anew keeps how many there are of each, and gives every row one."""
    return folds.permuted_labels(address_profile(spark, sf_dir), "row_id", "flag").groupBy("flag").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("n_rows"))


_FOLDED = f"{_KEYED}, folded AS (SELECT a.*, CAST(r.r % 5 AS INTEGER) AS fold FROM address a JOIN ranked r USING (row_id))"


@query(f"WITH {_FOLDED}, " + ", ".join(f"src_{i} AS (SELECT * FROM folded WHERE fold <> {i}), {numeric(f'src_{i}', 'flag', KNOWN, f'_{i}')}" for i in range(5)) + " " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS fold, feature, round(iv, 6) AS iv, n_bins FROM iv_{i}" for i in range(5)))
def fold_information_values(spark, sf_dir):
    """Information values of each fold's training rows, with bins of their own: five leak-free fits from the passes of one."""
    df = address_profile(spark, sf_dir)
    folded = df.join(folds.stratified_folds(df.select("row_id", "flag"), "row_id", "flag", 5, folds.arithmetic_key(F.col("row_id"))).select("row_id", "fold"), "row_id")
    path = scratch_path(spark, "folded")
    folded.select("fold", "flag", *KNOWN).write.parquet(path)
    folded = spark.read.parquet(path)
    return woe.information_values(woe.fold_table(folded, woe.fit_fold_edges(folded, KNOWN, "fold"), "fold", "flag"), ("fold", "feature"))


_NEWTON_STEPS = 6
_NEWTON_FEATURES = ["l_quantity", "l_discount"]


def _newton_sql() -> str:
    """Each step solves its three equations by Cramer's rule."""
    sides = [f"w{i} AS (SELECT DISTINCT b.v, w.woe FROM binned b JOIN woe w USING (feature, bin_kind, bin_number) WHERE b.feature = '{f}')" for i, f in enumerate(_NEWTON_FEATURES, 1)]
    q = "1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2)))"
    parts = [f"g AS (SELECT {_NEWTON_FEATURES[0]} AS v1, {_NEWTON_FEATURES[1]} AS v2, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS pos FROM lines GROUP BY ALL)", *sides]
    parts.append("x AS (SELECT w1.woe AS x1, w2.woe AS x2, sum(n) AS n, sum(pos) AS pos FROM g JOIN w1 ON g.v1 IS NOT DISTINCT FROM w1.v JOIN w2 ON g.v2 IS NOT DISTINCT FROM w2.v GROUP BY ALL)")
    parts.append("s0 AS (SELECT 0e0 AS b0, 0e0 AS b1, 0e0 AS b2)")
    for k in range(_NEWTON_STEPS):
        sums = "sum(v) AS a, sum(v * x1) AS b, sum(v * x2) AS c, sum(v * x1 * x1) + 1 AS d, sum(v * x1 * x2) AS e, sum(v * x2 * x2) + 1 AS f, sum(o) AS u, sum(o * x1) + max(b1) AS v1, sum(o * x2) + max(b2) AS w1, max(b0) AS b0, max(b1) AS b1, max(b2) AS b2"
        parts.append(f"t{k} AS (SELECT {sums} FROM (SELECT *, n * q * (1 - q) AS v, n * q - pos AS o FROM (SELECT *, {q} AS q FROM x, s{k})))")
        det = "(a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c))"
        parts.append(f"s{k + 1} AS (SELECT b0 - (u * (d * f - e * e) - b * (v1 * f - e * w1) + c * (v1 * e - d * w1)) / {det} AS b0, b1 - (a * (v1 * f - e * w1) - u * (b * f - e * c) + c * (b * w1 - v1 * c)) / {det} AS b1, b2 - (a * (d * w1 - v1 * e) - b * (b * w1 - v1 * c) + u * (b * e - d * c)) / {det} AS b2 FROM t{k})")
    out = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS step, round(b0, 6) AS intercept, round(b1, 6) AS quantity, round(b2, 6) AS discount FROM s{k}" for k in range(1, _NEWTON_STEPS + 1))
    return f"WITH {LINES_SQL}, {numeric('lines', 'y', _NEWTON_FEATURES)}, {', '.join(parts)} {out}"


@query(_newton_sql())
def newton_steps(spark, sf_dir):
    """A logistic model on the evidence of two features, step by step from 0."""
    df = line_flags(spark, sf_dir)
    model = woe.WoeModel.fit(df, _NEWTON_FEATURES, "y")
    path = scratch_path(spark, "evidence")
    logistic.counted(df.select(F.lit(0).alias("fold"), "y", *(model.expression(f).alias(f) for f in _NEWTON_FEATURES)), _NEWTON_FEATURES, "y", "fold").write.parquet(path)
    rows = [r[1:] for r in logistic.newton_path(spark.read.parquet(path), _NEWTON_FEATURES, steps=_NEWTON_STEPS)]
    discard(spark, path)
    return spark.createDataFrame(rows, "step int, intercept double, quantity double, discount double")


# ---- metrics

_GROUPS = f"{LINES_SQL}, g AS (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM lines GROUP BY p)"
_AUC = "SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below FROM g)"
_KS = "SELECT round(greatest(max(a / pt - b / nt), 0), 6) AS ks FROM (SELECT sum(pos) OVER (ORDER BY p DESC) AS a, sum(neg) OVER (ORDER BY p DESC) AS b, sum(pos) OVER () AS pt, sum(neg) OVER () AS nt FROM g)"
_HALF = "CAST(count_if(p >= 0.3e0 AND y = 1) AS BIGINT) AS tp, CAST(count_if(p >= 0.3e0 AND y = 0) AS BIGINT) AS fp, CAST(count_if(p < 0.3e0 AND y = 1) AS BIGINT) AS fn, CAST(count_if(p < 0.3e0 AND y = 0) AS BIGINT) AS tn"
_RATES = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"


@query(f"WITH {_GROUPS} {_AUC}")
def auc_exact(spark, sf_dir):
    return metrics.auc(scored_lines(spark, sf_dir))


@query(f"WITH {_GROUPS} {_KS}")
def ks_exact(spark, sf_dir):
    return metrics.ks(scored_lines(spark, sf_dir))


@query(f"WITH {LINES_SQL}, c AS (SELECT {_HALF} FROM lines), r AS (SELECT *, {_RATES} FROM c) SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r")
def confusion_at_threshold(spark, sf_dir):
    return metrics.confusion(scored_lines(spark, sf_dir), 0.3)


@query(f"WITH {_GROUPS}, c AS (SELECT {_HALF} FROM lines), r AS (SELECT *, {_RATES} FROM c) SELECT (SELECT auc FROM ({_AUC})) AS auc, (SELECT ks FROM ({_KS})) AS ks, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM r")
def evaluate_scores(spark, sf_dir):
    return metrics.evaluate(scored_lines(spark, sf_dir), 0.3)


_BY_LINE = LINES_SQL + """, g AS (SELECT l_linenumber AS fold, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM lines GROUP BY ALL),
a AS (SELECT fold, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, sum(neg) OVER (PARTITION BY fold ORDER BY p) - neg AS below FROM g) GROUP BY fold)"""


@query(f"WITH {_BY_LINE} SELECT 'fixed' AS model, 'auc' AS metric, round(avg(auc), 6) AS mean, round(stddev_samp(auc), 6) AS deviation, printf('%.4f ± %.4f', avg(auc), stddev_samp(auc)) AS text FROM a")
def fold_metric_summary(spark, sf_dir):
    by = metrics.auc(scored_lines(spark, sf_dir).withColumn("fold", F.col("l_linenumber")), by=("fold",))
    return metrics.fold_summary(by.withColumn("model", F.lit("fixed")), ("auc",))


@query(f"""WITH {LINES_SQL} SELECT CAST(CASE WHEN p <= 0.1e0 THEN 0 WHEN p <= 0.3e0 THEN 1 WHEN p <= 0.5e0 THEN 2 WHEN p <= 0.7e0 THEN 3 WHEN p <= 0.9e0 THEN 4 ELSE 5 END AS INTEGER) AS bin, count(*) AS n, round(avg(y), 6) AS observed, round(avg(p), 6) AS mean_p FROM lines GROUP BY 1""")
def calibration_bins(spark, sf_dir):
    return metrics.calibration(scored_lines(spark, sf_dir))


# ---- thresholds

_SWEEP = f"""{LINES_SQL}, th AS (SELECT i, CASE WHEN i = 98 THEN 0.99e0 ELSE 0.01e0 + i * (0.98e0 / 98) END AS t FROM range(99) AS r(i)),
g AS (SELECT p, count(*) AS n, sum(y) AS pos FROM lines GROUP BY p),
c AS (SELECT round(t, 3) AS threshold, CAST(sum(CASE WHEN p >= t THEN pos ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN p >= t THEN n - pos ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN p < t THEN pos ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN p < t THEN n - pos ELSE 0 END) AS BIGINT) AS tn FROM th, g GROUP BY t),
sweep AS (SELECT *, {_RATES}, (tp + fp) / (tp + fp + fn + tn) AS alert_rate, coalesce(fn / nullif(tp + fn, 0), 0) AS miss_rate, coalesce(fp / nullif(fp + tn, 0), 0) AS false_alarm_rate FROM c)"""
_SWEEP_OUT = "threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(alert_rate, 6) AS alert_rate, round(miss_rate, 6) AS miss_rate, round(false_alarm_rate, 6) AS false_alarm_rate"


def _sweep(spark, sf_dir):
    return thresholds.sweep(scored_lines(spark, sf_dir))


@query(f"WITH {_SWEEP} SELECT {_SWEEP_OUT} FROM sweep")
def threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query(f"WITH {_SWEEP}, k AS (SELECT threshold, fn * 10e0 + fp AS cost FROM sweep) SELECT threshold, cost, round(cost / max(cost) OVER (), 6) AS relative_cost FROM k")
def cost_curve(spark, sf_dir):
    return thresholds.normalized_cost(thresholds.with_cost(_sweep(spark, sf_dir), 10, 1)).select("threshold", "cost", "relative_cost")


@query(f"WITH {_SWEEP} SELECT {_SWEEP_OUT}, fn * 5e0 + fp AS cost, '5 : 1' AS ratio FROM sweep ORDER BY fn * 5e0 + fp, threshold LIMIT 1")
def min_cost_threshold(spark, sf_dir):
    return thresholds.min_cost(_sweep(spark, sf_dir), 5, 1)


@query(f"""WITH {_SWEEP}, k AS (SELECT r AS cost_ratio, threshold, tp, fp, fn, fn * CAST(r AS DOUBLE) + fp AS cost, row_number() OVER (PARTITION BY r ORDER BY fn * CAST(r AS DOUBLE) + fp, threshold) AS place FROM sweep, (VALUES (1), (5), (10), (20), (50)) AS v(r))
SELECT CAST(cost_ratio AS INTEGER) AS cost_ratio, threshold, tp, fp, fn, cost FROM k WHERE place = 1""")
def cost_ratio_grid(spark, sf_dir):
    return thresholds.cost_ratios(_sweep(spark, sf_dir)).select("cost_ratio", "threshold", "tp", "fp", "fn", "cost")


_PICK = "SELECT '{0}' AS criterion, threshold, fn, fp, round(recall - false_alarm_rate, 6) AS ks FROM (SELECT * FROM sweep ORDER BY {1}, threshold LIMIT 1)"


@query(f"WITH {_SWEEP} " + " UNION ALL ".join(_PICK.format(*x) for x in (("max f1", "round(f1, 9) DESC"), ("max ks", "round(recall - false_alarm_rate, 9) DESC"), ("nearest default", "round(abs(threshold - 0.5e0), 9)"))))
def reference_thresholds(spark, sf_dir):
    return thresholds.reference_thresholds(_sweep(spark, sf_dir)).select("criterion", "threshold", "fn", "fp", "ks")


@query(f"""WITH {_SWEEP}, b AS (SELECT w, threshold, fn, fp, row_number() OVER (PARTITION BY w ORDER BY round(abs(threshold - w), 9), threshold) AS place FROM sweep, (VALUES (0.1e0), (0.3e0), (0.5e0)) AS v(w))
SELECT w AS wanted, threshold, fn + fp AS mistakes FROM b WHERE place = 1""")
def mistakes_at_thresholds(spark, sf_dir):
    return thresholds.nearest(_sweep(spark, sf_dir), [0.1, 0.3, 0.5]).select("wanted", "threshold", (F.col("fn") + F.col("fp")).alias("mistakes"))


_CAPS = [0.0005, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30]


@query(f"""WITH {_SWEEP}, k AS (SELECT cap, threshold, alert_rate, recall, row_number() OVER (PARTITION BY cap ORDER BY threshold) AS place FROM sweep JOIN (VALUES {", ".join(f"({c}e0)" for c in _CAPS)}) AS v(cap) ON alert_rate <= cap)
SELECT v.cap, k.threshold IS NOT NULL AS feasible, k.threshold, round(k.alert_rate, 6) AS alert_rate, round(k.recall, 6) AS recall FROM (VALUES {", ".join(f"({c}e0)" for c in _CAPS)}) AS v(cap) LEFT JOIN k ON v.cap = k.cap AND place = 1""")
def capacity_plan(spark, sf_dir):
    return thresholds.capacity(_sweep(spark, sf_dir), _CAPS).select("cap", "feasible", "threshold", "alert_rate", "recall")


_LOSSES = [50_000, 250_000, 500_000, 1_000_000, 2_500_000]


@query(f"""WITH {_SWEEP}, k AS (SELECT CAST(loss AS DOUBLE) AS loss, threshold, fn * CAST(loss AS DOUBLE) + fp * 50000e0 AS cost FROM sweep, (VALUES {", ".join(f"({x})" for x in _LOSSES)}) AS v(loss)),
b AS (SELECT *, row_number() OVER (PARTITION BY loss ORDER BY cost, threshold) AS place, row_number() OVER (PARTITION BY loss ORDER BY round(abs(threshold - 0.5e0), 9), threshold) AS usual FROM k)
SELECT a.loss, a.threshold, a.cost, d.cost AS default_cost, d.cost - a.cost AS saving FROM b a JOIN b d ON a.loss = d.loss AND a.place = 1 AND d.usual = 1""")
def money_scenarios(spark, sf_dir):
    return thresholds.money_scenarios(_sweep(spark, sf_dir), _LOSSES).select("loss", "threshold", "cost", "default_cost", "saving")


# ---- explanations


def risk_scores(spark, sf_dir):
    df = address_profile(spark, sf_dir).where("n_orders IS NOT NULL")
    return df.withColumn("p", F.round(scalars.sigmoid(explain.linear_margin(RISK, RISK_INTERCEPT)), 6))


_PHI = RISK_CTE + ", phi AS (" + " UNION ALL ".join(f"SELECT row_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {b:.8f}e0 * ({f} - avg({f}) OVER ()) AS phi FROM risk" for f, b in RISK.items()) + ")"


@query(f"WITH {_PHI}, t AS (SELECT feature, avg(abs(phi)) AS a, avg(phi) AS m FROM phi GROUP BY feature) SELECT feature, round(a, 6) AS mean_abs, round(CASE WHEN abs(m) < 1e-6 THEN 0 ELSE m END, 6) AS mean, CAST(row_number() OVER (ORDER BY a DESC, feature) AS INTEGER) AS rank FROM t")
def linear_shap_global(spark, sf_dir):
    t = explain.global_importance(explain.linear_shap(risk_scores(spark, sf_dir), "row_id", RISK))
    return t.withColumn("mean", F.when(F.abs("mean") < 1e-6, 0.0).otherwise(F.col("mean")))


@query(f"WITH {_PHI} SELECT row_id, feature, round(value, 6) AS value, round(phi, 6) AS phi, round(percent_rank() OVER (PARTITION BY feature ORDER BY value), 6) AS value_rank FROM phi")
def linear_swarm(spark, sf_dir):
    """Every row's values and attributions, with the rank of the value: the points of a swarm plot."""
    return explain.with_value_rank(explain.linear_shap(risk_scores(spark, sf_dir), "row_id", RISK))


@query(f"""WITH {_PHI} SELECT row_id, feature, round(value, 6) AS value, round(phi, 6) AS phi, CASE WHEN phi > 0 THEN 'towards positive' ELSE 'towards negative' END AS direction, CAST(row_number() OVER (ORDER BY abs(phi) DESC, feature) AS INTEGER) AS place FROM phi WHERE row_id = 7""")
def linear_shap_local(spark, sf_dir):
    return explain.local_explanation(explain.linear_shap(risk_scores(spark, sf_dir), "row_id", RISK), "row_id", 7)


@query(f"""WITH {_PHI}, b AS (SELECT avg({RISK_SQL}) AS base FROM risk), s AS (SELECT row_id, sum(phi) AS total FROM phi GROUP BY row_id),
e AS (SELECT max(abs(b.base + s.total - ({RISK_SQL}))) AS error FROM risk JOIN s USING (row_id), b) SELECT round(error, 6) AS max_error, error < 1e-6 AS passed FROM e""")
def shap_additivity(spark, sf_dir):
    df = risk_scores(spark, sf_dir).withColumn("p", scalars.sigmoid(explain.linear_margin(RISK, RISK_INTERCEPT)))
    return explain.additivity(explain.linear_shap(df, "row_id", RISK), explain.linear_base(df, RISK, RISK_INTERCEPT), df, "row_id").select("max_error", "passed")


@query(f"""WITH {RISK_CTE} SELECT flag AS label, row_id, p FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY CASE WHEN flag = 1 THEN -p ELSE p END, row_id) AS place FROM risk) WHERE place = 1""")
def representative_rows(spark, sf_dir):
    return explain.representative_rows(risk_scores(spark, sf_dir), "row_id", "p", "flag")


@query(f"""WITH {_PHI}, t AS (SELECT feature, avg(CASE WHEN r.tok_n IS NULL THEN phi END) AS a, avg(phi) AS m FROM phi JOIN risk r USING (row_id) GROUP BY feature)
SELECT feature, round(a, 6) AS mean_marked, round(CASE WHEN abs(m) < 1e-6 THEN 0 ELSE m END, 6) AS mean_all, CAST(row_number() OVER (ORDER BY abs(a) DESC, feature) AS INTEGER) AS place FROM t""")
def shell_row_attribution(spark, sf_dir):
    df = risk_scores(spark, sf_dir)
    t = explain.conditional_importance(explain.linear_shap(df, "row_id", RISK), df.where("tok_n IS NULL"), "row_id")
    return t.withColumn("mean_all", F.when(F.abs("mean_all") < 1e-6, 0.0).otherwise(F.col("mean_all")))


@query(f"""WITH {_PHI} SELECT round(max(b.base), 6) AS base, round(sum(phi), 6) AS total, round(max(b.base) + sum(phi), 6) AS margin, round(1 / (1 + exp(-(max(b.base) + sum(phi)))), 6) AS p
FROM phi, (SELECT avg({RISK_SQL}) AS base FROM risk) b WHERE row_id = 7""")
def local_summary(spark, sf_dir):
    df = risk_scores(spark, sf_dir)
    return explain.local_summary(explain.linear_shap(df, "row_id", RISK), explain.linear_base(df, RISK, RISK_INTERCEPT), "row_id", 7)


@query(f"""WITH {RISK_CTE}, r AS (SELECT flag, row_id FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY CASE WHEN flag = 1 THEN -p ELSE p END, row_id) AS place FROM risk) WHERE place = 1) """ + " UNION ALL ".join(f"SELECT r.flag AS label, '{f}' AS feature, round(CAST(x.{f} AS DOUBLE), 6) AS value, round((SELECT quantile_cont(CAST(y.{f} AS DOUBLE), 0.5) FROM risk y WHERE y.flag = r.flag), 6) AS median FROM r JOIN risk x USING (row_id)" for f in RISK))
def representative_vs_medians(spark, sf_dir):
    df = risk_scores(spark, sf_dir)
    chosen = explain.representative_rows(df, "row_id", "p", "flag").select("row_id")
    values = profile.long_numeric(df.join(F.broadcast(chosen), "row_id"), list(RISK), ["flag"]).select(F.col("flag").alias("label"), "feature", F.col("v").alias("value"))  # a row per class
    medians = profile.group_medians(df, F.col("flag"), list(RISK)).withColumn("label", F.col("group").cast("int")).drop("group")
    return values.join(medians, ["label", "feature"])


@query(f"WITH {LINES_SQL} SELECT round(avg(p), 6) AS mean_p, round(avg(y), 6) AS base_rate, round(quantile_cont(p, 0.05), 6) AS p5, round(quantile_cont(p, 0.5), 6) AS p50, round(quantile_cont(p, 0.95), 6) AS p95 FROM lines")
def score_summary(spark, sf_dir):
    df = scored_lines(spark, sf_dir)
    q = exact_quantiles(df.select(F.lit(0).alias("g"), "p"), ["g"], "p", [0.05, 0.5, 0.95]).select(*(F.col("quantiles")[i].alias(n) for i, n in enumerate(["p5", "p50", "p95"])))
    return df.agg(F.avg("p").alias("mean_p"), F.avg("y").alias("base_rate")).crossJoin(q)  # single rows


@query(f"WITH {_SWEEP} SELECT round(min(alert_rate), 6) AS least_alert_rate FROM sweep")
def least_alert_rate(spark, sf_dir):
    return _sweep(spark, sf_dir).agg(F.min("alert_rate").alias("least_alert_rate"))


# ---- data of figures


_BOX_SQL = f"""WITH {LINES_SQL}, l AS ({" UNION ALL ".join(f"SELECT y, '{f}' AS feature, ln(1 + greatest({f}, 0)) AS v FROM lines" for f in LINE_FEATURES)}),
q AS (SELECT y, feature, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM l GROUP BY ALL)
SELECT y, feature, round(max(a), 6) AS q25, round(max(m), 6) AS q50, round(max(b), 6) AS q75,
  round(min(CASE WHEN v >= a - 1.5e0 * (b - a) THEN v END), 6) AS low, round(max(CASE WHEN v <= b + 1.5e0 * (b - a) THEN v END), 6) AS high,
  CAST(count_if(v < a - 1.5e0 * (b - a) OR v > b + 1.5e0 * (b - a)) AS BIGINT) AS n_beyond FROM l JOIN q USING (y, feature) GROUP BY y, feature"""


@query(_BOX_SQL)
def box_plot_quartiles(spark, sf_dir):
    long = profile.long_numeric(line_flags(spark, sf_dir), LINE_FEATURES, ["y"]).withColumn("v", scalars.log1p_clipped(F.col("v")))
    return profile.boxes(long, ["y", "feature"], "v")


# ---- models (no SQL)

MODEL_FEATURES = ["n_words", "n_lines", "n_chars", "digit_share"]


def _model_rows(spark, sf_dir):
    return labeled_docs(spark, sf_dir).select("doc_id", (1 - F.col("quality")).alias("junk"), *MODEL_FEATURES)


def _source(spark, sf_dir, *names):
    """Of what the scores of these queries are made: queries that ask for the same fits share them."""
    return source_mark(spark, [f"{sf_dir}/{n}.parquet" for n in names])


def _document_models(spark, sf_dir):
    return models.compare(_model_rows(spark, sf_dir), MODEL_FEATURES, "doc_id", "junk", source=_source(spark, sf_dir, "documents", "labels"))


@query()
def cv_model_comparison(spark, sf_dir):
    return _document_models(spark, sf_dir)[0]


#: Decisions are made on this model's out-of-fold scores.
DECISION_MODEL = models.BOOSTING


@query()
def oof_scores(spark, sf_dir):
    return models.out_of_fold(_model_rows(spark, sf_dir), DECISION_MODEL, MODEL_FEATURES, "doc_id", "junk", source=_source(spark, sf_dir, "documents", "labels"))


@query("""SELECT CAST(1 - quality AS INTEGER) AS junk, CAST(i AS INTEGER) AS fold, CAST((count(*) - i + 4) // 5 AS BIGINT) AS n, CAST((count(*) - i + 4) // 5 AS BIGINT) AS n_scored
FROM labels JOIN documents USING (doc_id), range(5) AS r(i) GROUP BY quality, i""")
def oof_fold_sizes(spark, sf_dir):
    """Rows per class and fold, and those of them with a probability from the model that never saw them."""
    scores = models.out_of_fold(_model_rows(spark, sf_dir), models.LOGISTIC, MODEL_FEATURES, "doc_id", "junk")
    return scores.groupBy(F.col("junk").cast("int").alias("junk"), "fold").agg(F.count("*").alias("n"), F.count_if(F.col("p").between(0, 1)).alias("n_scored"))


@query()
def oof_capacity_plan(spark, sf_dir):
    """Out-of-fold scores through sweep, cost and capacity: per cap the lowest threshold that keeps it, and its cost at 20 : 1."""
    scores = models.out_of_fold(_model_rows(spark, sf_dir), DECISION_MODEL, MODEL_FEATURES, "doc_id", "junk", source=_source(spark, sf_dir, "documents", "labels"))
    plan = thresholds.capacity(thresholds.with_cost(thresholds.sweep(scores, "p", "junk"), 20.0, 1.0), _CAPS)
    return plan.select("cap", "feasible", "threshold", "alert_rate", "recall", "cost")


@query()
def cv_fold_detail(spark, sf_dir):
    """Every fold of all three models."""
    return _document_models(spark, sf_dir)[1]


def _tracks(spark, sf_dir):
    found = {}
    for track in (prepare.FULL, prepare.NO_LEAK):
        t = prepare.build_track(_kept_profile(spark, sf_dir), CATALOG, track, "tok_n")
        found[track] = (t.data, t.features)
    return found


def _track_models(spark, sf_dir, tracks):
    return models.compare_tracks(spark, tracks, "row_id", "flag", source=_source(spark, sf_dir, "customer", "orders", "events"))


@query()
def cv_track_models(spark, sf_dir):
    """Thirty fits: three models, five folds, both tracks."""
    return _track_models(spark, sf_dir, _tracks(spark, sf_dir))


def _difference(summary, left, right):
    return metrics.track_difference(*(summary.where(F.col("track") == t).drop("track") for t in (left, right)))


@query()
def cv_track_difference(spark, sf_dir):
    """All three models with and without the indicator of missing history, in mean metrics over folds."""
    return _difference(_track_models(spark, sf_dir, _tracks(spark, sf_dir)), prepare.FULL, prepare.NO_LEAK)


@query()
def cv_without_shells(spark, sf_dir):
    """All three models on the track without leaks, with and without rows whose features are all 0."""
    data, features = _tracks(spark, sf_dir)[prepare.NO_LEAK]
    tracks = {prepare.NO_LEAK: (data, features), "without_shells": (models.without_shells(data, features), features)}
    return _difference(_track_models(spark, sf_dir, tracks), prepare.NO_LEAK, "without_shells")


@query()
def permutation_control(spark, sf_dir):
    return models.permutation_control(_model_rows(spark, sf_dir), models.BOOSTING, MODEL_FEATURES, "doc_id", "junk")


def _boosted(spark, sf_dir):
    df = _model_rows(spark, sf_dir)
    scorer = models.fit(df, models.BOOSTING, MODEL_FEATURES, "junk")
    path = scratch_path(spark, "trees")
    trees = explain.trees_of(spark, scorer.model, path)
    discard(spark, path)
    return df, scorer, trees


@query()
def tree_shap_global(spark, sf_dir):
    """Boosted trees on labelled documents, explained row by row, then by feature."""
    df, _, trees = _boosted(spark, sf_dir)
    return explain.global_importance(explain.tree_shap(df, "doc_id", MODEL_FEATURES, trees))


@query()
def forest_shap_rows(spark, sf_dir):
    """Every labelled document explained by a forest, on the scale of probabilities, with what a swarm plot needs: value, its rank, and how far base and sum lie from the model's own probability."""
    df, path = _written(spark, _model_rows(spark, sf_dir)), scratch_path(spark, "phi")  # both are read several times
    explain.forest_rows(df, "doc_id", MODEL_FEATURES, "junk", models.trees_of_a_model()).write.parquet(path)
    return explain.with_value_rank(spark.read.parquet(path)).select("doc_id", "feature", "value", "value_rank", "phi", "p", "gap")


@query()
def tree_shap_local(spark, sf_dir):
    """The surest right row of each class, feature by feature, with the base value and how far base and sum lie from the model's own margin."""
    df, scorer, trees = _boosted(spark, sf_dir)
    chosen = explain.representative_rows(scorer.score(df), "doc_id", "p", "junk")  # a row per class
    rows = df.join(F.broadcast(chosen.select("doc_id", "label", "p")), "doc_id")
    phi = explain.tree_shap(rows, "doc_id", MODEL_FEATURES, trees)
    base = F.lit(2.0 * explain.tree_base(trees))
    total = phi.groupBy("doc_id").agg(F.sum("phi").alias("total"))
    return phi.join(total, "doc_id").join(rows.select("doc_id", "label", "p"), "doc_id").select("label", "doc_id", "feature", "value", "phi", base.alias("base"), "p", F.abs(scalars.sigmoid(base + F.col("total")) - F.col("p")).alias("gap"))
