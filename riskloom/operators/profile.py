"""Profiling: balance, missing values, constants, duplicates, leakage states, row-order traces.

Every table comes from one pass over the data with aggregates that combine before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ordering import exact_quantiles
from riskloom.functions.scalars import percent, ratio, state_of


def rows_of(one_row: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """Turns one wide row with columns `name__field` into a row per name."""
    each = [F.struct(F.lit(n).alias("column"), *(F.col(f"`{n}__{f}`").cast(kind).alias(f) for f, kind in fields.items())) for n in names]
    return one_row.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def long_numeric(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep, feature, v: one row per row and numeric feature, in one scan."""
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("v")) for f in features]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("p")).select(*keep, "p.*")


def long_strings(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("string").alias("c")) for f in features]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("p")).select(*keep, "p.*")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    y = F.col(label)
    t = df.agg(F.count("*").alias("n"), F.count_if(y == 0).alias("n_negative"), F.count_if(y == 1).alias("n_positive"))
    return t.withColumn("positive_pct", percent(ratio(F.col("n_positive"), F.col("n")))).withColumn("imbalance", F.round(F.try_divide(F.col("n_negative").cast("double"), F.col("n_positive").cast("double")), 2))


def missing_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    one = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}__n_missing") for c in columns), F.count("*").alias("n"))
    return rows_of(one.withColumns({f"{c}__n": F.col("n") for c in columns}), columns, {"n_missing": "long", "n": "long"}).where("n_missing > 0").select("column", "n_missing", percent(F.col("n_missing") / F.col("n")).alias("missing_pct")).orderBy(F.desc("n_missing"), "column")


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns with at most one distinct known value: the least equals the greatest, which needs no distinct count."""
    columns = columns or df.columns
    one = df.agg(*(F.coalesce(F.min(f"`{c}`") == F.max(f"`{c}`"), F.lit(True)).alias(f"{c}__constant") for c in columns))
    return rows_of(one, columns, {"constant": "boolean"}).where("constant").select("column")


def crosstab(df: DataFrame, row: Column, label: str) -> DataFrame:
    """Counts by row value and label with totals, by rollup."""
    counts = df.select(row.cast("string").alias("row"), F.col(label).alias("y"))
    return counts.rollup("row").agg(F.count_if(F.col("y") == 0).alias("n_negative"), F.count_if(F.col("y") == 1).alias("n_positive"), F.count("*").alias("total"), F.grouping("row").alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col("row")).alias("row"), "n_negative", "n_positive", "total")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def row_null_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    nulls = reduce(lambda a, b: a + b, (F.col(f"`{c}`").isNull().cast("int") for c in columns))
    return df.groupBy(nulls.alias("n_missing")).agg(F.count("*").alias("n")).orderBy("n_missing")


def conditional_rate(df: DataFrame, condition: Column, label: str) -> DataFrame:
    return df.groupBy(condition.alias("condition")).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("n_positive"), F.avg(label).alias("rate"))


def state_leakage(df: DataFrame, column: str, label: str) -> DataFrame:
    """By state of a column: rows, positives, rate and whether the state settles the label."""
    by = df.withColumn("state", state_of(F.col(column))).where("state IS NOT NULL").groupBy("state")
    t = by.agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("n_positive"))
    return t.withColumn("rate_pct", percent(F.col("n_positive") / F.col("n"), 1)).withColumn("is_perfect", (F.col("n_positive") == 0) | (F.col("n_positive") == F.col("n")))


def group_medians(df: DataFrame, group: Column, features: list[str]) -> DataFrame:
    long = long_numeric(df.withColumn("_group", group.cast("string")), features, ["_group"])
    return exact_quantiles(long, ["_group", "feature"], "v", [0.5]).select(F.col("_group").alias("group"), "feature", F.col("quantiles")[0].alias("median"))


def boxes(long: DataFrame, by: list[str], value: str, reach: float = 1.5) -> DataFrame:
    """by, quartiles, whisker ends (the outermost values within `reach` times the spread of the quartiles) and how many values lie beyond them. Few groups."""
    q = exact_quantiles(long, by, value, [0.25, 0.5, 0.75]).select(*by, *(F.col("quantiles")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))))
    v, spread = F.col(value), F.col("q75") - F.col("q25")
    inside_low, inside_high = v >= F.col("q25") - reach * spread, v <= F.col("q75") + reach * spread
    t = long.join(F.broadcast(q), by).groupBy(*by, "q25", "q50", "q75")  # a row per group
    return t.agg(F.min(F.when(inside_low, v)).alias("low"), F.max(F.when(inside_high, v)).alias("high"), F.count_if(~inside_low | ~inside_high).alias("n_beyond"))


def median_effect_size(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(median of positives - median of negatives) / sample deviation, 0 where there is none; largest first."""
    long = long_numeric(df, features, [label])
    m = exact_quantiles(long, ["feature", label], "v", [0.5]).groupBy("feature").agg(F.max(F.when(F.col(label) == 0, F.col("quantiles")[0])).alias("median_negative"), F.max(F.when(F.col(label) == 1, F.col("quantiles")[0])).alias("median_positive"))
    spread = long.groupBy("feature").agg(F.stddev_samp("v").alias("deviation"))
    effect = F.when(F.col("deviation") > 0, (F.col("median_positive") - F.col("median_negative")) / F.col("deviation")).otherwise(0.0)
    return m.join(spread, "feature").withColumn("effect", effect).orderBy(F.desc(F.abs("effect")), "feature")


def column_profile(df: DataFrame, columns: list[str], catalog: DataFrame) -> DataFrame:
    """Missing and distinct counts per column, with the catalog's group and axis. Values are made distinct per column before they are counted, in one shuffle."""
    each = long_strings(df, columns, [])
    t = each.groupBy("feature", "c").agg(F.count("*").alias("k")).groupBy("feature").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("c").isNull(), F.col("k")).otherwise(0)).alias("n_missing"), F.count("c").alias("n_distinct"))
    t = t.withColumnRenamed("feature", "column").join(catalog, "column", "left")
    return t.select("column", "n_missing", percent(F.col("n_missing") / F.col("n")).alias("missing_pct"), "n_distinct", (F.col("n_distinct") <= 1).alias("is_constant"), F.coalesce("group", F.lit("other")).alias("group"), F.coalesce("axis", "group", F.lit("other")).alias("axis"), F.coalesce("needs_verification", F.lit(True)).alias("needs_verification"))


def group_summary(profile: DataFrame) -> DataFrame:
    return profile.groupBy("group").agg(F.count("*").alias("n"), F.count_if("is_constant").alias("n_constant"), F.count_if("needs_verification").alias("n_verify"))


def row_order_chunks(df: DataFrame, row_id: str, label: str, watched: str, size: int = 1000) -> DataFrame:
    return df.groupBy(F.floor(F.col(row_id) / size).alias("chunk")).agg(F.count("*").alias("n"), F.avg(label).alias("rate"), F.avg(F.col(watched).isNull().cast("int")).alias("missing_rate")).orderBy("chunk")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of their key; null keys are equal to each other."""
    return df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows")).agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n"), F.count("*").alias("n_keys")).withColumn("n_duplicates", F.col("n") - F.col("n_keys"))


def full_row_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg((F.count("*") - 1).alias("_more")).agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("n_duplicates"))


def label_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys that occur more than once, and those of them with more than one label."""
    t = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows"), (F.min(label) != F.max(label)).alias("_conflict")).where("_rows > 1")
    return t.agg(F.count("*").alias("n_repeated_keys"), F.count_if("_conflict").alias("n_conflicts"))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key. The minimum is combined before the shuffle, so a frequent key does no harm."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, F.col(order)).alias("_row")).select("_row.*")


def top_repeated_values(df: DataFrame, features: list[str], label: str, k: int = 3) -> DataFrame:
    t = long_numeric(df, features, [label]).where("v IS NOT NULL").groupBy("feature", "v").agg(F.count("*").alias("n"), F.avg(label).alias("rate"))
    best = Window.partitionBy("feature").orderBy(F.desc("n"), "v")
    return t.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("feature", "place", F.col("v").alias("value"), "n", "rate")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()
