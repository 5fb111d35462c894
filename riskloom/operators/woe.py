"""Weight of evidence: all features of a table in one long plan, scoring by generated expressions.

Bins are (lo, hi], quantile-based and open outwards; zeros get a bin of their own where they are frequent, missing values
always; rare categories fold into one. Only observed bins exist, so empty intervals add no smoothing mass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ordering import select_quantiles
from riskloom.functions.scalars import iv_band, steps
from riskloom.operators.profile import long_numeric, long_strings

#: As numpy's linspace gives them.
TENTHS = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]
MISSING, ZERO, INTERVAL, WHOLE, CATEGORY, OTHER = "missing", "zero", "interval", "whole", "category", "other"


@dataclass(frozen=True)
class WoeParameters:
    max_bins: int = 10
    separate_zero: bool = True
    min_zero_share: float = 0.05
    min_category_share: float = 0.01
    smoothing: float = 0.5

    def probabilities(self) -> list[float]:
        return TENTHS if self.max_bins == 10 else [i * (1.0 / self.max_bins) for i in range(self.max_bins)] + [1.0]


EDGES = "feature string, use_zero boolean, edges array<double>, interior array<double>"


def fit_edges(long: DataFrame, p: WoeParameters = WoeParameters(), features: list[str] | None = None) -> DataFrame:
    """feature, use_zero, edges (distinct quantiles), interior (edges without the outer two): a row per feature, known to the driver. Two passes over `long` as a rule;
    the first finds the shares of zeros as well. A feature without known values has no edges. Without a list of features, one more pass finds their names."""
    found = {q.group[0]: q for q in select_quantiles(long, ["feature"], "v", p.probabilities(), zero_share=p.min_zero_share if p.separate_zero else None)}
    rows = []
    for feature in features or [r.feature for r in long.select("feature").distinct().collect()]:
        q = found.get(feature)
        edges = sorted(set(q.quantiles)) if q and q.quantiles else []
        rows.append((feature, bool(q and q.without_zeros), edges, edges[1:-1]))
    return long.sparkSession.createDataFrame(rows, EDGES)


def interval_of(v: Column, edges: dict) -> tuple[Column, Column]:
    """Kind and number of a value's bin, with one feature's edges as literals: some log2(bins) comparisons in generated code."""
    none = v.isNull() | F.isnan(v)
    kind, number = F.when(none, MISSING), F.when(none, 0)
    if edges["use_zero"]:
        kind, number = kind.when(v == 0, ZERO), number.when(v == 0, 0)
    if len(edges["edges"]) < 2:
        return kind.otherwise(WHOLE), number.otherwise(0)
    return kind.otherwise(INTERVAL), number.otherwise(steps(v, edges["interior"], inclusive=False))


def assign_bins(long: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds bin_kind, bin_number to rows of few features. A wide table is better binned by `wide_bins`."""
    kind = number = None
    for e in (r.asDict() for r in edges.collect()):  # a row per feature
        own, (k, n) = F.col("feature") == e["feature"], interval_of(F.col("v"), e)
        kind = F.when(own, k) if kind is None else kind.when(own, k)
        number = F.when(own, n) if number is None else number.when(own, n)
    if kind is None:
        kind, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    return long.select(*long.columns, kind.alias("bin_kind"), number.alias("bin_number"))


def _codes(edges: list[dict], values: bool = False) -> list[Column]:
    each = []
    for e in edges:
        v = F.col(f"`{e['feature']}`").cast("double")
        kind, number = interval_of(v, e)
        own = [F.lit(e["fold"]).alias("fold")] if "fold" in e else []
        each.append(F.struct(*own, F.lit(e["feature"]).alias("feature"), *([v.alias("v")] if values else []), kind.alias("bin_kind"), number.alias("bin_number")))
    return each


def wide_bins(df: DataFrame, edges: DataFrame, keep: list[str], values: bool = False) -> DataFrame:
    """keep, feature, bin_kind, bin_number (and v): every feature's bin is a column of its row before rows are taken apart, so what is counted are bins, not values."""
    each = _codes([r.asDict() for r in edges.collect()], values)  # a row per feature
    return df.select(*keep, F.explode(F.array(*each)).alias("p")).select(*keep, "p.*")


def fit_fold_edges(df: DataFrame, features: list[str], fold: str, k: int = 5, p: WoeParameters = WoeParameters()) -> DataFrame:
    """fold, feature, use_zero, edges, interior: the bins of each fold's training rows (all rows of other folds), for all folds from the same two or three passes."""
    long = long_numeric(df, features, [fold])
    found = {q.group: q for q in select_quantiles(long, ["feature"], "v", p.probabilities(), zero_share=p.min_zero_share if p.separate_zero else None, folds=(fold, k))}
    rows = []
    for i in range(k):
        for feature in features:
            q = found.get((feature, i))
            edges = sorted(set(q.quantiles)) if q and q.quantiles else []
            rows.append((i, feature, bool(q and q.without_zeros), edges, edges[1:-1]))
    return df.sparkSession.createDataFrame(rows, "fold int, " + EDGES)


def fold_table(df: DataFrame, edges: DataFrame, fold: str, label: str, p: WoeParameters = WoeParameters()) -> DataFrame:
    """The evidence table of each fold's training rows: fold (the one left out), feature, bin and what `woe_table` gives. One pass: a row is binned by each
    model that may see it."""
    each = _codes([r.asDict() for r in edges.collect()])  # a row per fold and feature
    seen = df.select(F.col(fold).alias("_own"), label, F.explode(F.array(*each)).alias("p")).select("_own", label, "p.*").where("_own != fold")
    return woe_table(seen, label, ["bin_kind", "bin_number"], p, by=("fold", "feature"))


def kept_categories(long: DataFrame, p: WoeParameters = WoeParameters()) -> DataFrame:
    """feature, c: categories with enough of the known rows. A share of at least min_category_share bounds their number."""
    counts = long.where("c IS NOT NULL").groupBy("feature", "c").agg(F.count("*").alias("n"))
    total = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), "feature").where(F.col("n") / F.col("total") >= p.min_category_share).select("feature", "c")


def fold_categories(long: DataFrame, kept: DataFrame) -> DataFrame:
    """Adds bin_kind, category (null for missing and other)."""
    flagged = long.join(F.broadcast(kept.withColumn("kept", F.lit(True))), ["feature", "c"], "left")
    return flagged.withColumn("bin_kind", F.when(F.col("c").isNull(), MISSING).when(F.col("kept"), CATEGORY).otherwise(OTHER)).withColumn("category", F.when(F.col("kept"), F.col("c"))).drop("kept")


def woe_table(binned: DataFrame, label: str, bins: list[str], p: WoeParameters = WoeParameters(), by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Per feature and bin: n, n_positive, n_negative, rate, shares, woe, iv_term. Windows run over a feature's few bins."""
    t = binned.groupBy(*by, *bins).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("n_positive"))
    all_bins = Window.partitionBy(*by)
    pos, neg = F.col("n_positive") + p.smoothing, F.col("n_negative") + p.smoothing
    return (
        t.withColumn("n_negative", F.col("n") - F.col("n_positive"))
        .withColumn("rate", F.col("n_positive") / F.col("n"))
        .withColumn("positive_share", pos / F.sum(pos).over(all_bins))
        .withColumn("negative_share", neg / F.sum(neg).over(all_bins))
        .withColumn("woe", F.ln(F.col("positive_share") / F.col("negative_share")))
        .withColumn("iv_term", (F.col("positive_share") - F.col("negative_share")) * F.col("woe"))
    )


def numeric_order(table: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds position: bins by left bound, missing last. The first interval is open below; zero's own bin stands at 0, before an interval that starts there. A row of edges per feature."""
    bounds = F.broadcast(edges.select("feature", F.col("interior").alias("_interior")))
    low = F.when(F.col("bin_kind") != INTERVAL, 0.0).when(F.col("bin_number") > 0, F.try_element_at("_interior", F.col("bin_number"))).otherwise(float("-inf"))
    key = [F.col("bin_kind") == MISSING, low, F.col("bin_kind") != ZERO, "bin_number"]
    return table.join(bounds, "feature").withColumn("position", F.row_number().over(Window.partitionBy("feature").orderBy(*key))).drop("_interior")


def category_order(table: DataFrame) -> DataFrame:
    """Adds position: bins by rising woe."""
    return table.withColumn("position", F.row_number().over(Window.partitionBy("feature").orderBy("woe", "bin_kind", "category")))


def information_values(table: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    return table.groupBy(*by).agg(F.sum("iv_term").alias("iv"), F.count("*").alias("n_bins"))


def iv_ranking(values: DataFrame) -> DataFrame:
    """One row per feature, so the window over all is small."""
    return values.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("iv"), "feature"))).select("rank", "feature", "iv", iv_band(F.col("iv")).alias("band"), "n_bins")


def perfect_bins(table: DataFrame, min_rows: int = 30) -> DataFrame:
    return table.where((F.col("n") >= min_rows) & ((F.col("n_positive") == 0) | (F.col("n_negative") == 0))).orderBy(F.desc("iv_term"), "feature")


def iv_difference(left: DataFrame, right: DataFrame, least: float = 1e-9) -> DataFrame:
    """Features whose information value differs between two fits, or is in one only."""
    a, b = left.select("feature", F.col("iv").alias("iv_left")), right.select("feature", F.col("iv").alias("iv_right"))
    both = a.join(b, "feature", "full_outer").withColumn("difference", F.col("iv_left") - F.col("iv_right"))
    return both.where(F.col("difference").isNull() | (F.abs("difference") > least))


class WoeModel:
    """Fit on training rows only; transform is one projection of generated CASE expressions, for tables and streams."""

    def __init__(self, numeric: list[dict], categorical: dict[str, list[str]], woe: dict[tuple, float], table: DataFrame):
        self.numeric, self.categorical, self.woe, self.table = numeric, categorical, woe, table

    @classmethod
    def fit(cls, df: DataFrame, numeric: list[str], label: str, strings: list[str] = (), p: WoeParameters = WoeParameters()) -> WoeModel:
        tables, edges, kept = [], [], {}
        if numeric:
            fitted = fit_edges(long_numeric(df, numeric, []), p, numeric)
            edges = [r.asDict() for r in fitted.collect()]  # a row per feature
            tables.append(numeric_order(woe_table(wide_bins(df, fitted, [label]), label, ["bin_kind", "bin_number"], p), fitted).withColumn("category", F.lit(None).cast("string")))
        if strings:
            long = long_strings(df, list(strings), [label])
            kept_df = kept_categories(long, p)
            for r in kept_df.collect():  # at most 1 / min_category_share rows per feature
                kept.setdefault(r.feature, []).append(r.c)
            rows = [(f, c) for f, cs in kept.items() for c in cs]
            small = df.sparkSession.createDataFrame(rows, "feature string, c string")
            tables.append(category_order(woe_table(fold_categories(long, small), label, ["bin_kind", "category"], p)).withColumn("bin_number", F.lit(0)))
        table = reduce(DataFrame.unionByName, tables)
        rows = table.select("feature", "bin_kind", "bin_number", "category", "woe").collect()  # a row per bin
        woe = {(r.feature, r.bin_kind, r.category if r.bin_kind == CATEGORY else r.bin_number): r.woe for r in rows}
        return cls(edges, {f: kept.get(f, []) for f in strings}, woe, table)

    @classmethod
    def fit_folds(cls, df: DataFrame, numeric: list[str], label: str, fold: str, k: int = 5, p: WoeParameters = WoeParameters()) -> list[WoeModel]:
        """A model for each fold, fitted on the rows of the others: all of them from the passes that one of them would take."""
        fitted = fit_fold_edges(df, numeric, fold, k, p)
        table = fold_table(df, fitted, fold, label, p)
        edges, woe = [[] for _ in range(k)], [{} for _ in range(k)]
        for r in fitted.collect():  # a row per fold and feature
            edges[r.fold].append(r.asDict())
        for r in table.collect():  # a row per fold and bin
            woe[r.fold][r.feature, r.bin_kind, r.bin_number] = r.woe
        return [cls(edges[i], {}, woe[i], table.where(F.col("fold") == i).drop("fold")) for i in range(k)]

    def expression(self, feature: str) -> Column:
        """woe of a feature's value; bins not met in the fit give 0."""
        value = lambda kind, number=0: F.lit(self.woe.get((feature, kind, number), 0.0))
        if feature in self.categorical:
            c = F.col(f"`{feature}`").cast("string")
            chain = F.when(c.isNull(), value(MISSING))
            for x in self.categorical[feature]:
                chain = chain.when(c == x, value(CATEGORY, x))
            return chain.otherwise(value(OTHER))
        e = next(e for e in self.numeric if e["feature"] == feature)
        v = F.col(f"`{feature}`").cast("double")
        chain = F.when(v.isNull() | F.isnan(v), value(MISSING))
        if e["use_zero"]:
            chain = chain.when(v == 0, value(ZERO))
        if len(e["edges"]) < 2:
            return chain.otherwise(value(WHOLE))
        number = steps(v, e["interior"], inclusive=False)
        by_number = F.array(*(value(INTERVAL, i) for i in range(len(e["interior"]) + 1)))
        return chain.otherwise(F.get(by_number, number))

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        names = [e["feature"] for e in self.numeric] + list(self.categorical)
        return df.withColumns({n + suffix: self.expression(n) for n in names})
