"""Edge cases of bins, evidence, metrics and decisions on small tables."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.functions import ordering, scalars
from riskloom.operators import folds, metrics, prepare, profile, report, thresholds, woe
from riskloom.sources.catalog import Feature, FeatureCatalog

LONG = "feature string, v double, y int"


def table_of(spark, values, p=woe.WoeParameters()):
    long = spark.createDataFrame([("f", v, y) for v, y in values], LONG)
    edges = woe.fit_edges(long, p)
    return woe.numeric_order(woe.woe_table(woe.assign_bins(long, edges), "y", ["bin_kind", "bin_number"], p), edges).orderBy("position").collect()


def test_an_edge_belongs_to_the_lower_bin(spark):
    model = woe.WoeModel.fit(spark.createDataFrame([(float(i), i % 2) for i in range(1, 101)], "x double, y int"), ["x"], "y")
    bound = model.numeric[0]["interior"][0]
    rows = spark.createDataFrame([(bound,), (bound + 1e-9,), (-1e9,), (1e9,)], "x double")
    got = [r.x for r in model.transform(rows).collect()]
    assert got[0] == model.woe["x", "interval", 0] and got[1] == model.woe["x", "interval", 1]
    assert got[2] == got[0] and got[3] == model.woe["x", "interval", 9]


@pytest.mark.parametrize(
    "values,kinds",
    [
        ([(5.0, 1), (5.0, 0)], ["whole"]),
        ([(0.0, 1), (0.0, 0)], ["zero"]),
        ([(None, 1), (None, 0)], ["missing"]),
        ([(0.0, 1), (1.0, 0), (1.0, 1)], ["zero", "whole"]),
        ([(0.0, 0), (2.0, 1), (3.0, 0), (None, 1)], ["interval", "zero", "interval", "missing"]),
    ],
)
def test_degenerate_bins(spark, values, kinds):
    assert [r.bin_kind for r in table_of(spark, values)] == kinds


def test_bins_stand_in_the_order_of_their_left_bounds(spark):
    values = [(float(i), i % 2) for i in range(-50, 51) if i] + [(0.0, 1)] * 20 + [(None, 0)]
    rows = table_of(spark, values)
    edges = woe.fit_edges(spark.createDataFrame([("f", v, y) for v, y in values], LONG)).first().interior
    low = [0.0 if r.bin_kind == "zero" else float("inf") if r.bin_kind == "missing" else edges[r.bin_number - 1] if r.bin_number else float("-inf") for r in rows]
    assert low == sorted(low) and 0 < [r.bin_kind for r in rows].index("zero") < len(rows) - 2 and rows[-1].bin_kind == "missing"


def test_steps_count_bounds(spark):
    bounds = [0.1, 0.2, 0.5, 0.9]
    df = spark.createDataFrame([(x,) for x in (None, -1.0, 0.1, 0.15, 0.2, 0.5, 0.91)], "v double")
    got = df.select("v", scalars.steps(F.col("v"), bounds, True).alias("reached"), scalars.steps(F.col("v"), bounds, False).alias("passed"), scalars.steps(F.col("v"), [], True).alias("none")).collect()
    for r in got:
        known = r.v is not None
        assert (r.reached, r.passed, r.none) == (sum(known and r.v >= b for b in bounds), sum(known and r.v > b for b in bounds), 0)


def test_zero_bin_needs_its_share(spark):
    rare = [(0.0, 0)] * 4 + [(float(i), i % 2) for i in range(1, 97)]
    assert "zero" not in [r.bin_kind for r in table_of(spark, rare)]
    assert "zero" in [r.bin_kind for r in table_of(spark, rare + [(0.0, 1)] * 2)]


def test_smoothing_and_sums(spark):
    rows = table_of(spark, [(float(i % 7), int(i % 7 < 2)) for i in range(700)])
    assert sum(r.n for r in rows) == 700
    assert sum(r.positive_share for r in rows) == pytest.approx(1) and sum(r.negative_share for r in rows) == pytest.approx(1)
    assert all(r.iv_term >= 0 and math.isfinite(r.woe) for r in rows)
    first, k = rows[0], len(rows)
    share = (first.n_positive + 0.5) / (sum(r.n_positive for r in rows) + 0.5 * k)
    other = (first.n_negative + 0.5) / (sum(r.n_negative for r in rows) + 0.5 * k)
    assert first.woe == pytest.approx(math.log(share / other)) and first.iv_term == pytest.approx((share - other) * math.log(share / other))


def test_categories(spark):
    rows = [("a", 1)] * 98 + [("0", 0), ("missing", 1)] + [(None, 1)] * 5
    df = spark.createDataFrame(rows, "c string, y int")
    model = woe.WoeModel.fit(df, [], "y", ["c"])
    assert {(r.bin_kind, r.category) for r in model.table.collect()} == {("category", "a"), ("category", "0"), ("category", "missing"), ("missing", None)}
    rarer = woe.WoeModel.fit(df, [], "y", ["c"], woe.WoeParameters(min_category_share=0.011))
    assert {(r.bin_kind, r.category) for r in rarer.table.collect()} == {("category", "a"), ("other", None), ("missing", None)}
    assert [round(r.c, 9) for r in rarer.transform(spark.createDataFrame([("new",), ("0",)], "c string")).collect()] == [round(rarer.woe["c", "other", 0], 9)] * 2
    assert model.transform(spark.createDataFrame([("new",)], "c string")).first().c == 0.0


def test_unseen_missing_is_neutral(spark):
    model = woe.WoeModel.fit(spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 1)], "x double, y int"), ["x"], "y")
    assert model.transform(spark.createDataFrame([(None,)], "x double")).first().x == 0.0


def test_bands(spark):
    values = [0.0199, 0.02, 0.0999, 0.1, 0.3, 0.5]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").select(scalars.iv_band(F.col("v")).alias("b")).collect()]
    assert got == ["unpredictive", "weak", "weak", "medium", "strong", "suspicious"]


def test_labels(spark):
    df = spark.createDataFrame([("(1.5, 2.0]",), ("(-inf, 3]",), ("zero",), ("missing",)], "s string")
    assert [r.b for r in df.select(scalars.interval_left_bound(F.col("s")).alias("b")).collect()] == [1.5, -math.inf, 0.0, math.inf]
    lo, hi = F.lit(None).cast("double"), F.lit(2.5)
    assert df.select(scalars.interval_label(lo, hi).alias("l")).first().l == "(-inf, 2.5]"
    assert df.select(scalars.round_half_even(F.lit(2.5), 0).alias("r")).first().r == 2.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, 2.0])), min_size=1, max_size=60), st.sampled_from([4, 16]))
def test_quantiles_equal_numpy(spark, values, bits):
    known = [v for v in values if v is not None]
    probabilities = [0.0, 0.1, 0.5, 0.77, 1.0]
    rows = ordering.exact_quantiles(spark.createDataFrame([("a", v) for v in values], "g string, v double"), ["g"], "v", probabilities, bits=bits).collect()
    if known:
        assert rows[0].quantiles == pytest.approx(np.quantile(known, probabilities).tolist(), abs=1e-6)
    else:
        assert rows == []


def test_folds_are_even_and_stable(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(503)], "id long, y int")
    rows = folds.stratified_folds(df.repartition(7), "id", "y", 5).collect()
    for y in (0, 1):
        sizes = np.bincount([r.fold for r in rows if r.y == y])
        assert len(sizes) == 5 and sizes.max() - sizes.min() <= 1
    assert {(r.id, r.fold) for r in rows} == {(r.id, r.fold) for r in folds.stratified_folds(df, "id", "y", 5).collect()}
    split = folds.stratified_split(df, "id", "y", 0.2).groupBy("y").agg(F.count_if("is_test").alias("n")).collect()
    assert {r.y: r.n for r in split} == {1: 10, 0: 90}
    dealt = folds.permuted_labels(df, "id", "y").collect()
    assert len(dealt) == 503 and sum(r.y for r in dealt) == 51 and any(r.y != int(r.id % 10 == 0) for r in dealt)


SCORES = [(0.1, 0), (0.1, 1), (0.5, 1), (0.5, 0), (0.5, 1), (1.0, 1), (0.0, 0), (0.8, 0)]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame(SCORES, "p double, y int")
    pairs = [(a > b) + 0.5 * (a == b) for a, y in SCORES if y for b, z in SCORES if not z]
    assert metrics.auc(df).first().auc == pytest.approx(sum(pairs) / len(pairs))
    gaps = [np.mean([p >= t for p, y in SCORES if y]) - np.mean([p >= t for p, y in SCORES if not y]) for t in (0, 0.1, 0.5, 0.8, 1, 2)]
    assert metrics.ks(df).first().ks == pytest.approx(max(gaps))
    c = metrics.confusion(df, 0.5).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (3, 2, 1, 2)
    inverted = spark.createDataFrame([(1.0 - y, y) for _, y in SCORES], "p double, y int")
    assert metrics.ks(inverted).first().ks == 0 and metrics.auc(inverted).first().auc == 0


def test_one_class_only(spark):
    df = spark.createDataFrame([(0.2, 0), (0.9, 0)], "p double, y int")
    assert metrics.auc(df).first().auc is None
    c = metrics.confusion(df, 0.5).first()
    assert (c.recall, c.f1, c.precision) == (0.0, 0.0, 0.0)
    assert thresholds.sweep(df).where("recall != 0").count() == 0


def test_sweep_properties(spark):
    df = spark.createDataFrame([(round(i / 200, 3), int(i * 7 % 11 < i / 30)) for i in range(201)], "p double, y int")
    rows = thresholds.sweep(df).orderBy("threshold").collect()
    positives = sum(r.y for r in df.collect())
    assert len(rows) == 99 and [r.threshold for r in rows][:3] == [0.01, 0.02, 0.03]
    assert all(r.tp + r.fn == positives and r.tp + r.fp + r.fn + r.tn == 201 for r in rows)
    assert all(a.recall >= b.recall for a, b in zip(rows, rows[1:]))
    table = thresholds.sweep(df)
    assert thresholds.min_cost(table, 5, 1).first().threshold == thresholds.min_cost(table, 500, 100).first().threshold
    best = min(rows, key=lambda r: (r.fn * 5 + r.fp, r.threshold))
    assert thresholds.min_cost(table, 5, 1).first().threshold == best.threshold
    plan = {r.cap: r for r in thresholds.capacity(table, [0.5, 0.0]).collect()}
    assert not plan[0.0].feasible and "0.0 %" in plan[0.0].reason and plan[0.5].threshold == min(r.threshold for r in rows if r.alert_rate <= 0.5)


def test_published_costs(spark):
    """Published confusion counts and their costs at a false alarm's cost of 1."""
    rows = [(1, 229, 61, 290), (5, 60, 419, 719), (10, 54, 463, 1003), (20, 32, 748, 1388), (50, 26, 1003, 2303)]
    table = thresholds.with_cost(spark.createDataFrame(rows, "ratio int, fn long, fp long, expected int"), F.col("ratio"), 1)
    assert all(r.cost == r.expected for r in table.collect())


CATALOG = FeatureCatalog("k", "y", "i", (Feature("a", "g"), Feature("b", "g"), Feature("c", "g"), Feature("s", "g")))
RAW = [(0, "x", 1, 1.0, None, 0, "u"), (1, "x", 0, 2.0, 3.0, 0, "v"), (2, "y", 0, None, 0.0, None, "w"), (3, "z", 0, 0.0, None, 0, None)]


def test_tracks(spark):
    df = spark.createDataFrame(RAW, "i long, k string, y int, a double, b double, c int, s string").repartition(3)
    full = prepare.build_track(df, CATALOG, prepare.FULL, "b", include_strings=True)
    rows = {r.i: r for r in full.data.collect()}
    assert sorted(rows) == [0, 2, 3] and full.features == ["a", "history_missing"] and full.strings == ["s"]  # b is {0, null}: constant
    assert [rows[i].history_missing for i in (0, 2, 3)] == [1, 0, 1] and rows[2].a == 0.0
    log = full.log.first()
    assert (log.rows_in, log.duplicates_removed, log.constants_removed, log.cells_filled) == (4, 1, 2, 1)
    with pytest.raises(ValueError):
        prepare.build_track(df, CATALOG, "other")
    left = {r.is_shell: r for r in prepare.residual_leakage(full.data, ["a"], "y").collect()}
    assert left[True].n == 2 and left[False].n == 1
    assert {r.is_shell: r.n for r in prepare.residual_leakage(full.data.where("a > 0"), ["a"], "y").collect()} == {True: 0, False: 1}


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 1), (None, 0), (None, 0)], "k string, y int")
    assert tuple(profile.duplicate_keys(df, "k").first()) == (6, 3, 3)
    assert tuple(profile.label_conflicts(df, "k", "y").first()) == (3, 1)
    assert profile.full_row_duplicates(df, ["k", "y"]).first()[0] == 2


def test_states(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (0.0, 0), (3.0, 1), (4.0, 0), (-1.0, 1)], "x double, y int")
    rows = {r.state: r for r in profile.state_leakage(df, "x", "y").collect()}
    assert set(rows) == {"missing", "zero", "positive"} and rows["missing"].is_perfect and rows["zero"].is_perfect and not rows["positive"].is_perfect


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", 1.5), (None, None)], "x string, v double").orderBy("v")
    assert report.markdown_table(df).splitlines() == ["| x | v |", "| --- | --- |", "|  |  |", "| a\\|b | 1.5 |"]
    with pytest.raises(ValueError):
        report.markdown_table(spark.range(2000))
    text = report.data_dictionary(profile.column_profile(spark.createDataFrame([(1, 2.0)], "a int, b double"), ["a", "b"], CATALOG.table(spark)), CATALOG.table(spark))
    assert text.startswith("# Data dictionary") and "## g" in text
