import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import session
from riskloom.functions import ordering
from riskloom.functions.ordering import exact_quantiles, global_rank, running_totals, select_quantiles, sliced, value_at, with_ordered_bits
from riskloom.operators import metrics


def test_global_rank(spark):
    rng = np.random.default_rng(4)
    rows = [(int(x), int(y)) for x, y in zip(rng.integers(-20, 20, 400), rng.integers(0, 9, 400))] + [(3, 3)] * 300
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    for chunk in (1 << 20, 7):
        ranked = sorted((r.rank, r.a, r.b) for r in global_rank(df, -F.col("a"), [F.col("b")], chunk=chunk).collect())
        assert [r[0] for r in ranked] == list(range(700))
        assert [(a, b) for _, a, b in ranked] == sorted(rows, key=lambda r: (-r[0], r[1]))


def test_running_totals_are_dealt_evenly(spark):
    """Keys that crowd together still fall into slices of like size."""
    df = spark.range(20_000).select((F.lit(0.999) + F.col("id") / 2e7).alias("p"), F.lit(1).alias("n"), (F.col("id") % 2).alias("g"))
    out = running_totals(df, "p", ["n"], ["g"], slices=64)
    rows = sorted((r.g, r.p, r.n_before, r.n_total) for r in out.collect())
    assert [r[2] for r in rows] == [*range(10_000)] * 2 and {r[3] for r in rows} == {10_000}
    sizes = [r["count"] for r in sliced(df, "p", 64).groupBy("_slice").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 20_000 / 64


EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.2250738585072009e-308, -1e-310, 1.0, 0.9999999999999999, 1.0000000000000002, 1.5, 2.0, 1.9999999999999998, 4.0, 3.9999999999999996, 1e300, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 0.1, -0.1, 1e-5]


def test_ordered_bits_keep_the_order(spark):
    rng = np.random.default_rng(6)
    values = EDGES + rng.normal(size=300).tolist() + np.ldexp(rng.normal(size=300), rng.integers(-1074, 1000, 300)).tolist() + [2.0**k for k in range(-1074, 1024, 37)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    rows = with_ordered_bits(rows, F.col("v"), "k").collect()
    for r in rows:
        assert value_at(r.k) == r.v
    by_value, by_bits = sorted(rows, key=lambda r: r.v), sorted(rows, key=lambda r: r.k)
    assert [r.v for r in by_value] == [r.v for r in by_bits]


def test_quantiles_of_odd_values(spark, monkeypatch):
    """Denormals, negatives, infinities, long ties, NaN and null as missing, groups with a null name, groups whose zeros are left out."""
    rng = np.random.default_rng(7)
    groups = {"odd": EDGES[:18], "ties": [1.0] * 500 + [2.0] * 30, "wide": np.ldexp(rng.normal(size=400), rng.integers(-300, 300, 400)).tolist(), None: rng.normal(size=99).tolist(), "one": [3.5]}
    groups["infinite"] = [float("-inf")] * 40 + rng.normal(size=50).tolist() + [float("inf")] * 10
    rows = [(g, v) for g, x in groups.items() for v in x] + [("odd", None), ("odd", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    probabilities = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    for bits, direct in ((16, 1 << 20), (16, 10), (5, 3)):
        monkeypatch.setattr(ordering, "DIRECT", direct)
        got = {r.g: r.quantiles for r in exact_quantiles(df, ["g"], "v", probabilities, bits).collect()}
        assert set(got) == set(groups)
        for g, x in groups.items():
            with np.errstate(all="ignore"):
                low, high = (np.quantile(x, probabilities, method=m) for m in ("lower", "higher"))
            for value, a, b, p in zip(got[g], low, high, probabilities):
                part = (len(x) - 1) * p % 1
                assert value == (a if a == b else a + (b - a) * part) or abs(value - np.quantile(x, p)) <= 1e-12 * abs(value), (g, p)
    zeros = spark.createDataFrame([("z", v) for v in [0.0] * 10 + [-1.0, 2.0, 3.0]] + [("few", v) for v in [0.0] + [1.0] * 99], "g string, v double")
    found = {q.group[0]: q for q in select_quantiles(zeros, ["g"], "v", [0.0, 0.5], zero_share=0.05)}
    assert found["z"].quantiles == [-1.0, 2.0] and found["z"].without_zeros and found["z"].zeros == 10
    assert found["few"].quantiles == [0.0, 1.0] and not found["few"].without_zeros


def test_metrics_of_crowded_scores(spark):
    """All scores above 0.999, and nine tenths of the rows with one score: equal to plain counting, and no slice holds more than twice its share of distinct scores."""
    rng = np.random.default_rng(8)
    for p in (0.999 + rng.random(4000) / 1000, np.where(rng.random(4000) < 0.9, 0.7, rng.random(4000))):
        y = (rng.random(4000) < 0.3).astype(int)
        df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
        r = metrics.evaluate(df, 0.7).first()
        pos, neg = p[y == 1], p[y == 0]
        wins = np.searchsorted(np.sort(neg), pos, "left").sum() + 0.5 * (np.searchsorted(np.sort(neg), pos, "right") - np.searchsorted(np.sort(neg), pos, "left")).sum()
        cuts = [(pos >= t).mean() - (neg >= t).mean() for t in np.unique(p)]
        tp, fp, fn = (pos >= 0.7).sum(), (neg >= 0.7).sum(), (pos < 0.7).sum()
        assert (r.auc, r.ks, r.precision, r.recall) == pytest.approx((wins / len(pos) / len(neg), max(0, *cuts), tp / (tp + fp), tp / (tp + fn)), abs=1e-9)
        distinct = df.select("p").distinct()
        sizes = [x["count"] for x in sliced(distinct, "p", 32).groupBy("_slice").count().collect()]
        assert max(sizes) <= 2 * distinct.count() / 32


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        master, applicationId = "spark://somewhere:7077", "app-1"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Cluster()

    with pytest.raises(ValueError):
        session.scratch_path(Session(), "x")
    first, second = session.scratch_path(spark, "a"), session.scratch_path(spark, "a")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
