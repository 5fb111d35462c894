import inspect
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import explain, logistic, metrics, models
from riskloom.operators.woe import WoeModel
from riskloom.plans import registry
from riskloom.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(int)
    return spark.createDataFrame([(i, int(t), *map(float, v)) for i, (v, t) in enumerate(zip(x, y))], "id long, y int, a double, b double, c double").cache()


def test_cross_validation_and_control(rows):
    detail = models.cross_validate(rows, models.LOGISTIC, ["a", "b", "c"], "id", "y", k=3).collect()
    assert [r.fold for r in sorted(detail, key=lambda r: r.fold)] == [0, 1, 2] and all(r.auc > 0.9 for r in detail)
    control = models.permutation_control(rows, models.LOGISTIC, ["a", "b", "c"], "id", "y", k=3)
    assert abs(control.agg(F.avg("auc")).first()[0] - 0.5) < 0.12
    assert models.out_of_fold(rows, models.FOREST, ["a", "b", "c"], "id", "y", k=2, trees=5).select("id").distinct().count() == 400
    with pytest.raises(ValueError):
        models.make_estimator("other", 1)


def test_registered_models_are_whole(spark, monkeypatch):
    """All models, folds and trees are asked for."""
    asked, stop = [], RuntimeError("asked")

    def fold_scores(folded, name, features, label, k, parallel, **how):
        asked.append((name, k, how))
        return folded.withColumn("p", F.lit(0.5))

    def fit(df, name, features, label, **how):
        asked.append((name, how))
        raise stop

    monkeypatch.setattr(models, "_fold_scores", fold_scores)
    monkeypatch.setattr(registry, "_source", lambda *_: None)  # nothing is taken from elsewhere
    assert inspect.signature(models.fit).parameters["trees"].default == 300
    monkeypatch.setattr(models, "fit", fit)
    small, queries, all_three = "/root/testdata/sf0.001", registry.queries(), [(n, 5, {}) for n in (models.LOGISTIC, models.BOOSTING, models.FOREST)]
    assert "text" in queries["cv_model_comparison"](spark, small).columns and asked == all_three
    for name, times in (("cv_fold_detail", 1), ("cv_track_models", 2), ("cv_track_difference", 2), ("cv_without_shells", 2)):
        asked.clear()
        rows = queries[name](spark, small).collect()
        assert asked == all_three * times and len(rows) == {"cv_fold_detail": 15, "cv_track_models": 30}.get(name, 15)
    for name in ("permutation_control", "oof_scores", "oof_capacity_plan"):
        asked.clear()
        queries[name](spark, small)
        assert asked == [(models.BOOSTING, 5, {})]
    asked.clear()
    with pytest.raises(RuntimeError):
        queries["tree_shap_global"](spark, small)
    assert asked == [(models.BOOSTING, {})]


def test_newton_equals_the_library(rows):
    """Penalised coefficients, as MLlib's own optimiser finds them."""
    from pyspark.ml.classification import LogisticRegression

    model = models.fit(rows, models.LOGISTIC, ["a", "b", "c"], "y")
    data = VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="features").transform(rows.select(F.col("y").cast("double").alias("y"), *(model.woe.expression(f).alias(f"x{i}") for i, f in enumerate(("a", "b", "c")))))
    expected = LogisticRegression(labelCol="y", maxIter=2000, tol=1e-14, regParam=1.0 / rows.count(), elasticNetParam=0.0, standardization=False).fit(data)
    assert model.model.coefficients == pytest.approx(expected.coefficients.toArray().tolist(), abs=1e-6)
    assert model.model.intercept == pytest.approx(expected.intercept, abs=1e-6) and model.model.steps < 15


def test_newton_of_separated_rows(spark):
    """Steps that would overshoot are halved; the penalty keeps the optimum finite."""
    rows = spark.createDataFrame([(0, float(x), 50.0, 50.0 if x > 0 else 0.0) for x in (-30, -20, 10, 40)], "fold int, x double, n double, pos double")
    model = logistic.fit_counted(rows, ["x"], "fold", penalty=1e-4)[0]
    p = [1 / (1 + math.exp(-(model.intercept + model.coefficients[0] * x))) for x in (-20, 10)]
    gradient = sum((n * (1 / (1 + math.exp(-(model.intercept + model.coefficients[0] * x)))) - pos) * x for _, x, n, pos in rows.collect()) + 1e-4 * model.coefficients[0]
    assert p[0] < 0.1 < 0.9 < p[1] and abs(gradient) < 1e-5


def test_all_folds_equal_each_alone(rows):
    """Evidence, coefficients and scores of five training folds from common passes, as from five fits."""
    features, fold = ["a", "b", "c"], (F.col("id") % 5).cast("int")
    odd = rows.withColumn("a", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("a"))).withColumn("fold", fold).cache()
    together = WoeModel.fit_folds(odd, features, "y", "fold", 5)
    scorers = models._logistic(odd, together, features, "y", "fold")
    for i in range(5):
        alone = models.fit(odd.where(F.col("fold") != i), models.LOGISTIC, features, "y")
        pick = lambda m: {e["feature"]: (e["use_zero"], e["edges"]) for e in m.numeric}
        assert pick(together[i]) == pick(alone.woe)
        assert together[i].woe.keys() == alone.woe.woe.keys() and all(together[i].woe[x] == pytest.approx(alone.woe.woe[x], abs=1e-12) for x in alone.woe.woe)
        assert scorers[i].model.coefficients == pytest.approx(alone.model.coefficients, abs=1e-8)


def test_score_store_is_pruned(rows):
    """Each row scored once a track and model; a reader of one model and fold opens only its files."""
    tracks = {"wide": (rows, ["a", "b", "c"]), "narrow": (rows, ["a"])}
    store = models.score_store(rows.sparkSession, tracks, (models.LOGISTIC, models.BOOSTING), "id", "y", k=2, trees=2)
    counts = {(r.track, r.model): (r.n, r.d) for r in store.groupBy("track", "model").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).collect()}
    assert counts == {(t, m): (400, 400) for t in tracks for m in (models.LOGISTIC, models.BOOSTING)}
    some = store.where("track = 'wide' AND model = 'boosting' AND fold = 1")
    assert 0 < len(some.inputFiles()) and all("track=wide/model=boosting/fold=1" in f for f in {r[0] for r in some.select(F.input_file_name()).distinct().collect()})
    detail = models.fold_metrics(store, "y").collect()
    assert len(detail) == 8 and all(r.auc == pytest.approx(auc_of([x for x in store.where(f"track = '{r.track}' AND model = '{r.model}' AND fold = {r.fold}").collect()]), abs=1e-9) for r in detail)


def test_forest_depth_is_the_librarys_limit(spark):
    assert models.make_estimator(models.FOREST, 1).getMaxDepth() == 30


def auc_of(rows):
    good, bad = [r.p for r in rows if r.y], [r.p for r in rows if not r.y]
    return np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])


def test_comparison_values(rows):
    how = {"k": 2, "trees": 2}
    summary, detail = models.compare(rows, ["a", "b", "c"], "id", "y", (models.BOOSTING,), **how)
    scores = models.out_of_fold(rows, models.BOOSTING, ["a", "b", "c"], "id", "y", **how).collect()
    expected = [auc_of([r for r in scores if r.fold == i]) for i in range(2)]
    assert [r.auc for r in sorted(detail.collect(), key=lambda r: r.fold)] == pytest.approx(expected, abs=1e-6)
    auc = summary.where("metric = 'auc'").first()
    assert (auc.mean, auc.deviation) == pytest.approx((np.mean(expected), np.std(expected, ddof=1)), abs=1e-6)


def test_track_difference(spark):
    """G11: two tracks side by side, by model and metric."""
    names = "model string, fold int, auc double, ks double, f1 double, precision double, recall double"
    full = spark.createDataFrame([("m", 0, 0.9, 0.8, 0.7, 0.6, 0.5), ("m", 1, 0.7, 0.6, 0.5, 0.4, 0.3)], names)
    no_leak = spark.createDataFrame([("m", 0, 0.6, 0.8, 0.5, 0.6, 0.4), ("m", 1, 0.6, 0.5, 0.5, 0.4, 0.5)], names)
    got = {r.metric: r.difference for r in metrics.track_difference(metrics.fold_summary(full), metrics.fold_summary(no_leak)).collect()}
    assert got == pytest.approx({"auc": 0.2, "ks": 0.05, "f1": 0.1, "precision": 0.0, "recall": -0.05})


def test_comparison_without_shells(spark, rows):
    """G12: rows whose features are all 0 go, no others; the rerun then has the rows it would have had without them."""
    shells = spark.createDataFrame([(1000, 1, 0.0, 0.0, 0.0), (1001, 0, 0.0, 0.0, 0.0)], rows.schema)
    nearly = spark.createDataFrame([(1002, 1, 0.0, 0.0, 1.0), (1003, 0, None, 0.0, 0.0)], rows.schema)
    kept = models.without_shells(rows.unionByName(shells).unionByName(nearly), ["a", "b", "c"])
    assert kept.count() == rows.count() + 2 and kept.where("id in (1000, 1001)").count() == 0


def brute_shapley(tree, x, m):
    def worth(known, node=0):
        if tree.feature[node] < 0:
            return tree.value[node]
        f = tree.feature[node]
        left, right = tree.left[node], tree.right[node]
        if f in known:
            return worth(known, left if x[f] <= tree.threshold[node] else right)
        return (tree.cover[left] * worth(known, left) + tree.cover[right] * worth(known, right)) / tree.cover[node]

    phi = np.zeros(m)
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        for k in range(m):
            for s in itertools.combinations(rest, k):
                phi[i] += (worth({*s, i}) - worth(set(s))) * math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
    return phi


def test_tree_values(spark, rows, tmp_path):
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)
    model = GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, stepSize=0.3, seed=1).fit(data)
    trees = explain.trees_of(spark, model, str(tmp_path / "model"))
    x = np.array([[r.a, r.b, r.c] for r in rows.orderBy("id").limit(12).collect()])
    for tree in trees:
        got = explain.tree_values(tree, x, 3)
        for i in range(len(x)):
            assert got[i] == pytest.approx(brute_shapley(tree, x[i], 3), abs=1e-9)
    phi = explain.tree_shap(rows, "id", ["a", "b", "c"], trees)
    scores = model.transform(data).select("id", vector_to_array("probability")[1].alias("p"))
    base = spark.createDataFrame([(2.0 * explain.tree_base(trees),)], "base double")
    check = explain.additivity(phi, base, scores, "id").first()
    assert check.passed and check.max_error < 1e-6
    assert [r.feature for r in explain.global_importance(phi, 1).collect()] == ["a"]
    assert explain.local_explanation(phi, "id", 3).count() == 3
    p = scores.where("id = 3").first().p
    assert explain.local_summary(phi, base, "id", 3).first().p == pytest.approx(p)


def test_forest_values(spark, rows, tmp_path):
    """Leaves are class shares; deep trees on few features; values add up to the probability."""
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)
    model = RandomForestClassifier(labelCol="y", numTrees=5, maxDepth=30, minInstancesPerNode=2, seed=1).fit(data)
    trees = explain.trees_of(spark, model, str(tmp_path / "model"))
    x = np.array([[r.a, r.b, r.c] for r in rows.orderBy("id").limit(10).collect()])
    depth = lambda t, node=0: 0 if t.feature[node] < 0 else 1 + max(depth(t, t.left[node]), depth(t, t.right[node]))
    assert max(map(depth, trees)) > 6
    for tree in trees:
        got = explain.tree_values(tree, x, 3)
        for i in range(len(x)):
            assert got[i] == pytest.approx(brute_shapley(tree, x[i], 3), abs=1e-9)
    phi = explain.tree_shap(rows, "id", ["a", "b", "c"], trees, scale=1.0)
    total, base = {r.id: r.t for r in phi.groupBy("id").agg(F.sum("phi").alias("t")).collect()}, explain.tree_base(trees)
    for r in model.transform(data).select("id", vector_to_array("probability")[1].alias("p")).collect():
        assert base + total[r.id] == pytest.approx(r.p, abs=1e-9)


def test_tree_values_of_many_features():
    """A hand-made tree with seven features, some asked twice on a path."""
    rng = np.random.default_rng(3)
    feature, threshold, left, right, cover = [], [], [], [], []

    def grow(n, depth):
        node = len(feature)
        for column, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (cover, float(n))):
            column.append(v)
        if depth and n > 3:
            feature[node], threshold[node], cut = int(rng.integers(7)), float(rng.normal()), int(rng.integers(1, n))
            left[node] = grow(cut, depth - 1)
            right[node] = grow(n - cut, depth - 1)
        return node

    grow(200, 9)
    tree = explain.Tree(*map(np.array, (feature, threshold, left, right, rng.normal(size=len(feature)), cover)))
    x = rng.normal(size=(6, 7))
    got = explain.tree_values(tree, x, 7)
    for i in range(6):
        assert got[i] == pytest.approx(brute_shapley(tree, x[i], 7), abs=1e-9)


def test_scores_of_one_source_are_shared(rows, monkeypatch):
    """What was scored before is read; another source, another model or another number of folds is not."""
    asked, plain = [], models._fold_scores

    def fold_scores(folded, name, *rest, **how):
        asked.append(name)
        return plain(folded, name, *rest, **how)

    monkeypatch.setattr(models, "_fold_scores", fold_scores)
    ask = lambda source, names, k=2: models.score_store(rows.sparkSession, {"t": (rows, ["a"])}, names, "id", "y", k=k, source=source)
    first = ask("one", (models.LOGISTIC,))
    again = ask("one", (models.LOGISTIC,))
    assert asked == [models.LOGISTIC] and sorted(first.collect()) == sorted(again.collect())
    ask("one", (models.LOGISTIC,), 3)
    ask("two", (models.LOGISTIC,))
    assert asked == [models.LOGISTIC] * 3
    with pytest.raises(ValueError):
        models.score_store(rows.sparkSession, {"t": (rows, ["b"])}, (models.LOGISTIC,), "id", "y", k=2, source="one")


def test_value_ranks_equal_percent_rank(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f, float(v), 0.1) for f, x in (("a", rng.integers(0, 5, 60)), ("b", rng.normal(size=60)), ("one", [1.0])) for i, v in enumerate(x)] + [(99, "a", None, 0.1)]
    df = spark.createDataFrame(rows, "id long, feature string, value double, phi double")
    got = {(r.id, r.feature): r.value_rank for r in explain.with_value_rank(df).collect()}
    expected = df.where("value IS NOT NULL").withColumn("r", F.expr("percent_rank() OVER (PARTITION BY feature ORDER BY value)")).collect()
    assert len(got) == len(rows) and got[99, "a"] is None and all(got[r.id, r.feature] == pytest.approx(r.r) for r in expected)


def test_stream_equals_table(spark, rows, tmp_path):
    model = WoeModel.fit(rows, ["a", "b"], "y")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    how = (model, {"a": 1.0, "b": 0.5}, -0.1, 0.4)
    q = score_stream(stream, *how).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.id, round(r.p, 9), r.alarm)
    assert sorted(map(key, spark.table("scored").collect())) == sorted(map(key, score_stream(rows, *how).collect()))
