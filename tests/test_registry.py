from functools import partial

import pytest
from compare import rows_of, run_sql

from riskloom.operators import models
from riskloom.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    got, expected = registry.queries()[name](spark, SMALL).toPandas(), run_sql(SMALL, registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


def test_queries_without_sql():
    rest = set(registry.queries()) - set(registry.oracle_sql())
    assert rest == {"permuted_labels", "cv_model_comparison", "cv_fold_detail", "cv_track_models", "cv_track_difference", "cv_without_shells", "oof_scores", "oof_capacity_plan", "permutation_control", "tree_shap_global", "tree_shap_local", "forest_shap_rows"}


def test_tree_queries(spark, monkeypatch):
    """With few trees."""
    monkeypatch.setattr(models, "fit", partial(models.fit, trees=3))
    assert registry.queries()["tree_shap_global"](spark, SMALL).count() == 4
    local = registry.queries()["tree_shap_local"](spark, SMALL).collect()
    assert sorted((r.label, r.feature) for r in local) == sorted((y, f) for y in (0, 1) for f in registry.MODEL_FEATURES)
    assert all(r.gap < 1e-6 for r in local)
    rows = registry.queries()["forest_shap_rows"](spark, SMALL).collect()
    assert len(rows) == 4 * len({r.doc_id for r in rows}) and all(r.gap < 1e-6 and 0 <= r.value_rank <= 1 for r in rows)


def test_out_of_fold_capacity(spark, monkeypatch):
    """Thresholds, alert rates, recall and cost as counted from the boosted scores themselves, with few trees."""
    monkeypatch.setattr(models, "fit", partial(models.fit, trees=3))
    monkeypatch.setattr(registry, "_source", lambda *_: "capacity with 3 trees")  # both queries take the same scores
    scores = registry.queries()["oof_scores"](spark, SMALL).toPandas()
    plan = registry.queries()["oof_capacity_plan"](spark, SMALL).collect()
    assert {r.cap for r in plan} == set(registry._CAPS)
    for r in plan:
        rates = [(t, (scores.p >= t).mean()) for t in (i / 100 for i in range(1, 100))]
        kept = [(t, a) for t, a in rates if a <= r.cap]
        assert r.feasible == bool(kept)
        if kept:
            alarm, junk = scores.p >= kept[0][0], scores.junk == 1
            assert (r.threshold, r.alert_rate, r.recall) == pytest.approx((kept[0][0], kept[0][1], (alarm & junk).sum() / junk.sum()), abs=1e-6)
            assert r.cost == 20.0 * (~alarm & junk).sum() + (alarm & ~junk).sum()


def test_track_queries(spark, monkeypatch):
    monkeypatch.setattr(models, "fit", partial(models.fit, trees=2))
    monkeypatch.setattr(registry, "_source", lambda *_: None)
    detail = registry.queries()["cv_fold_detail"](spark, SMALL).collect()
    assert sorted((r.model, r.fold) for r in detail) == sorted((m, i) for m in models.MODELS for i in range(5))
    got = registry.queries()["cv_track_difference"](spark, SMALL).collect()
    assert {(r.model, r.metric) for r in got} == {(m, x) for m in models.MODELS for x in ("auc", "ks", "f1", "precision", "recall")}
    assert all(abs(r.difference - (r.left - r.right)) < 1e-4 for r in got)


def test_profile_is_joined_once(spark, monkeypatch):
    """All passes of the evidence of two tracks, and the next query on the same files, read one written profile."""
    asked, plain = [], registry.address_profile
    monkeypatch.setattr(registry, "address_profile", lambda *a: asked.append(a) or plain(*a))
    monkeypatch.setattr(registry, "source_mark", lambda *_: "joined once")
    for name in ("iv_two_tracks", "iv_shell_effect"):
        out = registry.queries()[name](spark, SMALL)
        assert all("orders.parquet" not in f and "events.parquet" not in f for f in out.inputFiles())
    assert len(asked) == 1
