"""Property checks for queries without an exact oracle, and metamorphic
checks across queries."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from twotier.models import prepare as pp
from twotier.operators import sampling as sp
from twotier.plans.common import labelled_flows, scored_flows

Q = E.queries()


@pytest.mark.parametrize("name", ["rf_l1", "dt", "logreg", "gbt_l1", "extra_trees", "svm_kernel", "mlp"])
def test_classifier_beats_majority(spark, sf_dir, name):
    r = Q[name](spark, sf_dir).first()
    total = r["tn"] + r["fp"] + r["fn"] + r["tp"]
    majority = max(r["tn"] + r["fp"], r["fn"] + r["tp"]) / total
    assert total > 0
    assert r["accuracy"] >= majority - 0.02
    assert r["tp"] > 0 and r["mcc"] > 0.3  # detects attacks, not a constant predictor


def test_model_roundtrip_identical(spark, sf_dir):
    r = Q["model_roundtrip"](spark, sf_dir).first()
    assert r["n"] > 0 and r["n"] == r["n_equal"]


def test_rf_importance_sums_to_one(spark, sf_dir):
    rows = Q["rf_importance"](spark, sf_dir).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0, abs=1e-6)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)


def test_pca_orthonormal_minimal_k_and_signs(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = e.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("vec"))
    m = pp.fit_pca(v, "vec", 0.95)
    c = m.components
    assert np.allclose(c.T @ c, np.eye(m.k), atol=1e-8)
    ev_all = np.array(m.model.explainedVariance.toArray())
    assert ev_all[:m.k].sum() >= 0.95 - 1e-9
    assert m.k == 1 or ev_all[:m.k - 1].sum() < 0.95
    for j in range(m.k):
        assert c[np.argmax(np.abs(c[:, j])), j] > 0
    out = m.transform(e.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("vec")),
                      "vec", ["vec_id"])
    means = out.agg(*[F.avg(f"PC{j + 1}") for j in range(m.k)]).first()
    assert all(abs(x) < 1e-6 for x in means)  # centred projection


def test_confusion_sums_to_rows(spark, sf_dir):
    n = labelled_flows(spark, sf_dir).count()
    r = Q["confusion"](spark, sf_dir).first()
    assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == n


def test_layer1_negatives_equal_layer2_total_plus_quarantine(spark, sf_dir):
    r = Q["outcome_counts"](spark, sf_dir).first()
    assert r["l1_tn"] + r["l1_fn"] == r["l2_tp"] + r["l2_fp"] + r["l2_tn"] + r["l2_fn"] + r["quarantined"]


def test_split_independent_of_partitioning(spark, sf_dir):
    lf = labelled_flows(spark, sf_dir)
    a = {(r["flow_id"], r["split"]) for r in sp.stratified_split(lf).select("flow_id", "split").collect()}
    b = {(r["flow_id"], r["split"]) for r in
         sp.stratified_split(lf.repartition(3)).select("flow_id", "split").collect()}
    assert a == b


def land_files(spark, sf_dir, n):
    """The test's feeder: ``lineitem`` as ``n`` files in a landing folder."""
    from twotier.session import shared_path
    path = shared_path(spark, "landing")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(n, "l_orderkey", "l_linenumber").write.parquet(path)
    return path


def test_stream_batches_monotone(spark, sf_dir):
    from twotier.session import shared_path
    from twotier.streaming import detection as sd
    out = shared_path(spark, "snaps-batches")
    sd.run_detection(spark, land_files(spark, sf_dir, 4), out, shared_path(spark, "ckpt-batches"))
    snaps = spark.read.parquet(out).selectExpr("batch_id", "layer", "tp + fp + tn + fn as n").collect()
    assert Q["stream_batches"](spark, sf_dir).count() >= 2  # both layers
    for layer in (1, 2):
        ns = [r["n"] for r in sorted((r for r in snaps if r["layer"] == layer), key=lambda r: r["batch_id"])]
        assert ns == sorted(ns) and len(ns) >= 2


def test_probabilities_in_unit_interval(spark, sf_dir):
    r = Q["nb_scores_l1"](spark, sf_dir).agg(F.min("p1"), F.max("p1")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 2 and "mcc" in df.columns


def test_scored_flows_tags_cover_all_branches(spark, sf_dir):
    tags = {r["tag"] for r in scored_flows(spark, sf_dir).select("tag").distinct().collect()}
    assert tags == {"L1_ANOMALY", "L2_ANOMALY", "NOT_ANOMALY2", "QUARANTINE"}


def test_stream_model_swap_epochs_cover_all_rows(spark, sf_dir):
    rows = Q["stream_model_swap"](spark, sf_dir).collect()
    assert {r["epoch"] for r in rows} == {0, 1}
    n = labelled_flows(spark, sf_dir).count()
    assert sum(r["tp"] + r["fp"] + r["tn"] + r["fn"] for r in rows if r["layer"] == 1) == n


def test_retrain_best_publishes_new_version(spark, sf_dir):
    rows = Q["retrain_best"](spark, sf_dir).collect()
    assert {r["layer"] for r in rows} == {1, 2}
    assert all(r["version"] == 1 and "var_smoothing" in r["params"] for r in rows)


def test_rf_trials_one_row_per_trial(spark, sf_dir):
    rows = Q["rf_trials"](spark, sf_dir).collect()
    assert sorted(r["trial_id"] for r in rows) == [0, 1, 2, 3]
    assert all(0.0 <= r["obj_tpr"] <= 1.0 for r in rows)


def test_forest_trials_share_one_copy_of_their_rows(spark, sf_dir, monkeypatch):
    from twotier.operators import tuning as tu
    from twotier.plans import lifecycle
    frame, held = type(spark.range(1)), []
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda df, *level: held.append(df.columns) or persist(df, *level))
    space = {"n_estimators": tu.IntParam(2, 3), "max_depth": tu.IntParam(2, 3)}
    counts, models, _ = lifecycle.fitted_forest_trials(spark, sf_dir, 3, 2, space)
    assert held[1:] == [["features", "label_i"], ["features", "y_l1"]]  # the first is of the preparation
    _, test = lifecycle.split_frames(spark, sf_dir)
    n = test.count()
    assert [sum(r[c] for c in ("tn", "fp", "fn", "tp")) for r in counts.collect()] == [n] * 3 and len(models) == 3


def test_retrained_trials_are_read_back_as_fitted(spark, sf_dir):
    rows = {r["layer"]: r for r in Q["retrain_trials"](spark, sf_dir).collect()}
    assert set(rows) == {1, 2}
    for r in rows.values():
        assert r["tp"] + r["tn"] == r["n_tuned_right"] and r["version"] == 1 and r["seconds"] > 0
        assert 2 * r["n_tuned_right"] > r["tp"] + r["tn"] + r["fp"] + r["fn"]
    assert "max_depth" in rows[1]["params"] and "kernel" in rows[2]["params"]


def test_pca_2d_by_class_covers_rows(spark, sf_dir):
    rows = Q["pca_2d_by_class"](spark, sf_dir).collect()
    assert sum(r["n"] for r in rows) == labelled_flows(spark, sf_dir).count()


def test_stream_snapshot_messages_parse_and_agree(spark, sf_dir):
    from twotier.operators import control as ctl
    from twotier.session import shared_path
    from twotier.streaming import detection as sd
    src = land_files(spark, sf_dir, 2)
    out = shared_path(spark, "snaps-test")
    sd.run_detection(spark, src, out, shared_path(spark, "ckpt-test"))
    msgs = spark.read.parquet(f"{out}_messages")
    last = msgs.agg(F.max("batch_id")).first()[0]
    acc, rej = ctl.parse_snapshot(msgs.where(F.col("batch_id") == last), keep=["epoch"])
    assert rej.count() == 0
    m = acc.first()
    snap = {r["layer"]: r for r in sd.latest_snapshot(spark, out).collect()}
    assert m["metrics_1"]["accuracy"] == snap[1]["accuracy"]
    assert m["metrics_2"]["fscore"] == snap[2]["fscore"]
    ratios = m["classification_metrics"]
    total = sum(ratios[k] for k in ("normal_ratio", "l1_anomaly_ratio", "l2_anomaly_ratio", "quarantined_ratio"))
    assert total == pytest.approx(1.0, abs=1e-5)


def test_nb_cascade_independent_of_partitioning(spark, sf_dir):
    from twotier.plans import learning as L
    (mm1, nb1), (mm2, nb2), test = L.fit_layer_models(spark, sf_dir)
    a = {r["flow_id"]: r["p1"] for r in L.score_layer(test, mm1, nb1, "p1").select("flow_id", "p1").collect()}
    b = {r["flow_id"]: r["p1"] for r in
         L.score_layer(test.repartition(5), mm1, nb1, "p1").select("flow_id", "p1").collect()}
    assert a == b


def test_default_detector_detects(spark, sf_dir):
    """RF layer 1 + landmark SVM layer 2 through the cascade: layer-1 MCC floor."""
    import math

    from twotier.operators import cascade as cas
    from twotier.plans.models import default_detector
    w = cas.outcome_counts_wide(default_detector(spark, sf_dir)).first()
    tp, fp, tn, fn = (w[f"l1_{k}"] for k in ("tp", "fp", "tn", "fn"))
    low = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    assert low and (tp * tn - fp * fn) / low > 0.2 and w["quarantined"] <= tn + fn
