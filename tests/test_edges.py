"""Edge inputs: empty frames, constant features, unseen categories, NULL
actuals, unlisted labels, missing JSON keys, ties, perfect rates."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twotier.functions.rates import objective_value
from twotier.operators import cascade as cas
from twotier.operators import control as ctl
from twotier.operators import features as fe
from twotier.operators import labels as lb
from twotier.operators import metrics as mt
from twotier.operators import relational as rel


def test_unlisted_label_is_normal_class_but_attack_target(spark):
    df = spark.createDataFrame([("mystery",), ("normal",), ("smurf",)], "label string")
    out = {r["label"]: r for r in lb.binary_targets(lb.map_class(df)).collect()}
    assert out["mystery"]["attack_class"] == "normal" and out["mystery"]["y_any"] == 1
    assert out["normal"]["y_any"] == 0
    assert out["smurf"]["attack_class"] == "dos" and out["smurf"]["y_l1"] == 1


def test_constant_feature_correlation_is_null(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1), (0.0, 2.0, 0), (0.0, 3.0, 1)], "c double, x double, y int")
    r = {row["feature"]: row["r"] for row in fe.feature_target_corr(df, ["c", "x"], "y").collect()}
    assert r["c"] is None and r["x"] is not None


def test_minmax_constant_column_and_out_of_range(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    mm = fe.fit_minmax(train, ["a", "b"])
    test = spark.createDataFrame([(4.0, 7.0), (0.0, 5.0)], "a double, b double")
    got = sorted(tuple(r) for r in mm.apply(test, keep=[]).collect())
    assert got == [(-0.5, 0.0), (1.5, 2.0)]  # no clipping; constant column -> x - min


def test_unseen_category_encodes_as_zeros(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    oh = fe.fit_onehot(train, ["c"])
    test = spark.createDataFrame([("a",), ("z",)], "c string")
    rows = {tuple(r)[0]: tuple(r)[1:] for r in oh.apply(test.withColumn("k", F.col("c")), ["k"]).collect()}
    assert rows["a"] == (1, 0) and rows["z"] == (0, 0)


def test_null_actual_counted_nowhere(spark):
    df = spark.createDataFrame([("L1_ANOMALY", None), ("L1_ANOMALY", 1), ("QUARANTINE", 0)],
                               "tag string, y_any int")
    r = cas.outcome_counts_wide(df).first()
    assert r["l1_tp"] == 1 and r["l1_fp"] == 0 and r["l1_tn"] == 1
    assert r["l2_tn"] == 0 and r["quarantined"] == 1


def test_empty_frame_confusion_and_rates(spark):
    df = spark.createDataFrame([], "y int, p int")
    r = mt.rates(mt.confusion(df, "y", "p")).first()
    assert r["accuracy"] == 0.0 and r["precision"] == 0.0


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.9, 1)], "s double, y int")
    assert mt.auc(df, "s", "y").first()["auc"] is None


def test_tied_scores_auc_half(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0)], "s double, y int")
    assert mt.auc(df, "s", "y").first()["auc"] == pytest.approx(0.5)


def test_auc_hard_labels_equals_mean_of_tpr_tnr(spark):
    rows = [(1, 1)] * 7 + [(0, 1)] * 3 + [(0, 0)] * 8 + [(1, 0)] * 2
    df = spark.createDataFrame(rows, "p int, y int")
    a = mt.auc(df.withColumn("p", F.col("p").cast("double")), "p", "y").first()["auc"]
    assert a == pytest.approx((7 / 10 + 8 / 10) / 2)


def test_perfect_rate_objective_reference_vs_corrected(spark):
    df = spark.createDataFrame([(5, 0, 5, 0)], "tp long, fp long, tn long, fn long")
    r = df.select(objective_value("fpr").alias("ref"), objective_value("fpr", mode="corrected").alias("cor")).first()
    assert r["ref"] == 0.0 and r["cor"] == 1.0


def test_snapshot_missing_key_rejected(spark):
    good = '{"MSG_TYPE":"msg_type.METRICS_SNAPSHOT_MSG","metrics_1":{"accuracy":1,"precision":1,"tpr":1,' \
           '"fpr":0,"tnr":1,"fnr":0,"fscore":1},"metrics_2":{"accuracy":1,"precision":1,"tpr":1,"fpr":0,' \
           '"tnr":1,"fnr":0,"fscore":1},"classification_metrics":{"normal_ratio":0.5,' \
           '"l1_anomaly_ratio":0.2,"l2_anomaly_ratio":0.1,"quarantined_ratio":0.2}}'
    bad = good.replace('"tpr":1,', "", 1)
    df = spark.createDataFrame([(1, good), (2, bad)], "id int, msg string")
    acc, rej = ctl.parse_snapshot(df, keep=["id"])
    assert [r["id"] for r in acc.collect()] == [1]
    assert [(r["id"], r["missing"]) for r in rej.collect()] == [(2, "metrics_1.tpr")]


def test_objectives_without_lists_are_empty(spark):
    df = spark.createDataFrame([('{"MSG_TYPE":"msg_type.OBJECTIVES_MSG"}',)], "msg string")
    r = ctl.parse_objectives(df).first()
    assert r["objs_layer1"] == [] and r["objs_layer2"] == []


def test_dict_query_error_returns_none(spark):
    t = {"t": spark.createDataFrame([(1,)], "a int")}
    assert rel.perform_query(spark, {"select": "nope", "from": "t"}, t) is None
    assert rel.perform_query(spark, {"select": "a", "from": "missing_table"}, t) is None
    assert rel.perform_query(spark, {"select": "a", "from": "t", "where": "a = 1"}, t).count() == 1


def test_staleness_missing_timestamp_not_stale(spark):
    df = spark.createDataFrame([(None,), ("2024-01-01 00:00:00",)], "ts string") \
        .withColumn("ts", F.to_timestamp("ts"))
    out = [r["stale"] for r in rel.is_stale(df, "ts", "2024-01-01 02:59:59").orderBy("ts").collect()]
    assert out == [False, False]
    out = [r["stale"] for r in rel.is_stale(df, "ts", "2024-01-01 03:00:01").orderBy("ts").collect()]
    assert out == [False, True]


def test_row_index_follows_file_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "v string").coalesce(1)
    rows = rel.with_row_index(df).collect()
    assert [(r["v"], r["row_id"]) for r in rows] == [("a", 0), ("b", 1), ("c", 2)]


def test_check_aligned_raises_on_missing_key(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        rel.check_aligned(a, b, "k")


def test_profile_changed(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    old = mt.dataset_profile(a, "train")
    same = mt.profile_changed(old, mt.dataset_profile(a, "train")).first()["changed"]
    grown = mt.profile_changed(old, mt.dataset_profile(b, "train")).first()["changed"]
    assert same == 0 and grown == 1


def test_onehot_categories_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert fe.fit_onehot(df, ["c"]).categories == {"c": ["a", "b"]}


def test_single_class_naive_bayes_predicts_that_class(spark):
    from twotier.models.naive_bayes import fit_gaussian_nb
    df = spark.createDataFrame([(0.1, 0), (0.3, 0), (0.2, 0)], "x double, y int")
    nb = fit_gaussian_nb(df, ["x"], "y")
    r = df.select(nb.proba(1).alias("p"), (nb.decision() > 0).cast("int").alias("d")).first()
    assert r["p"] == 0.0 and r["d"] == 0


def test_decision_sign_matches_probability(spark):
    from twotier.models.naive_bayes import fit_gaussian_nb
    rows = [(float(i % 7), float(i % 3), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    nb = fit_gaussian_nb(df, ["a", "b"], "y", 1e-3)
    out = df.select((nb.proba(1) > 0.5).alias("p"), (nb.decision() > 0).alias("d")).collect()
    assert all(r["p"] == r["d"] for r in out)


def test_tiny_class_gets_no_validation_rows(spark):
    from twotier.operators import sampling as sp
    rows = [(f"k{i}", "big") for i in range(40)] + [("lonely", "tiny")]
    df = spark.createDataFrame(rows, "flow_id string, attack_class string")
    out = {r["flow_id"]: r["split"] for r in sp.stratified_split(df).collect()}
    assert out["lonely"] == "train"
    assert sum(1 for k, v in out.items() if v == "valid") == 12  # floor(0.3 * 40)


def test_conditional_trial_parameters(spark):
    from twotier.operators import tuning as tu
    space = {
        "kernel": tu.CatParam(("poly", "rbf", "sigmoid")),
        "C": tu.FloatParam(1e-10, 1e10),
        "gamma": tu.When(tu.FloatParam(1e-10, 1e10, log=True), "kernel", ("rbf",)),
        "degree": tu.When(tu.IntParam(2, 5), "kernel", ("poly", "sigmoid")),
    }
    rows = tu.sample_trials(spark, space, 60, seed=7).collect()
    again = tu.sample_trials(spark, space, 60, seed=7).collect()
    assert rows == again  # deterministic draws
    for r in rows:
        assert (r["gamma"] is not None) == (r["kernel"] == "rbf")
        assert (r["degree"] is not None) == (r["kernel"] != "rbf")
        if r["degree"] is not None:
            assert 2 <= r["degree"] <= 5
        if r["gamma"] is not None:
            assert 1e-10 <= r["gamma"] <= 1e10
    assert {r["kernel"] for r in rows} == {"poly", "rbf", "sigmoid"}


def test_set_difference_ignores_multiplicity(spark):
    from twotier.operators import relational as rel
    a = spark.createDataFrame([("x",)] * 5 + [("y",)], "label string")
    b = spark.createDataFrame([("x",)], "label string")
    assert [r["label"] for r in rel.except_lists(a, b).collect()] == ["y"]


def test_check_aligned_raises_on_duplicates(spark):
    from twotier.operators import relational as rel
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(ValueError):
        rel.check_aligned(a, b, "k")
    rel.check_aligned(a, a, "k")


def test_healthy_snapshot_has_empty_lists(spark):
    from twotier.operators import control as ctl
    rows = [(0, layer, m, i, 1.0) for layer in (1, 2) for i, m in enumerate(ctl.METRIC_ORDER)]
    long = spark.createDataFrame(rows, "run_id int, layer int, metric string, ordinal int, value double")
    lists = ctl.objectives(long, ["run_id"]).collect()
    assert {r["layer"]: r["objs"] for r in lists} == {1: [], 2: []}
    msg = ctl.parse_objectives(ctl.objectives_message(ctl.objectives(long, ["run_id"]), ["run_id"])).first()
    assert msg["objs_layer1"] == [] and msg["objs_layer2"] == []


def test_null_and_nan_scores(spark):
    from twotier.operators import cascade as cas
    rows = [(None, 0.9, 1), (0, float("nan"), 1), (0, None, 0), (1, None, 1), (0, 0.9, 1), (0, 0.1, 0)]
    df = cas.cascade_online(spark.createDataFrame(rows, "l1_pred int, p2 double, y_any int"))
    tags = [r["tag"] for r in df.collect()]
    assert tags == [None, "QUARANTINE", "QUARANTINE", "L1_ANOMALY", "L2_ANOMALY", "NOT_ANOMALY2"]
    w = cas.outcome_counts_wide(df).first()
    assert w["total"] == 6 and w["quarantined"] == 2
    assert w["l1_tp"] + w["l1_fp"] + w["l1_tn"] + w["l1_fn"] == 5


def test_class_without_values_of_a_feature(spark):
    from twotier.models.naive_bayes import moments_by_group, nb_from_moments
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 3.0, None), (1, None, 5.0), (1, None, 6.0)], "y int, a double, b double")
    mm, nb = nb_from_moments(moments_by_group(df, ["y"], ["a", "b"]), "y", ["a", "b"])
    assert nb.means[1]["a"] == pytest.approx(0.5) and nb.counts == {0: 2, 1: 2} and nb.means[0]["b"] == pytest.approx(0.0)


def test_snapshots_wait_for_a_ready_layer(spark):
    from twotier.streaming import detection as sd
    rows = [(0, 1, 5, 0, 4, 1), (0, 2, 1, 1, 1, 0), (1, 1, 1, 1, 1, 1), (1, 2, 0, 0, 0, 0)]
    snap = spark.createDataFrame(rows, "epoch int, layer int, tp long, fp long, tn long, fn long")
    assert {r["epoch"] for r in sd.ready(snap).collect()} == {1} and sd.ready(snap).count() == 2


def test_only_local_mode_may_pick_its_own_folder(spark):
    from types import SimpleNamespace
    from twotier import session
    assert session.is_local(spark.sparkContext) and session.is_local(SimpleNamespace(master="local"))
    assert not session.is_local(SimpleNamespace(master="local-cluster[3,2,1024]"))
    assert not session.is_local(SimpleNamespace(master="spark://host:7077")) and not session.is_local(None)


def test_select_items():
    from twotier.operators import relational as rel
    assert rel._select_items("round(a, 2) as r, b, concat(c, ', ') x, d[0]") == [
        "round(a, 2) as r", "b", "concat(c, ', ') x", "d[0]"]


def test_rows_append_in_file_order(spark):
    from twotier.operators import relational as rel
    from twotier.session import shared_path
    a, b = shared_path(spark, "order-a"), shared_path(spark, "order-b")
    spark.range(5000).selectExpr("id as x").repartitionByRange(4, "x").sortWithinPartitions("x").write.parquet(a)
    spark.range(5000).selectExpr("cast(id * 2 as string) as y").repartitionByRange(7, F.expr("cast(y as int)")).sortWithinPartitions(
        F.expr("cast(y as int)")).write.csv(b)
    left, right = spark.read.parquet(a), spark.read.schema("y string").csv(b)
    got = rel.append_by_file_order(left, right)
    assert got.count() == 5000 and got.where("cast(y as int) <> 2 * x").isEmpty()
    assert [r["row_id"] for r in rel.with_file_order(left).orderBy("x").collect()] == list(range(5000))
    short = shared_path(spark, "order-c")
    spark.range(4999).write.parquet(short)
    with pytest.raises(ValueError):
        rel.append_by_file_order(left, spark.read.parquet(short))


def test_profiles_of_earlier_runs(spark):
    from twotier.operators import metrics as mt
    store = mt.ProfileStore(spark)
    a, b = spark.range(3), spark.range(4)
    first = {r["dataset"]: r["changed"] for r in store.changes({"a": a, "b": b}, 0).collect()}
    assert first == {"a": 1, "b": 1}  # all new
    assert {r["dataset"]: r["changed"] for r in store.changes({"a": a, "b": a}, 1).collect()} == {"a": 0, "b": 1}
    assert {r["dataset"]: r["changed"] for r in store.changes({"a": a.withColumn("x", F.lit(1))}, 2).collect()} == {"a": 1, "b": 1}
    assert {r["dataset"]: r["changed"] for r in store.changes({"a": a}, 1).collect()}["a"] == 0  # a replay of run 1


def test_too_many_categories_raise(spark, monkeypatch):
    monkeypatch.setattr(fe, "MAX_CATEGORIES", 5)
    assert len(fe.fit_onehot(spark.range(5).selectExpr("cast(id as string) c"), ["c"]).categories["c"]) == 5
    with pytest.raises(ValueError):
        fe.fit_onehot(spark.range(6).selectExpr("cast(id as string) c"), ["c"])


def test_list_operators_shuffle_distinct_values_only(spark):
    a = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, "x").when(F.col("id") % 3 == 0, "y").alias("label"))
    b = spark.createDataFrame([("x",), ("x",), ("z",), (None,)], "label string")
    assert {r["label"] for r in rel.intersect_lists(a, b, "label").collect()} == {"x", None}
    assert {r["label"] for r in rel.except_lists(a, b).collect()} == {"y", None}  # a null is in no list
    assert {r["label"] for r in rel.except_lists(b, a).collect()} == {"z", None}
    for op in (rel.intersect_lists, rel.except_lists):  # no join: its sides were every row, one task a value
        assert "Join" not in op(a, b, "label")._jdf.queryExecution().optimizedPlan().toString()


def test_raw_records_are_compressed_in_bounded_files(spark, monkeypatch):
    import glob

    from twotier.session import shared_path
    from twotier.sources import sinks
    from twotier.sources.flows import read_flows
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 40)
    path = shared_path(spark, "raw-bounded").removeprefix("file:")
    df = spark.range(100).select(F.lit("tcp").alias("protocol_type"), F.col("id").cast("double").alias("src_bytes"), F.lit("normal").alias("label")).coalesce(1)
    sinks.write_raw_records(df, path)
    assert len(glob.glob(f"{path}/*.snappy")) == 3
    assert sorted(r["src_bytes"] for r in read_flows(spark, path).collect()) == [float(i) for i in range(100)]
