"""Learners on larger tables: dealing of held rows, preparation in one aggregate, forest trials, SVM steps, votes."""

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from twotier import session
from twotier.models import kernel as kn
from twotier.models import prepare as pp
from twotier.models import svm_trials as st
from twotier.models import trees as tr
from twotier.plans import lifecycle


def rows_of(df):
    return df.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()


def test_held_rows_keep_all_cores_busy(spark, monkeypatch):
    """420,000 rows in one split were one task in every pass, being fewer than 250,000 for each split."""
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "ROWS_PER_PART", 1000)
    monkeypatch.setattr(session, "ROWS_WORTH_A_TASK", 10)
    one = spark.range(0, cores * 20, 1, 1)
    with session.held(one) as rows:
        sizes = rows_of(rows)
        assert len(sizes) == cores and max(sizes) <= 40 and sum(sizes) == cores * 20
    # a frame whose rows lie in one of its partitions
    uneven = spark.range(0, cores * 200, 1, cores).where(F.col("id") < 200).select("id")
    with session.held(uneven) as rows:
        assert max(rows_of(rows)) < 200
    few = spark.range(0, cores * 10 - 1, 1, 1)
    with session.held(few) as rows:
        assert rows_of(rows) == [cores * 10 - 1]
    more = spark.range(0, 1000 * cores + 1, 1, 1)
    with session.held(more) as rows:
        assert len(rows_of(rows)) == 2 * cores  # whole rounds of tasks


def test_preparation_is_one_aggregate(spark, monkeypatch):
    values = ["b", "a", None, "Z", "é", "￮", "\U0001f600", "a"]
    df = spark.createDataFrame([(float(i), v, "x") for i, v in enumerate(values)], "n double, c string, k string")
    frame, held = type(df), []
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda d, *level: held.append(d.columns) or persist(d, *level))
    mm, enc = pp.fit_prepare(df, ["n"], ["c", "k"])
    assert held == [] and (mm.mins, mm.maxs) == ({"n": 0.0}, {"n": 7.0})
    for stage, c in ((enc.stages[0], "c"), (enc.stages[2], "k")):
        assert stage.labels == StringIndexer(inputCol=c, outputCol="i", handleInvalid="keep", stringOrderType="alphabetAsc").fit(df).labels
    out = [r["features"].toArray().tolist() for r in pp.apply_prepare(df, mm, enc).collect()]
    assert [len(v) for v in out] == [8] * 8 and sum(out[2][1:7]) == 0 and all(sum(v[1:7]) == 1 for i, v in enumerate(out) if i != 2)
    new = spark.createDataFrame([(3.5, "unseen", "y")], df.schema)
    assert pp.apply_prepare(new, mm, enc).first()["features"].toArray().tolist() == [0.5] + [0.0] * 7


def learner_rows(spark, n=600):
    from pyspark.ml.linalg import Vectors
    draw = np.random.default_rng(11)
    x = draw.normal(size=(n, 4))
    return spark.createDataFrame([(Vectors.dense(r), float((r[0] > 0) ^ (r[1] > 0.3))) for r in x], ["features", "label_i"])


def test_forest_with_node_ids_is_the_same_forest(spark, monkeypatch):
    data = learner_rows(spark).coalesce(2).cache()
    params = {"n_estimators": 7, "max_depth": 6}
    assert tr.node_ids_fit(data, "features", 7)
    with_ids = tr.fit_held(data, "rf", params).stages[-1]
    monkeypatch.setattr(tr, "free_memory", lambda spark: 1000)
    assert not tr.node_ids_fit(data, "features", 7)
    without = tr.fit_held(data, "rf", params).stages[-1]
    assert with_ids.getCacheNodeIds() and not without.getCacheNodeIds()
    trees = [[t.toDebugString.split("\n", 1)[1] for t in m.trees] for m in (with_ids, without)]
    assert trees[0] == trees[1] and len(trees[0]) == 7
    assert not tr.node_ids_fit(data.limit(0), "features", 7)
    data.unpersist()


@pytest.mark.parametrize("worth, side", [(10, 1), (10**9, 3)])
def test_forests_that_fill_the_cores_run_one_by_one(spark, sf_dir, monkeypatch, worth, side):
    """Side by side, each trial's bagged rows drove the others' out of memory."""
    from twotier.operators import tuning as tu
    monkeypatch.setattr(session, "ROWS_WORTH_A_TASK", worth)
    pools, pool = [], lifecycle.ThreadPoolExecutor
    monkeypatch.setattr(lifecycle, "ThreadPoolExecutor", lambda max_workers: pools.append(max_workers) or pool(max_workers))
    counts, models, _ = lifecycle.fitted_forest_trials(spark, sf_dir, 2, 3, {"n_estimators": tu.IntParam(2, 3), "max_depth": tu.IntParam(2, 3)})
    assert pools == [side] and len(models) == counts.count() == 2


def test_pca_projection_fixes_signs_as_before(spark):
    """Signs and the cut to k were two more vector functions a row."""
    from pyspark.ml.linalg import Vectors
    draw = np.random.default_rng(4)
    x = draw.normal(size=(60, 4)) * [5.0, 2.0, 1.0, 0.1]
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["i", "v"])
    model = pp.fit_pca(df, "v", k=3)
    out = model.transform(df, "v", ["i"], prefix="P")
    assert out.columns == ["i", "P1", "P2", "P3"]
    got = np.array([r[1:] for r in out.orderBy("i").collect()])
    assert np.allclose(got, (x - model.mean) @ model.components)
    assert len([c for c in out._jdf.queryExecution().optimizedPlan().toString().split("UDF(")]) <= 5


def test_svm_step_sums_and_rows_without_kernel(spark):
    """A far row's rbf kernel is 0 in every value: exponentials were taken of all of them at every step."""
    import pyarrow as pa
    draw = np.random.default_rng(8)
    x = draw.normal(size=(300, 3))
    x[7] = np.nan  # a missing input has no kernel at all
    y = (x[:, 0] > 0).astype(int)
    L = x[:20].copy()
    L[7] = 0.0
    trials = [st.Trial(0, 1.0, "rbf", 1e9), st.Trial(1, 1.0, "rbf", 0.7), st.Trial(2, 1.0, "poly", 0.5, 0.3, 3),
              st.Trial(3, 1.0, "sigmoid", 0.5, -0.2), st.Trial(4, 1.0, "poly", 1e200, 0.0, 4), st.Trial(5, 1.0, "linear", 1.0)]
    model = st.KernelTrials(trials, L)
    weights = {t.trial_id: draw.normal(size=21) for t in trials}
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, c double, y int").repartition(3)
    sums = model.sums(model._rows(df, [F.col(c) for c in "abc"], "y"), trials, weights)
    model.weights = weights
    counts = {r["trial_id"]: tuple(r)[1:] for r in model.counts(df, [F.col(c) for c in "abc"], "y").collect()}
    sign = 2.0 * y - 1.0
    for t in trials:
        with np.errstate(all="ignore"):
            K = np.nan_to_num(kn.kernel_np(t.kind, x, L, t.gamma, t.coef0, t.degree), posinf=0.0, neginf=0.0)
        Z = np.column_stack([K @ model.maps[t.setting], np.ones(300)])
        margin = Z @ weights[t.trial_id]
        slack = np.maximum(1.0 - sign * margin, 0.0)
        loss, gradient, curvature = sums[t.trial_id]
        V = Z[slack > 0]
        assert loss == pytest.approx((slack ** 2).sum(), rel=1e-6)
        assert np.allclose(gradient, -2.0 * (Z.T @ (slack * sign)), rtol=1e-5, atol=1e-5)
        assert np.allclose(curvature, 2.0 * (V.T @ V), rtol=1e-5, atol=1e-5)
        up = margin > 0
        assert counts[t.trial_id] == (int((up & (y == 1)).sum()), int((up & (y == 0)).sum()), int((~up & (y == 0)).sum()), int((~up & (y == 1)).sum()))
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist()), pa.array(y)], names=["x", "y"])
    block, = st.blocks([batch], L, {"rbf"})
    at, K = block.kernel(trials[0].setting)
    assert sorted(at) == [i for i in range(20) if i != 7] and K.shape == (19, 20)  # the landmarks themselves
    at, K = block.kernel(trials[1].setting)
    assert len(at) == 299


def test_both_votes_come_from_one_pass(spark, sf_dir):
    """A union scored every test row twice."""
    from __spark_entry__ import queries
    out = queries()["vote_rf_nb"](spark, sf_dir)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") == 1
    assert {r["model"] for r in out.collect()} == {"rf_nb_soft", "rf_nb_hard"}


def test_both_detectors_are_fitted_on_one_held_copy(spark, sf_dir, monkeypatch):
    """The second forest read, split and shuffled the source again."""
    from __spark_entry__ import queries
    from twotier.models.detector import Detector
    fitted, fit = [], Detector.fit_forest
    monkeypatch.setattr(Detector, "fit_forest", staticmethod(lambda layer, train, *sizes: fitted.append(train.is_cached) or fit(layer, train, *sizes)))
    rows = queries()["stream_detector_swap"](spark, sf_dir).collect()
    assert fitted == [True, True] and all(r["n"] == r["n_batch"] for r in rows)
