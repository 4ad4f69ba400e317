"""Extra trees, votes, shared SVM trials, detectors in the stream, the stateful gate and the dedup store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from twotier.models import extra_trees as et
from twotier.models.svm_trials import KernelTrials, Trial
from twotier.operators import votes as vt

Q = E.queries()


def toy(spark, n=400, seed=3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0.5)).astype(int)
    rows = [(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "flow_id long, a double, b double, c double, y int")


def test_extra_trees_do_not_depend_on_partitions(spark):
    df = toy(spark)
    one, two = (et.fit_extra_trees(df.repartition(n), ["a", "b", "c"], "y", trees=5, depth=5) for n in (1, 7))
    assert (one.feature == two.feature).all() and np.allclose(one.cut, two.cut) and np.allclose(one.share, two.share)


def test_extra_trees_cuts_stay_in_range_and_learn(spark):
    df = toy(spark)
    model = et.fit_extra_trees(df, ["a", "b", "c"], "y", trees=20, depth=8)
    X = np.array([r[1:4] for r in df.collect()])
    inner = model.feature >= 0
    lo, hi = X.min(axis=0), X.max(axis=0)
    assert ((model.cut[inner] >= lo[model.feature[inner]]) & (model.cut[inner] <= hi[model.feature[inner]])).all()
    assert len(set(model.cut[:, 1].tolist())) > 10  # every tree draws its own cut, from the whole sample
    scored = model.probability(df).select("y", "p_extra").collect()
    assert np.mean([(r["p_extra"] > 0.5) == r["y"] for r in scored]) > 0.9
    # shares of the leaves are the shares of the rows that reach them
    at = model.nodes(0, X)
    y = np.array([r["y"] for r in df.collect()])
    for node in set(at.tolist()):
        assert model.share[0][node] == pytest.approx(y[at == node].mean())


def test_extra_trees_edges(spark):
    none = spark.createDataFrame([], "a double, y int")
    assert et.fit_extra_trees(none, ["a"], "y", trees=2, depth=3).depth == 1
    same = spark.createDataFrame([(1.0, 1), (1.0, 0), (None, 1)], "a double, y int")
    model = et.fit_extra_trees(same, ["a"], "y", trees=2, depth=3)
    assert [r["p_extra"] for r in model.probability(same).collect()] == pytest.approx([2 / 3] * 3)


def test_votes_with_ties_and_abstentions(spark):
    rows = [([0.2, 0.8], [0.8, 0.2], None), ([0.5, 0.5], [0.5, 0.5], [0.5, 0.5]), ([0.1, 0.9], None, [0.6, 0.4]),
            (None, None, None), ([0.0, 1.0], [0.0, 1.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "p_a array<double>, p_b array<double>, p_c array<double>")
    assert [r["vote"] for r in vt.voted(df, ["a", "b", "c"], "soft").collect()] == [0, 0, 1, None, 1]
    assert [r["vote"] for r in vt.voted(df, ["a", "b", "c"], "hard").collect()] == [0, 0, 0, None, 1]
    weighted = vt.soft_vote([F.col("p_a"), F.col("p_b"), F.col("p_c")], 2, [1.0, 1.0, 10.0])
    assert df.select(vt.first_largest(weighted).alias("v")).collect()[4]["v"] == 0


def test_two_voters_do_tie(spark, sf_dir):
    rows = Q["hard_vote_tie"](spark, sf_dir).where("l1_pred != rule_pred")
    assert rows.count() > 0 and rows.where("vote != 0").count() == 0


@pytest.mark.parametrize("name", ["vote_rf_nb", "vote_gbt_nb"])
def test_votes_of_fitted_models(spark, sf_dir, name):
    rows = Q[name](spark, sf_dir).collect()
    assert len(rows) == 2 and all(r["mcc"] > 0.3 for r in rows)


def test_shared_svm_trials_equal_single_fits(spark):
    df = toy(spark)
    inputs = [F.col(c) for c in "abc"]
    L = np.array([r[1:4] for r in df.limit(30).collect()])
    trials = [Trial(0, 1.0, "rbf", 1.0), Trial(1, 1000.0, "rbf", 1.0), Trial(2, 10.0, "poly", 1.0, 0.5, 2), Trial(3, 10.0, "sigmoid", 0.1, 0.0)]
    shared = KernelTrials(trials, L).fit(df.repartition(4), inputs, "y")
    counts = {r["trial_id"]: tuple(r)[1:] for r in shared.counts(df, inputs, "y").collect()}
    for t in trials:
        alone = KernelTrials([t], L).fit(df.repartition(2), inputs, "y")
        assert alone.loss[t.trial_id] == pytest.approx(shared.loss[t.trial_id], rel=1e-4)
        assert np.allclose(alone.weights[t.trial_id], shared.weights[t.trial_id], rtol=1e-3, atol=1e-3)
        assert sum(counts[t.trial_id]) == 400
    assert shared.loss[0] <= 1.0 * 1 + 1e-9  # no worse than the zero weights (C times a mean slack of 1)
    tp, fp, tn, fn = counts[1]
    assert (tp + tn) / 400 > 0.8


def test_svm_trials_lose_no_row(spark, sf_dir):
    rows = Q["svm_trials"](spark, sf_dir).collect()
    assert len(rows) == 40 and len({r["tp"] + r["fp"] + r["tn"] + r["fn"] for r in rows}) == 1
    assert all((r["gamma"] is not None) == (r["kernel"] == "rbf") and (r["degree"] is not None) == (r["kernel"] != "rbf") for r in rows)


def test_streamed_detector_equals_batch_scoring(spark, sf_dir):
    rows = Q["stream_detector_swap"](spark, sf_dir).collect()
    assert {r["epoch"] for r in rows} == {0, 1} and all(r["n"] == r["n_batch"] and r["batch_id"] == r["epoch"] for r in rows)


def test_default_detector_detects(spark, sf_dir):
    rows = {r["layer"]: r for r in Q["rf_svm_cascade"](spark, sf_dir).collect()}
    first, second = rows[1], rows[2]
    assert first["tp"] + first["fp"] + first["tn"] + first["fn"] == first["total"]
    assert first["tn"] + first["fn"] == second["tp"] + second["fp"] + second["tn"] + second["fn"] + second["quarantined"]
    assert first["mcc"] > 0.3


def test_incomplete_detector_is_refused(spark):
    from twotier.models.detector import Detector
    from twotier.session import shared_path
    with pytest.raises(ValueError):
        Detector.load(spark, shared_path(spark, "nothing"))


def test_gate_is_closed_at_first_and_opens_for_good(spark, sf_dir):
    rows = Q["stream_batches"](spark, sf_dir).collect()
    batches = sorted({r["batch_id"] for r in rows})
    assert 0 not in batches and batches == list(range(batches[0], 6)) and len(rows) == 2 * len(batches)


def test_dedup_store_forgets_after_the_horizon(spark):
    from twotier.session import shared_path
    from twotier.streaming import detection as sd
    src, out, store, ckpt = (shared_path(spark, n) for n in ("dd-src", "dd-out", "dd-store", "dd-ckpt"))
    batches = [[(1, "2024-01-01 00:10:00", "a", "x"), (2, "2024-01-01 00:20:00", "a", "x"), (3, "2024-01-01 05:00:00", "b", None)],
               [(4, "2024-01-01 03:00:00", "a", "x"), (5, "2024-01-01 00:30:00", "a", "x"), (6, "2024-01-01 04:10:00", "a", "y")],
               [(7, "2024-01-01 08:00:00", "a", "x"), (8, "2024-01-01 05:30:00", "b", None)]]
    for rows in batches:
        spark.createDataFrame(rows, "event_id long, ts string, event_type string, props string").selectExpr(
            "event_id", "cast(ts as timestamp) ts", "event_type", "props").coalesce(1).write.mode("append").parquet(src)
        sd.dedup_stream(spark, src, out, store, ckpt, 4, glob="*.parquet", files_per_trigger=100)
    # 4 comes within four hours of 1; 7 five hours after 4; 5 and 8 repeat an hour that was stored
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 3, 6, 7]


def test_nearest_neighbours_vote_by_distance_then_order(spark):
    from twotier.models import knn
    draw = np.random.default_rng(5)
    points = [([float(v) for v in draw.integers(0, 3, 2)], int(draw.integers(0, 2))) for _ in range(40)]
    rows = [(float(a), float(b)) for a, b in draw.integers(0, 3, (50, 2))] + [(None, 1.0), (float("nan"), 0.0), (float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    share = knn.vote_share([F.col("a"), F.col("b")], points)
    plan = df.select(share)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan  # 200 points a row in interpreted array functions took 400 microseconds
    for (a, b), got in zip(rows, df.select(share.alias("s")).collect()):
        if a is None or not np.isfinite(a):
            near = range(5)  # no distance: the first points
        else:
            near = sorted(range(40), key=lambda i: ((a - points[i][0][0]) ** 2 + (b - points[i][0][1]) ** 2, i))[:5]
        assert got["s"] == sum(points[i][1] for i in near) / 5
    few = knn.vote_share([F.col("a"), F.col("b")], [([0.0, 0.0], 1), ([1.0, 1.0], 0)])
    assert {r["s"] for r in df.select(few.alias("s")).collect()} == {0.5}


def test_held_rows_are_dealt_by_their_number(spark, monkeypatch):
    from twotier import session
    df = spark.range(0, 1000, 1, 2)
    with session.held(df) as rows:
        assert rows.rdd.getNumPartitions() == 2 and rows.is_cached  # small ones stay as they are
    monkeypatch.setattr(session, "ROWS_PER_PART", 100)
    with session.held(df) as rows:
        sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        assert len(sizes) == 10 and max(sizes) <= 150 and sum(sizes) == 1000
    assert not rows.is_cached


def test_learners_do_not_leave_rows_in_few_tasks(spark, monkeypatch):
    """A table of one split was one task in every pass of every learner."""
    from twotier import session
    from twotier.models import trees
    monkeypatch.setattr(session, "ROWS_PER_PART", 50)
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    x = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(toy(spark).coalesce(1))
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    trees.fit_model(x, "dt", {"max_depth": 3})
    assert seen == [8]


def test_kernel_map_is_one_vector(spark):
    from twotier.models import kernel as kn
    df = toy(spark, 50)
    kmap = kn.fit_landmark_map(df, ["a", "b", "c"], 5, "rbf", 0.5)
    out = kmap.mapped(df, [F.col(c) for c in "abc"], ["flow_id"])
    X = {r["flow_id"]: np.array(r[1:4]) for r in df.collect()}
    for r in out.collect():
        want = kn.kernel_np("rbf", X[r["flow_id"]][None, :], kmap.L, 0.5) @ kmap.W
        assert np.allclose(r["_zf"].toArray(), want[0])
    assert out.columns == ["flow_id", "_zf"]
    holes = df.limit(3).withColumn("a", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="missing input"):
        kmap.mapped(holes, [F.col(c) for c in "abc"], []).collect()


def test_extra_trees_levels_and_nodes_agree(spark):
    model = et.fit_extra_trees(toy(spark), ["a", "b", "c"], "y", trees=4, depth=4)
    X = np.array([r[1:4] for r in toy(spark).collect()])
    for t in range(4):
        at, place = model.nodes(t, X), model.level(t, X.ravel(), np.arange(0, X.size, 3))
        deep = at >= 2 ** model.depth
        assert deep.any() and (at[deep] - 2 ** model.depth == place[deep]).all()


def test_model_swap_takes_a_landing_in_one_batch(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = Q["stream_model_swap"](spark, str(tmp_path)).collect()
    assert {r["batch_id"] for r in rows} == {1}  # a file a batch made nine or more
