"""Learner queries: Spark ML classifiers (rows-only checks), PCA, model
persistence, the landmark kernel map and the novelty score (the last two
with oracles)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import confusion_aggs, mcc_column, r6, rate_columns
from ..models import kernel as kn
from ..models import prepare as pp
from ..models import trees as tr
from ..models.detector import Detector
from ..models.novelty import fit_novelty
from ..operators import cascade as cas
from ..operators import features as fe
from ..session import held, shared_path
from ..sources import sinks
from ..sources.flows import CATEGORICAL, load_table
from .common import query
from .learning import L1_FEATURES, L2_CLASSES, L2_FEATURES, split_frames
from .nbsql import TEST, TRAIN, minmax_cte, scaled_cols
from .sqlparts import with_base


def _prepared_l1(spark, sf_dir):
    train, test = split_frames(spark, sf_dir)
    mm, enc = pp.fit_prepare(train, L1_FEATURES, CATEGORICAL)
    n_feat = len(L1_FEATURES) + sum(len(s.labels) for s in enc.stages if hasattr(s, "labels"))
    return pp.apply_prepare(train, mm, enc), pp.apply_prepare(test, mm, enc), n_feat


def _evaluate(scored: DataFrame, name: str, y: str = "y_l1", pred: str = "prediction") -> DataFrame:
    conf = scored.select(F.col(y).alias("y"), F.col(pred).cast("int").alias("p")).agg(
        *confusion_aggs("y", "p"))
    return conf.select(F.lit(name).alias("model"), "tn", "fp", "fn", "tp", *rate_columns(),
                       r6(mcc_column()).alias("mcc"))


def _classifier_query(kind: str, params: dict):
    def run(spark, sf_dir):
        """Fit on the layer-1 training rows (prepared features), evaluate on
        the test rows: confusion, rates, MCC."""
        train, test, n_feat = _prepared_l1(spark, sf_dir)
        model = tr.fit_model(train, kind, params, y="y_l1", n_features=n_feat)
        return _evaluate(model.transform(test), kind)
    run.__doc__ = f"CLF ({kind}) on layer 1, rows-only check."
    return run


CLASSIFIERS = {
    "rf_l1": ("rf", {"n_estimators": 50, "max_depth": 12}),             # CLF1
    "gbt_l1": ("gbt", {"learning_rate": 0.1, "max_iter": 20, "max_depth": 5}),  # CLF4 / CLF8
    "dt": ("dt", {"max_depth": 10, "min_samples_split": 4}),            # CLF7
    "mlp": ("mlp", {"hidden": [16], "max_iter": 100}),                   # CLF10
    "logreg": ("logreg", {"max_iter": 100}),                            # CLF13
}
for _k, (_kind, _params) in CLASSIFIERS.items():
    query(_k)(_classifier_query(_kind, _params))


@query("rf_importance")
def rf_importance(spark, sf_dir):
    """FEA8: random-forest importances on the numeric features, descending."""
    train, _ = split_frames(spark, sf_dir)
    mm = fe.fit_minmax(train, L1_FEATURES)
    x = VectorAssembler(inputCols=L1_FEATURES, outputCol="features").transform(mm.apply(train, keep=["y_l1"]))
    model = tr.fit_model(x, "rf", {"n_estimators": 30, "max_depth": 10}, y="y_l1")
    ranked = tr.feature_importance(model, L1_FEATURES)
    return spark.createDataFrame([(i + 1, f, float(v)) for i, (f, v) in enumerate(ranked)],
                                 "rank int, feature string, importance double")


@query("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """MOD1: fit, save to the shared folder, load, and score again; reports
    how many test predictions agree with the in-memory model."""
    train, test, _ = _prepared_l1(spark, sf_dir)
    model = tr.fit_model(train, "rf", {"n_estimators": 10, "max_depth": 8}, y="y_l1")
    path = shared_path(spark, "model-l1")
    tr.save_model(model, path)
    loaded = tr.load_model(path)
    a = model.transform(test).select("flow_id", F.col("prediction").alias("a"))
    b = loaded.transform(test).select("flow_id", F.col("prediction").alias("b"))
    return a.join(b, "flow_id").agg(F.count(F.lit(1)).alias("n"),
                                    F.sum((F.col("a") == F.col("b")).cast("int")).alias("n_equal"))


@query("svm_kernel")
def svm_kernel(spark, sf_dir):
    """CLF2 re-aimed: landmark RBF map + linear SVM + Platt probabilities on
    the layer-2 population; evaluated with the 0.5 cut."""
    train, test = split_frames(spark, sf_dir)
    tr2 = train.where(F.col("attack_class").isin(L2_CLASSES))
    te2 = test.where(F.col("attack_class").isin(L2_CLASSES))
    mm = fe.fit_minmax(tr2, L2_FEATURES)
    inputs = [mm.expr(c) for c in L2_FEATURES]
    model = kn.fit_kernel_svm(tr2, L2_FEATURES, inputs, "y_l2", C=10.0, m=16, gamma=1.0)
    scored = model.transform(te2, inputs, ["flow_id", "y_l2"]).withColumn(
        "prediction", (F.col("p_svm") > 0.5).cast("int"))
    return _evaluate(scored, "svm_kernel", y="y_l2")


def detector_rows(train: DataFrame) -> DataFrame:
    """What the detector's fits read."""
    return train.select("flow_id", "attack_class", "y_any", "y_l1", "y_l2", *CATEGORICAL, *L1_FEATURES)


def fit_detector(rows: DataFrame, **sizes) -> Detector:
    """The detector fitted on ``detector_rows`` that the caller holds, so that several fits share one copy."""
    return Detector.fit(rows, L1_FEATURES, L2_FEATURES, L2_CLASSES, CATEGORICAL, **sizes)


def default_detector(spark, sf_dir, n_estimators: int = 50, max_depth: int = 12, landmarks: int = 32) -> DataFrame:
    """The test rows scored by the default detector and tagged by CAS1: flow_id, labels, l1_pred,
    p2, tag."""
    train, test = split_frames(spark, sf_dir)
    with held(detector_rows(train)) as rows:
        detector = fit_detector(rows, n_estimators=n_estimators, max_depth=max_depth, landmarks=landmarks)
    return cas.cascade_online(detector.score(test), "l1_pred", "p2")


@query("rf_svm_cascade")
def rf_svm_cascade(spark, sf_dir):
    """CAS1 + CAS3 of the default detector (random forest, then landmark RBF SVM, each on its
    layer's PCA features) on the test rows: counts, rates and MCC per layer."""
    scored = default_detector(spark, sf_dir)
    w = cas.outcome_counts_wide(scored)
    per_layer = w.select(F.expr("stack(2, 1, l1_tp, l1_fp, l1_tn, l1_fn, quarantined, total, "
                                "2, l2_tp, l2_fp, l2_tn, l2_fn, quarantined, total) as (layer, tp, fp, tn, fn, quarantined, total)"))
    return per_layer.select("layer", "tp", "fp", "tn", "fn", "quarantined", "total", *rate_columns(), r6(mcc_column()).alias("mcc"))


KF_M = 8
KF_GAMMA = 1.0


def _kernel_sql() -> str:
    lm = (f"lm as (select row_number() over (order by md5('42:' || flow_id)) as j, "
          f"{scaled_cols('mm', L1_FEATURES)} from lf, mm where {TRAIN} "
          f"order by md5('42:' || flow_id) limit {KF_M})")
    lw = "lw as (select " + ", ".join(
        f"max(case when j = {j} then {c} end) as l{j}_{c}" for j in range(1, KF_M + 1) for c in L1_FEATURES) \
        + " from lm)"
    x = f"x as (select flow_id, {scaled_cols('mm', L1_FEATURES)} from lf, mm where {TEST})"
    ks = []
    for j in range(1, KF_M + 1):
        d2 = " + ".join(f"(x.{c} - lw.l{j}_{c}) * (x.{c} - lw.l{j}_{c})" for c in L1_FEATURES)
        ks.append(f"round(exp({-KF_GAMMA!r} * ({d2})), 6) as k{j}")
    extra = minmax_cte("mm", f"(select * from lf where {TRAIN}) t", L1_FEATURES) + ",\n" + ",\n".join([lm, lw, x])
    return with_base(f"select x.flow_id, {', '.join(ks)} from x, lw", extra=extra)


@query("kernel_features", _kernel_sql())
def kernel_features(spark, sf_dir):
    """CLF2 feature map: RBF kernel of every test row against the 8
    smallest-hash training landmarks (bounded literal matrix, no UDF)."""
    train, test = split_frames(spark, sf_dir)
    mm = fe.fit_minmax(train, L1_FEATURES)
    scaled_train = train.select("flow_id", *[mm.expr(c).alias(c) for c in L1_FEATURES])
    L = kn.landmarks(scaled_train, L1_FEATURES, KF_M)
    kmap = kn.LandmarkMap("rbf", L, None, KF_GAMMA)
    cols = kmap.raw_columns([mm.expr(c) for c in L1_FEATURES])
    return test.select("flow_id", *[r6(c).alias(f"k{j + 1}") for j, c in enumerate(cols)])


def _novelty_sql() -> str:
    z = " + ".join(
        f"((tr.{c} - st.m_{c}) / (case when coalesce(st.s_{c}, 0) = 0 then 1e0 else st.s_{c} end)) * "
        f"((tr.{c} - st.m_{c}) / (case when coalesce(st.s_{c}, 0) = 0 then 1e0 else st.s_{c} end))"
        for c in L1_FEATURES)
    extra = ",\n".join([
        minmax_cte("mm", f"(select * from lf where {TRAIN}) t", L1_FEATURES),
        f"tr as (select {scaled_cols('mm', L1_FEATURES)} from lf, mm where {TRAIN} and label = 'normal')",
        "st as (select count(*) as n, " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}"
                                                  for c in L1_FEATURES) + " from tr)",
        f"trs as (select {z} as score from tr, st)",
        "cut as (select score as cut from (select score, row_number() over (order by score) as rn from trs) r "
        "where rn = (select ceil(95e-2 * n) from st))",
        f"te as (select flow_id, {scaled_cols('mm', L1_FEATURES)} from lf, mm where {TEST})",
    ])
    zt = z.replace("tr.", "te.")
    return with_base(f"select te.flow_id, round({zt}, 6) as score, cast({zt} > cut.cut as integer) as novel "
                     f"from te, st, cut", extra=extra)


@query("novelty_score", _novelty_sql())
def novelty_score(spark, sf_dir):
    """CLF12 re-aimed: squared standardized distance from normal training
    traffic, novel above the exact 95th-percentile training score."""
    train, test = split_frames(spark, sf_dir)
    mm = fe.fit_minmax(train, L1_FEATURES)
    normal = train.where(F.col("label") == "normal")
    model = fit_novelty(normal, {c: mm.expr(c) for c in L1_FEATURES}, 0.95)
    out = model.transform(test, {c: mm.expr(c) for c in L1_FEATURES}, ["flow_id"])
    return out.select("flow_id", r6("score").alias("score"), "novel")


# --------------------------------------------------------------------------- PCA on embeddings
def _vectors(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector
    e = load_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("vec"))


@query("pca_95")
def pca_95(spark, sf_dir):
    """FEA4: centred PCA keeping 95 % of the variance, sign-fixed, applied
    to every embedding (rows-only check; orthonormality and minimal k are
    unit-tested)."""
    v = _vectors(spark, sf_dir)
    model = pp.fit_pca(v, "vec", 0.95)
    return model.transform(v, "vec", ["vec_id", "label"])


@query("encoded_roundtrip")
def encoded_roundtrip(spark, sf_dir):
    """SNK1 (``write_encoded``): PCA-encoded embeddings written as PC1..PCk with a header and
    read back; counts and mean of PC1 per label."""
    v = _vectors(spark, sf_dir)
    model = pp.fit_pca(v, "vec", 0.95)
    enc = VectorAssembler(inputCols=[f"PC{j + 1}" for j in range(model.k)], outputCol="pcs").transform(
        model.transform(v, "vec", ["vec_id", "label"]))
    path = shared_path(spark, "encoded")
    sinks.write_encoded(enc, "pcs", model.k, path, keep=["vec_id", "label"], fmt="csv")
    back = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                     r6(F.avg(F.col("PC1").cast("double"))).alias("avg_pc1"))
