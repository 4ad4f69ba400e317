"""Feature-prep and naive-Bayes queries (FEA1 FEA2 FEA5 FEA4-cov AGG13 FEA7
SNK2 CLF3 CLF5 CLF6) and the NB+NB cascade (CAS1 CAS3 AGG6 end to end).

Train = rows with ``md5('42:' || flow_id) >= '4ccc'`` (hash split, a pure
filter), test = the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rates import r6
from ..models.naive_bayes import fit_gaussian_nb, nb_params_frame
from ..operators import cascade as cas
from ..operators import features as fe
from ..operators import metrics as mt
from ..operators import sampling as sp
from ..session import shared_path
from ..sources import sinks
from .common import labelled_flows, query
from .nbsql import TEST, TRAIN, jll_sql, minmax_cte, nb_ctes, proba_sql, scaled_cols
from .sqlparts import outcome_sql, snapshot_sql, with_base

NUM = ["src_bytes", "count", "serror_rate", "rerror_rate", "logged_in", "urgent"]
L1_FEATURES = ["src_bytes", "count", "serror_rate", "rerror_rate", "logged_in"]
L2_FEATURES = ["count", "serror_rate", "rerror_rate", "src_bytes"]
L2_CLASSES = ["normal", "u2r", "r2l"]
CATEGORIES = {"protocol_type": ["A", "N", "R"],
              "service": [f"svc{i}" for i in range(1, 8)],
              "flag": ["F", "O"]}


def split_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = sp.hash_split(labelled_flows(spark, sf_dir))
    return f.where(F.col("split") == "train"), f.where(F.col("split") == "test")


@query("minmax_fit", with_base(
    "select feature, min, max from (" + " union all ".join(
        f"select '{c}' as feature, min({c}) as min, max({c}) as max from lf where {TRAIN}" for c in NUM)
    + ") x"))
def minmax_fit(spark, sf_dir):
    """FEA1 fit on the training rows, one aggregate."""
    train, _ = split_frames(spark, sf_dir)
    return fe.minmax_params(train, NUM)


@query("minmax_apply", with_base(
    f"select flow_id, " + ", ".join(
        f"round(({c} - mn_{c}) / (case when mx_{c} - mn_{c} = 0 then 1e0 else mx_{c} - mn_{c} end), 6) as {c}"
        for c in NUM) + f" from lf, mm where {TEST}",
    extra=minmax_cte("mm", f"(select * from lf where {TRAIN}) t", NUM)))
def minmax_apply(spark, sf_dir):
    """FEA1 apply to the test rows with train constants (no clipping; the
    constant ``urgent`` column stays x - min)."""
    train, test = split_frames(spark, sf_dir)
    mm = fe.fit_minmax(train, NUM)
    return test.select("flow_id", *[r6(mm.expr(c)).alias(c) for c in NUM])


@query("onehot_apply", with_base(
    "select flow_id, " + ", ".join(
        f"cast(coalesce({c} = '{v}', false) as integer) as {c}_{v}"
        for c, vs in CATEGORIES.items() for v in vs) + f" from lf where {TEST}"))
def onehot_apply(spark, sf_dir):
    """FEA2: sorted train categories, one 0/1 column each, unseen -> zeros."""
    train, test = split_frames(spark, sf_dir)
    oh = fe.fit_onehot(train, list(CATEGORIES))
    return oh.apply(test, ["flow_id"])


@query("standardize", with_base(
    "select flow_id, " + ", ".join(
        f"round(({c} - m_{c}) / (case when coalesce(s_{c}, 0) = 0 then 1e0 else s_{c} end), 6) as {c}"
        for c in NUM) + f" from lf, zs where {TEST}",
    extra="zs as (select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in NUM)
    + f" from lf where {TRAIN})"))
def standardize(spark, sf_dir):
    """FEA5: z-score with train mean and population std."""
    train, test = split_frames(spark, sf_dir)
    z = fe.fit_zscore(train, NUM)
    return test.select("flow_id", *[r6(z.expr(c)).alias(c) for c in NUM])


_PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i:]]


@query("covariance_matrix", with_base(
    "select feature_a, feature_b, round(cov, 6) as cov from (" + " union all ".join(
        f"select '{a}' as feature_a, '{b}' as feature_b, covar_pop({a}, {b}) as cov from sx"
        for a, b in _PAIRS) + ") x",
    extra=minmax_cte("mm", f"(select * from lf where {TRAIN}) t", NUM)
    + f",\nsx as (select {scaled_cols('mm', NUM)} from lf, mm where {TRAIN})"))
def covariance_matrix(spark, sf_dir):
    """FEA4 (deterministic part): population covariance of the min-max
    scaled numeric features (the PCA input), all pairs in one aggregate."""
    train, _ = split_frames(spark, sf_dir)
    mm = fe.fit_minmax(train, NUM)
    return fe.covariance_long(mm.apply(train, keep=[]), NUM)


def _corr_sql(f: str, y: str = "y_any") -> str:
    return (f"select '{f}' as feature, round(covar_pop({f}, cast({y} as double)) / "
            f"nullif(stddev_pop({f}) * stddev_pop(cast({y} as double)), 0), 6) as r from lf where {TRAIN}")


@query("feature_corr", with_base(" union all ".join(_corr_sql(f) for f in NUM)))
def feature_corr(spark, sf_dir):
    """AGG13: Pearson r of each numeric feature vs any-attack, one pass;
    the constant column gives NULL."""
    train, _ = split_frames(spark, sf_dir)
    return fe.feature_target_corr(train, NUM, "y_any")


def _icfs_sql() -> str:
    tests = []
    for name, (pop, pos, thr, layer) in fe.ICFS_TESTS.items():
        where = f"{TRAIN}" + (f" and label in ({', '.join(repr(p) for p in pop)})" if pop else "")
        ycol = f"cast(label in ({', '.join(repr(p) for p in pos)}) as double)"
        for f in NUM:
            tests.append(
                f"select {layer} as layer, '{name}' as test, '{f}' as feature, "
                f"covar_pop({f}, {ycol}) / nullif(stddev_pop({f}) * stddev_pop({ycol}), 0) as r, "
                f"{thr!r} as thr from lf where {where}")
    body = " union all ".join(tests)
    return with_base(f"""
select cast(layer as integer) as layer, feature from ({body}) t
where abs(r) > thr group by layer, feature having count(distinct test) = 2""")


@query("icfs_selected", _icfs_sql())
def icfs_selected(spark, sf_dir):
    """FEA7: both layers' correlation tests fused into one aggregate, set
    intersection per layer; the result is persisted (SNK2) and read back."""
    train, _ = split_frames(spark, sf_dir)
    sel = fe.select_features_icfs(train, NUM)
    path = shared_path(spark, "selected-features")
    sinks.write_selected_features(sel.withColumn("run_id", F.lit(0)), path)
    return spark.read.parquet(path).select("layer", "feature")


# --------------------------------------------------------------------------- naive Bayes
def fit_layer_models(spark, sf_dir, var_smoothing: float = 1e-9):
    """Per-layer scaler + NB model from ONE aggregate over the training rows:
    raw moments per (y_l1, y_l2, in-layer-2) group (at most 8 rows), combined
    on the driver into each layer's min-max constants and class statistics."""
    from ..models.naive_bayes import moments_by_group, nb_from_moments
    train, test = split_frames(spark, sf_dir)
    feats = sorted(set(L1_FEATURES) | set(L2_FEATURES))
    groups = moments_by_group(train.withColumn("_l2", F.col("attack_class").isin(L2_CLASSES)),
                              ["y_l1", "y_l2", "_l2"], feats)
    mm1, nb1 = nb_from_moments(groups, "y_l1", L1_FEATURES, var_smoothing)
    mm2, nb2 = nb_from_moments([g for g in groups if g["_l2"]], "y_l2", L2_FEATURES, var_smoothing)
    return (mm1, nb1), (mm2, nb2), test


def score_layer(df: DataFrame, mm: fe.MinMax, nb, prob: str) -> DataFrame:
    """Scaling and the NB likelihood fused into one projection."""
    return df.withColumn(prob, nb.proba(1, {c: mm.expr(c) for c in nb.features}))


def nb_scored(spark, sf_dir) -> DataFrame:
    """Test rows with p1 (layer-1 NB), p2 (layer-2 NB), l1_pred, tag, pred."""
    (mm1, nb1), (mm2, nb2), test = fit_layer_models(spark, sf_dir)
    s = score_layer(score_layer(test, mm1, nb1, "p1"), mm2, nb2, "p2")
    s = s.withColumns({"l1_pred": (F.col("p1") > 0.5).cast("int"),
                       "l2_pred": (F.col("p2") > 0.5).cast("int")})
    return cas.cascade_offline(cas.cascade_online(s, "l1_pred", "p2"))


def _nb_base_extra() -> str:
    l1 = nb_ctes("a", f"(select * from lf where {TRAIN}) t", "y_l1", L1_FEATURES)
    l2 = nb_ctes("b", f"(select * from lf where {TRAIN} and attack_class in ('normal', 'u2r', 'r2l')) t",
                 "y_l2", L2_FEATURES)
    x1 = f"xa as (select flow_id, {scaled_cols('a_mm', L1_FEATURES)} from lf, a_mm where {TEST})"
    # scaled copies under their own names so both layers can be scored on one row
    x2 = (f"xb as (select flow_id, {scaled_cols('b_mm', L2_FEATURES)} from lf, b_mm where {TEST})")
    j = (f"nbj as (select xa.flow_id, {jll_sql('a', 0, L1_FEATURES, 'xa')} as a0, "
         f"{jll_sql('a', 1, L1_FEATURES, 'xa')} as a1, "
         f"{jll_sql('b', 0, L2_FEATURES, 'xb')} as b0, {jll_sql('b', 1, L2_FEATURES, 'xb')} as b1 "
         f"from xa join xb on xa.flow_id = xb.flow_id, a_p, b_p)")
    nb = (f"nb as (select t.*, {proba_sql('a0', 'a1')} as p1, {proba_sql('b0', 'b1')} as p2 "
          f"from nbj join lf t on t.flow_id = nbj.flow_id)")
    sc = ("nbs as (select nb.*, cast(p1 > 5e-1 as integer) as l1_pred, cast(p2 > 5e-1 as integer) as l2_pred, "
          "case when p1 > 5e-1 then 'L1_ANOMALY' when p2 >= 8e-1 then 'L2_ANOMALY' "
          "when 1e0 - p2 >= 6e-1 then 'NOT_ANOMALY2' else 'QUARANTINE' end as tag, "
          "case when p1 > 5e-1 then 1 else cast(p2 > 5e-1 as integer) end as pred from nb)")
    return (l1 + l2)[2:] + ",\n" + ",\n".join([x1, x2, j, nb, sc])


NB_EXTRA = _nb_base_extra()


@query("nb_params", with_base(
    " union all ".join(
        f"select y_l1 as y, count(*) as n, '{c}' as feature, round(avg({c}), 6) as mean, "
        f"round(var_pop({c}), 6) as var from a_tr group by y_l1" for c in L1_FEATURES),
    extra=nb_ctes("a", f"(select * from lf where {TRAIN}) t", "y_l1", L1_FEATURES)[2:]))
def nb_params(spark, sf_dir):
    """CLF3 fit statistics of layer 1: class count, mean, population var."""
    train, _ = split_frames(spark, sf_dir)
    mm1 = fe.fit_minmax(train, L1_FEATURES)
    p = nb_params_frame(mm1.apply(train, keep=["y_l1"]), L1_FEATURES, "y_l1")
    return p.select(F.col("y").cast("int").alias("y"), "n", "feature", r6("mean").alias("mean"),
                    r6("var").alias("var"))


@query("nb_scores_l1", with_base("select flow_id, round(p1, 6) as p1, l1_pred from nbs", extra=NB_EXTRA))
def nb_scores_l1(spark, sf_dir):
    """CLF3 layer-1 probabilities on the test rows."""
    return nb_scored(spark, sf_dir).select("flow_id", r6("p1").alias("p1"), "l1_pred")


@query("nb_scores_l2", with_base("select flow_id, round(p2, 6) as p2, l2_pred from nbs", extra=NB_EXTRA))
def nb_scores_l2(spark, sf_dir):
    """CLF3 layer-2 probabilities on the test rows."""
    return nb_scored(spark, sf_dir).select("flow_id", r6("p2").alias("p2"), "l2_pred")


@query("soft_vote", with_base(
    "select flow_id, round((p1 + s1) / 2e0, 6) as soft, cast((p1 + s1) / 2e0 > 5e-1 as integer) as vote "
    "from nbs", extra=NB_EXTRA))
def soft_vote(spark, sf_dir):
    """CLF5: mean of two models' positive-class probabilities, argmax (a tie
    goes to class 0)."""
    s = nb_scored(spark, sf_dir)
    soft = (F.col("p1") + F.col("s1")) / F.lit(2.0)
    return s.select("flow_id", r6(soft).alias("soft"), (soft > F.lit(0.5)).cast("int").alias("vote"))


@query("hard_vote", with_base(
    "select flow_id, cast(l1_pred + cast(s1 >= 88e-2 as integer) + cast(s2 >= 5e-1 as integer) >= 2 as integer)"
    " as vote from nbs", extra=NB_EXTRA))
def hard_vote(spark, sf_dir):
    """CLF6: majority of three voters (NB layer 1, rule on s1, rule on s2)."""
    s = nb_scored(spark, sf_dir)
    votes = F.col("l1_pred") + (F.col("s1") >= F.lit(0.88)).cast("int") + (F.col("s2") >= F.lit(0.5)).cast("int")
    return s.select("flow_id", (votes >= 2).cast("int").alias("vote"))


@query("nb_cascade", with_base(f"""
select layer, tp, fp, tn, fn, quarantined, total,
  {snapshot_sql()}
from (
  select 1 as layer, l1_tp as tp, l1_fp as fp, l1_tn as tn, l1_fn as fn, quarantined, total from oc
  union all
  select 2, l2_tp, l2_fp, l2_tn, l2_fn, quarantined, total from oc) c""",
                                  extra=NB_EXTRA + f",\noc as (select {outcome_sql()} from nbs)"))
def nb_cascade(spark, sf_dir):
    """Flagship: NB layer 1 + NB layer 2 cascade over every test flow, running
    counts per layer and the snapshot metrics (CAS1 + CAS3 + AGG6)."""
    w = cas.outcome_counts_wide(nb_scored(spark, sf_dir))
    per_layer = w.select(F.expr(
        "stack(2, 1, l1_tp, l1_fp, l1_tn, l1_fn, quarantined, total, "
        "2, l2_tp, l2_fp, l2_tn, l2_fn, quarantined, total) as (layer, tp, fp, tn, fn, quarantined, total)"))
    return mt.snapshot_metrics(per_layer, keep=["layer", "tp", "fp", "tn", "fn", "quarantined", "total"])


@query("nb_tags", with_base("select tag, count(*) as n from nbs group by tag", extra=NB_EXTRA))
def nb_tags(spark, sf_dir):
    """CAS1 tag distribution of the NB+NB cascade."""
    return nb_scored(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- adaptation report
def _segments(s: DataFrame, train_labels: DataFrame, phase: str) -> DataFrame:
    """Per-class and seen/unseen detection of one phase (AGG10 + AGG11)."""
    from ..operators import metrics as mt2
    by_class = mt2.detection_rate_by_class(s).select(F.col("attack_class").alias("segment"),
                                                      "total", "detected", "ratio")
    su = mt2.detection_rate_seen_unseen(s, train_labels).select(F.col("seen").alias("segment"),
                                                                "total", "detected", "ratio")
    return by_class.unionByName(su).withColumn("phase", F.lit(phase))


@query("adaptation_report", with_base("""
select phase, segment, count(*) as total, cast(sum(pred) as bigint) as detected,
       round(cast(sum(pred) as double) / count(*), 6) as ratio
from (
  select 'before' as phase, attack_class as segment, pred from scored where """ + TEST + """ and attack_class <> 'normal'
  union all
  select 'after', attack_class, pred from nbs where attack_class <> 'normal'
  union all
  select 'before', case when label in (select label from tl) then 'seen' else 'unseen' end, pred
  from scored where """ + TEST + """ and label <> 'normal'
  union all
  select 'after', case when label in (select label from tl) then 'seen' else 'unseen' end, pred
  from nbs where label <> 'normal'
) x group by phase, segment""", extra=NB_EXTRA + ",\ntl as (select label from lf where " + TRAIN
                                 + " and attack_class <> 'probe')"))
def adaptation_report(spark, sf_dir):
    """TUN8: detection by class and seen/unseen before (rule cascade) and
    after (NB+NB cascade) adaptation, on the same test rows; probe labels
    are unseen (scenario F1 training labels)."""
    from ..operators import labels as lb2
    from .common import scored_flows
    train, _ = split_frames(spark, sf_dir)
    train_labels = lb2.remove_classes(train, ["probe"]).select("label")
    before = sp.hash_split(scored_flows(spark, sf_dir)).where(F.col("split") == "test")
    after = nb_scored(spark, sf_dir)
    return _segments(before, train_labels, "before").unionByName(_segments(after, train_labels, "after")) \
        .select("phase", "segment", "total", "detected", "ratio")


def _icfs_layer_sql(layer: int) -> str:
    base = _icfs_sql()
    return base.replace("having count(distinct test) = 2",
                        f"having count(distinct test) = 2 and layer = {layer}")


def _icfs_layer(layer: int):
    def run(spark, sf_dir):
        """FEA7 for one layer: features passing both of the layer's tests."""
        train, _ = split_frames(spark, sf_dir)
        sel = fe.select_features_icfs(train, NUM)
        return sel.where(F.col("layer") == layer).select("layer", "feature")
    return run


query("icfs_l1", _icfs_layer_sql(1))(_icfs_layer(1))
query("icfs_l2", _icfs_layer_sql(2))(_icfs_layer(2))


LOW_THRESHOLD = 0.004


@query("icfs_l1_low", _icfs_layer_sql(1).replace("0.1 as thr", f"{LOW_THRESHOLD!r} as thr"))
def icfs_l1_low(spark, sf_dir):
    """FEA7, layer 1, at a threshold that some features pass in both tests."""
    train, _ = split_frames(spark, sf_dir)
    sel = fe.select_features_icfs(train, NUM, thresholds={"dos": LOW_THRESHOLD, "probe": LOW_THRESHOLD})
    return sel.where(F.col("layer") == 1).select("layer", "feature")


def _icfs_corr_sql() -> str:
    tests = []
    for name, (pop, pos, _thr, _layer) in fe.ICFS_TESTS.items():
        where = f"{TRAIN}" + (f" and label in ({', '.join(repr(p) for p in pop)})" if pop else "")
        ycol = f"cast(label in ({', '.join(repr(p) for p in pos)}) as double)"
        for f in NUM:
            tests.append(
                f"select '{name}' as test, '{f}' as feature, "
                f"round(covar_pop({f}, {ycol}) / nullif(stddev_pop({f}) * stddev_pop({ycol}), 0), 6) as r "
                f"from lf where {where}")
    return with_base(" union all ".join(tests))


@query("icfs_correlations", _icfs_corr_sql())
def icfs_correlations(spark, sf_dir):
    """AGG13 inside FEA7: the four one-vs-rest correlation tests for every
    numeric feature, computed in one fused aggregate (NULL for a constant
    feature)."""
    train, _ = split_frames(spark, sf_dir)
    return fe.icfs_correlations(train, NUM).withColumn("r", r6("r"))
