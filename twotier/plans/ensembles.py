"""Queries of extra trees (CLF9), votes over fitted models (CLF5, CLF6) and the layer-2
kernel SVM trials (TUN2)."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import confusion_aggs, mcc_column, r6, rate_columns
from ..models import extra_trees as et
from ..models import knn
from ..models import trees as tr
from ..models.kernel import landmarks
from ..models.svm_trials import KernelTrials, Trial
from ..operators import features as fe
from ..operators import tuning as tu
from ..operators import votes as vt
from .common import query
from .learning import L1_FEATURES, L2_CLASSES, L2_FEATURES, NB_EXTRA, fit_layer_models, nb_scored, split_frames
from .models import _evaluate, _prepared_l1
from .nbsql import TEST, TRAIN, minmax_cte, scaled_cols
from .sqlparts import with_base

# --------------------------------------------------------------------------- extra trees
LEVEL_TREES = 5
PER_NODE = 2


def _level_sql() -> str:
    ranges = " union all ".join(f"select '{c}' as feature, min({c}) as lo, max({c}) as hi from lf where {TRAIN}" for c in L1_FEATURES)
    values = " union all ".join(f"select '{c}' as feature, cast({c} as double) as v, y_l1 as y from lf where {TRAIN}" for c in L1_FEATURES)
    return with_base("""
select tree, c.feature, round(cut, 6) as cut, count(*) as n, cast(sum(y) as bigint) as pos,
       count(*) filter (where v <= cut) as left_n, cast(coalesce(sum(y) filter (where v <= cut), 0) as bigint) as left_pos
from cuts c join v on v.feature = c.feature group by tree, c.feature, cut""", extra=f"""
rg as ({ranges}),
hs as (select range as tree, feature, lo, hi, md5('42:' || range || ':1:' || feature) as h from rg, range({LEVEL_TREES}) where lo < hi),
cuts as (select tree, feature, lo + (cast('0x' || substr(h, 9, 8) as bigint) / 4294967296e0) * (hi - lo) as cut
         from hs qualify row_number() over (partition by tree order by h) <= {PER_NODE}),
v as ({values})""")


@query("extra_trees_level", _level_sql())
def extra_trees_level(spark, sf_dir):
    """CLF9, one level: the random cuts of every tree's root and the class counts on their sides."""
    train, _ = split_frames(spark, sf_dir)
    rows = et.training_rows(train, L1_FEATURES, "y_l1")
    model = et.ExtraTrees.roots(L1_FEATURES, LEVEL_TREES, 0, 0.0, 42)
    cuts = et.candidates(et.node_ranges(rows, model), L1_FEATURES, PER_NODE, 42)
    names = F.array(*[F.lit(c) for c in L1_FEATURES])
    return et.cut_counts(rows, model, cuts, PER_NODE).select("tree", names[F.col("feature")].alias("feature"), r6("cut").alias("cut"),
                                               "n", "pos", "left_n", "left_pos")


@query("extra_trees")
def extra_trees(spark, sf_dir, trees: int = 100, depth: int = 8):
    """CLF9 on layer 1: confusion, rates and MCC on the test rows."""
    train, test = split_frames(spark, sf_dir)
    model = et.fit_extra_trees(train, L1_FEATURES, "y_l1", trees, depth)
    scored = model.probability(test.select("flow_id", "y_l1", *L1_FEATURES))
    return _evaluate(scored.withColumn("prediction", (F.col("p_extra") > 0.5).cast("int")), "extra_trees")


# --------------------------------------------------------------------------- votes
def voters(spark, sf_dir, kinds: dict[str, tuple[str, dict]]) -> DataFrame:
    """The test rows with the class probabilities of a learner of each kind and of naive
    Bayes, all fitted on layer 1."""
    train, test, n = _prepared_l1(spark, sf_dir)
    (mm, nb), _, _ = fit_layer_models(spark, sf_dir)
    models = {name: tr.fit_model(train, kind, params, y="y_l1", n_features=n) for name, (kind, params) in kinds.items()}
    models["nb"] = nb.proba(1, {c: mm.expr(c) for c in nb.features})
    return vt.with_probabilities(test.select("flow_id", "y_l1", "features", *L1_FEATURES), models)


def _vote_query(kinds: dict[str, tuple[str, dict]]):
    def run(spark, sf_dir):
        """Soft and hard votes on the test rows: confusion, rates, MCC of each."""
        scored, names = voters(spark, sf_dir, kinds), [*kinds, "nb"]
        for kind in ("soft", "hard"):
            scored = vt.voted(scored, names, kind, out=f"_{kind}")
        # both votes from one pass: a union would score every row twice
        each = scored.select("y_l1", F.explode(F.array(*[F.struct(
            F.lit(f"{'_'.join(names)}_{kind}").alias("model"), F.col(f"_{kind}").alias("vote")) for kind in ("soft", "hard")])).alias("_v"))
        conf = each.groupBy(F.col("_v.model").alias("model")).agg(*confusion_aggs("y_l1", "_v.vote"))
        return conf.select("model", "tn", "fp", "fn", "tp", *rate_columns(), r6(mcc_column()).alias("mcc"))
    return run


query("vote_rf_nb")(_vote_query({"rf": ("rf", {"n_estimators": 20, "max_depth": 10})}))
query("vote_gbt_nb")(_vote_query({"gbt": ("gbt", {"learning_rate": 0.1, "max_iter": 10, "max_depth": 5})}))


@query("hard_vote_tie", with_base(
    "select flow_id, l1_pred, cast(s1 >= 88e-2 as integer) as rule_pred, "
    "cast(l1_pred = 1 and s1 >= 88e-2 as integer) as vote from nbs", extra=NB_EXTRA))
def hard_vote_tie(spark, sf_dir):
    """CLF6 with two voters (naive Bayes and the score rule): where they differ, the lower class wins."""
    s = nb_scored(spark, sf_dir).withColumn("rule_pred", (F.col("s1") >= F.lit(0.88)).cast("int"))
    votes = vt.hard_vote([F.col("l1_pred"), F.col("rule_pred")], 2)
    return s.select("flow_id", "l1_pred", "rule_pred", vt.first_largest(votes).alias("vote"))


@query("soft_vote_weighted", with_base(
    "select flow_id, round((2e0 * p1 + s1 + s2) / 4e0, 6) as soft, "
    "cast((2e0 * p1 + s1 + s2) / 4e0 > (2e0 * (1e0 - p1) + (1e0 - s1) + (1e0 - s2)) / 4e0 as integer) as vote from nbs", extra=NB_EXTRA))
def soft_vote_weighted(spark, sf_dir):
    """CLF5 with three voters of weights 2, 1 and 1."""
    s = vt.with_probabilities(nb_scored(spark, sf_dir), {"nb": F.col("p1"), "a": F.col("s1"), "b": F.col("s2")})
    mean = vt.soft_vote([F.col("p_nb"), F.col("p_a"), F.col("p_b")], 2, [2.0, 1.0, 1.0])
    return s.select("flow_id", r6(mean[1]).alias("soft"), vt.first_largest(mean).alias("vote"))


# --------------------------------------------------------------------------- layer-2 SVM trials
# The search space of the layer-2 classifier.
SVM_SPACE = {
    "c": tu.FloatParam(1e-10, 1e10),
    "kernel": tu.CatParam(("poly", "rbf", "sigmoid")),
    "gamma": tu.When(tu.FloatParam(1e-10, 1e10), "kernel", ("rbf",)),
    "degree": tu.When(tu.IntParam(2, 5), "kernel", ("poly", "sigmoid")),
    "coef0": tu.When(tu.FloatParam(-1.0, 1.0), "kernel", ("poly", "sigmoid")),
}
N_SVM_TRIALS = 40
SVM_LANDMARKS = 32


def fitted_svm_trials(spark, sf_dir, n_trials: int = N_SVM_TRIALS, m: int = SVM_LANDMARKS):
    """The drawn trials, fitted together on the layer-2 training rows, and the test rows."""
    train, test = split_frames(spark, sf_dir)
    train, test = (f.where(F.col("attack_class").isin(L2_CLASSES)) for f in (train, test))
    mm = fe.fit_minmax(train, L2_FEATURES)
    inputs = [mm.expr(c) for c in L2_FEATURES]
    L = landmarks(train.select("flow_id", *[x.alias(c) for x, c in zip(inputs, L2_FEATURES)]), L2_FEATURES, m)
    drawn = tu.sample_trials(spark, SVM_SPACE, n_trials)
    # a kernel without a drawn gamma takes 1 / (features x variance), the usual scale
    scale = 1.0 / (len(L2_FEATURES) * max(float(L.var()), 1e-12))
    trials = [Trial(t["trial_id"], t["c"], t["kernel"], scale if t["gamma"] is None else t["gamma"],
                    t["coef0"] or 0.0, t["degree"] or 3) for t in drawn.collect()]  # n_trials rows
    return KernelTrials(trials, L).fit(train, inputs, "y_l2"), drawn, test, inputs


@query("svm_trials")
def svm_trials(spark, sf_dir):
    """TUN2, layer 2: all trials of the kernel SVM in shared passes; counts, losses and objectives."""
    fitted, drawn, test, inputs = fitted_svm_trials(spark, sf_dir)
    losses = spark.createDataFrame(list(fitted.loss.items()), "trial_id long, objective double")
    counts = fitted.counts(test, inputs, "y_l2")
    return counts.join(drawn, "trial_id").join(losses, "trial_id").select(
        "trial_id", "kernel", "c", "gamma", "degree", "coef0", "objective", "tp", "fp", "tn", "fn",
        *tu.objective_columns(["tpr", "fpr", "accuracy", "precision"], "corrected"))


def _u(name: str) -> str:
    return f"(cast(('0x' || substr(md5('42:' || '{name}:' || cast(trial_id as varchar)), 1, 8)) as bigint) / 4294967296e0)"


@query("svm_trial_draws", with_base(f"""
select trial_id, kernel, round(c / 1e10, 6) as c, case when kernel = 'rbf' then round(gamma / 1e10, 6) end as gamma,
       case when kernel <> 'rbf' then degree end as degree, case when kernel <> 'rbf' then round(coef0, 6) end as coef0,
       (select count(*) from lf where {TEST} and attack_class in ('normal', 'u2r', 'r2l')) as n,
       (select count(*) from lf where {TEST} and y_l2 = 1 and attack_class in ('normal', 'u2r', 'r2l')) as pos
from (select trial_id, 1e-10 + {_u('c')} * (1e10 - 1e-10) as c,
        ['poly', 'rbf', 'sigmoid'][cast(floor({_u('kernel')} * 3) as int) + 1] as kernel,
        1e-10 + {_u('gamma')} * (1e10 - 1e-10) as gamma, cast(2 + floor({_u('degree')} * 4) as bigint) as degree,
        -1e0 + {_u('coef0')} * 2e0 as coef0 from (select range as trial_id from range({N_SVM_TRIALS})) r) d"""))
def svm_trial_draws(spark, sf_dir):
    """TUN1 + TUN2, layer 2: conditional draws, and the rows and positives that each trial's counts add up to
    (linear kernels of tiny weights are enough for that: no row is lost in the shared passes)."""
    _, test = split_frames(spark, sf_dir)
    test = test.where(F.col("attack_class").isin(L2_CLASSES))
    mm = fe.fit_minmax(test, L2_FEATURES)
    inputs = [mm.expr(c) for c in L2_FEATURES]
    L = landmarks(test.select("flow_id", *[x.alias(c) for x, c in zip(inputs, L2_FEATURES)]), L2_FEATURES, 4)
    drawn = tu.sample_trials(spark, SVM_SPACE, N_SVM_TRIALS)
    unfitted = KernelTrials([Trial(t["trial_id"], 1.0, "linear", 1.0) for t in drawn.collect()], L)
    counts = unfitted.counts(test, inputs, "y_l2")
    return drawn.join(counts, "trial_id").select(
        "trial_id", "kernel", F.round(F.col("c") / 1e10, 6).alias("c"), F.round(F.col("gamma") / 1e10, 6).alias("gamma"),
        "degree", F.round("coef0", 6).alias("coef0"), (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"),
        (F.col("tp") + F.col("fn")).alias("pos"))




# --------------------------------------------------------------------------- nearest neighbours
KNN_SAMPLE = 200


def _knn_sql() -> str:
    distance = " + ".join(["0e0", *[f"(t.{c} - s.{c}) * (t.{c} - s.{c})" for c in L1_FEATURES]])
    return with_base("""
select flow_id, round(sum(y) / 5e0, 6) as share, cast(sum(y) / 5e0 > 5e-1 as integer) as vote
from near where r <= 5 group by flow_id""", extra=minmax_cte("mm", f"(select * from lf where {TRAIN}) t", L1_FEATURES) + f""",
s as (select row_number() over (order by md5('42:' || flow_id)) as i, y_l1 as y, {scaled_cols('mm', L1_FEATURES)} from lf, mm where {TRAIN}
      order by md5('42:' || flow_id) limit {KNN_SAMPLE}),
t as (select flow_id, {scaled_cols('mm', L1_FEATURES)} from lf, mm where {TEST}),
near as (select t.flow_id, s.y, row_number() over (partition by t.flow_id order by {distance}, s.i) as r from t, s)""")


@query("knn_vote", _knn_sql())
def knn_vote(spark, sf_dir):
    """CLF11: the five nearest of a sample of 200 labelled rows vote on every test row."""
    train, test = split_frames(spark, sf_dir)
    mm = fe.fit_minmax(train, L1_FEATURES)
    points = knn.sample(train, {c: mm.expr(c) for c in L1_FEATURES}, "y_l1", KNN_SAMPLE)
    scaled = test.select("flow_id", *[mm.expr(c).alias(c) for c in L1_FEATURES])
    share = knn.vote_share([F.col(c) for c in L1_FEATURES], points)
    return scaled.select("flow_id", share.alias("s")).select("flow_id", r6("s").alias("share"), (F.col("s") > 0.5).cast("int").alias("vote"))
