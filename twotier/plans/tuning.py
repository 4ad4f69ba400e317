"""Tuning queries (TUN1-TUN6, JON6): NB trials of both layers evaluated in
ONE job (the fitted statistics do not depend on ``var_smoothing``; every
trial is a column expression over the same scan), objective values, Pareto
front, pick, scenario scores and the best trial per scenario.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tuning as tu
from ..session import cut_lineage
from .common import query
from .learning import L2_CLASSES, NB_EXTRA, fit_layer_models
from .nbsql import jll_sql, proba_sql
from .sqlparts import with_base

N_TRIALS = 20
SPACE = {
    "vs1": tu.FloatParam(1e-10, 1e-1, log=True),
    "vs2": tu.FloatParam(1e-10, 1e-1, log=True),
    "beta": tu.FloatParam(0.0, 1.0),
}
L1_OBJECTIVES = ["tpr", "fpr", "accuracy", "precision", "tnr", "fnr"]
FRONT_OBJECTIVES = ["obj_tpr", "obj_fpr"]


def nb_trial_counts(spark, sf_dir) -> DataFrame:
    """Per trial: both layers' confusion counts on the validation rows.

    One scan of the validation rows: scaled features are projected once, every row carries one
    array with all trials' predictions, and its elements are counted by trial (partial
    aggregation: as many rows as trials leave a task).  The result is checkpointed so that the
    objective / front / scenario steps reuse it.
    """
    trials = sorted(tu.sample_trials(spark, SPACE, N_TRIALS).collect(), key=lambda t: t["trial_id"])  # bounded: N_TRIALS rows
    (mm1, nb1), (mm2, nb2), test = fit_layer_models(spark, sf_dir)
    x = test.select(
        "y_l1", "y_l2", F.col("attack_class").isin(L2_CLASSES).alias("_l2"),
        *[mm1.expr(c).alias(f"_a_{c}") for c in nb1.features],
        *[mm2.expr(c).alias(f"_b_{c}") for c in nb2.features])
    in1 = {c: F.col(f"_a_{c}") for c in nb1.features}
    in2 = {c: F.col(f"_b_{c}") for c in nb2.features}
    both = F.array(*[F.struct((nb1.with_smoothing(t["vs1"]).decision(in1) > F.lit(0.0)).alias("p1"),
                              (nb2.with_smoothing(t["vs2"]).decision(in2) > F.lit(0.0)).alias("p2")) for t in trials])
    each = x.select("y_l1", "y_l2", "_l2", F.posexplode(both).alias("_i", "p"))
    p1, p2, y1, y2, l2 = F.col("p.p1"), F.col("p.p2"), F.col("y_l1") == 1, F.col("y_l2") == 1, F.col("_l2")
    long = each.groupBy("_i").agg(*[F.count_if(cond).alias(name) for name, cond in {
        "l1_tp": y1 & p1, "l1_fp": ~y1 & p1, "l1_tn": ~y1 & ~p1, "l1_fn": y1 & ~p1,
        "l2_tp": l2 & y2 & p2, "l2_fp": l2 & ~y2 & p2, "l2_tn": l2 & ~y2 & ~p2, "l2_fn": l2 & y2 & ~p2}.items()])
    long = long.withColumnRenamed("_i", "trial_id")
    params = spark.createDataFrame([(t["trial_id"], t["vs1"], t["vs2"], t["beta"]) for t in trials],
                                   "trial_id long, vs1 double, vs2 double, beta double")
    return cut_lineage(params.join(F.broadcast(long), "trial_id"))


def _u(name: str) -> str:
    return (f"(cast(('0x' || substr(md5('42:' || '{name}:' || cast(trial_id as varchar)), 1, 8)) as bigint)"
            f" / 4294967296e0)")


def _trials_sql() -> str:
    import math
    lo, hi = math.log(1e-10), math.log(1e-1)
    return (f"trials as (select trial_id, exp({lo!r} + {_u('vs1')} * {hi - lo!r}) as vs1, "
            f"exp({lo!r} + {_u('vs2')} * {hi - lo!r}) as vs2, 0e0 + {_u('beta')} * 1e0 as beta "
            f"from (select range as trial_id from range({N_TRIALS})) r)")


def _trial_counts_sql() -> str:
    from .learning import L1_FEATURES, L2_FEATURES
    ta = ("at_p as (select a_p.* exclude (eps), t.trial_id, t.vs1 * a_p.maxv as eps from a_p, trials t)")
    tb = ("bt_p as (select b_p.* exclude (eps), t.trial_id, t.vs2 * b_p.maxv as eps from b_p, trials t)")
    c1 = (f"c1 as (select at_p.trial_id, lf.y_l1 as y, "
          f"cast({proba_sql(jll_sql('at', 0, L1_FEATURES, 'xa'), jll_sql('at', 1, L1_FEATURES, 'xa'))} > 5e-1 "
          f"as integer) as p from xa join lf on xa.flow_id = lf.flow_id, at_p)")
    c2 = (f"c2 as (select bt_p.trial_id, lf.y_l2 as y, "
          f"cast({proba_sql(jll_sql('bt', 0, L2_FEATURES, 'xb'), jll_sql('bt', 1, L2_FEATURES, 'xb'))} > 5e-1 "
          f"as integer) as p from xb join lf on xb.flow_id = lf.flow_id, bt_p "
          f"where lf.attack_class in ('normal', 'u2r', 'r2l'))")

    def conf(src, pre):
        return (f"select trial_id, "
                f"cast(sum(case when y = 1 and p = 1 then 1 else 0 end) as bigint) as {pre}_tp, "
                f"cast(sum(case when y = 0 and p = 1 then 1 else 0 end) as bigint) as {pre}_fp, "
                f"cast(sum(case when y = 0 and p = 0 then 1 else 0 end) as bigint) as {pre}_tn, "
                f"cast(sum(case when y = 1 and p = 0 then 1 else 0 end) as bigint) as {pre}_fn "
                f"from {src} group by trial_id")
    tc = (f"tc as (select t.trial_id, t.vs1, t.vs2, t.beta, k1.l1_tp, k1.l1_fp, k1.l1_tn, k1.l1_fn, "
          f"k2.l2_tp, k2.l2_fp, k2.l2_tn, k2.l2_fn from trials t "
          f"join ({conf('c1', 'l1')}) k1 on k1.trial_id = t.trial_id "
          f"join ({conf('c2', 'l2')}) k2 on k2.trial_id = t.trial_id)")
    return NB_EXTRA + ",\n" + ",\n".join([_trials_sql(), ta, tb, c1, c2, tc])


TRIALS_EXTRA = _trial_counts_sql()


def _obj_sql(pre: str = "l1", mode: str = "reference") -> str:
    tp, fp, tn, fn = (f"cast({pre}_{c} as double)" for c in ("tp", "fp", "tn", "fn"))

    def rz(n, d):
        return f"coalesce(({n}) / nullif(({d}), 0), 0e0)"
    rates = {"tpr": rz(tp, f"{tp}+{fn}"), "tnr": rz(tn, f"{tn}+{fp}"),
             "accuracy": rz(f"{tp}+{tn}", f"{tp}+{tn}+{fp}+{fn}"), "precision": rz(tp, f"{tp}+{fp}"),
             "fpr": rz(fp, f"{fp}+{tn}"), "fnr": rz(fn, f"{fn}+{tp}")}
    cols = []
    for n in L1_OBJECTIVES:
        v = rates[n]
        if n in ("fpr", "fnr"):
            v = rz("1e0", v) if mode == "reference" else f"(1e0 - {v})"
        cols.append(f"round({v}, 6) as obj_{n}")
    return ", ".join(cols)


OV_EXTRA = TRIALS_EXTRA + f",\nov as (select trial_id, {_obj_sql()} from tc)"


@query("trial_draws", with_base("""
select trial_id, round(ln(vs1), 6) as ln_vs1, round(ln(vs2), 6) as ln_vs2, round(beta, 6) as beta,
       l1_tp + l1_fp + l1_tn + l1_fn as l1_rows, l2_tp + l2_fp + l2_tn + l2_fn as l2_rows
from tc""", extra=TRIALS_EXTRA))
def trial_draws(spark, sf_dir):
    """TUN1: deterministic hash draws (log-uniform smoothing per layer, a
    uniform beta), with the number of validation rows each was scored on."""
    t = nb_trial_counts(spark, sf_dir)
    return t.select("trial_id", F.round(F.log("vs1"), 6).alias("ln_vs1"),
                    F.round(F.log("vs2"), 6).alias("ln_vs2"), F.round("beta", 6).alias("beta"),
                    (F.col("l1_tp") + F.col("l1_fp") + F.col("l1_tn") + F.col("l1_fn")).alias("l1_rows"),
                    (F.col("l2_tp") + F.col("l2_fp") + F.col("l2_tn") + F.col("l2_fn")).alias("l2_rows"))


@query("nb_trials", with_base("""
select trial_id, l1_tp, l1_fp, l1_tn, l1_fn, l2_tp, l2_fp, l2_tn, l2_fn from tc""", extra=TRIALS_EXTRA))
def nb_trials(spark, sf_dir):
    """TUN2 for NB: every trial of both layers in one aggregate."""
    return nb_trial_counts(spark, sf_dir).select(
        "trial_id", "l1_tp", "l1_fp", "l1_tn", "l1_fn", "l2_tp", "l2_fp", "l2_tn", "l2_fn")


def objective_values_frame(spark, sf_dir) -> DataFrame:
    t = nb_trial_counts(spark, sf_dir)
    return t.select("trial_id", *tu.objective_columns(
        L1_OBJECTIVES, "reference", "l1_tp", "l1_fp", "l1_tn", "l1_fn"))


@query("objective_values", with_base("select * from ov", extra=OV_EXTRA))
def objective_values(spark, sf_dir):
    """TUN3 (reference mode): error rates inverted, all maximised."""
    return objective_values_frame(spark, sf_dir)


@query("pareto_front", with_base("""
select a.trial_id, a.obj_tpr, a.obj_fpr from ov a
where not exists (select 1 from ov b where b.obj_tpr >= a.obj_tpr and b.obj_fpr >= a.obj_fpr
                  and (b.obj_tpr > a.obj_tpr or b.obj_fpr > a.obj_fpr))""", extra=OV_EXTRA))
def pareto_front(spark, sf_dir):
    """TUN4 / JON6: non-dominated trials on (tpr, 1/fpr)."""
    ov = objective_values_frame(spark, sf_dir).select("trial_id", *FRONT_OBJECTIVES)
    return tu.pareto_front(ov, FRONT_OBJECTIVES)


@query("picked_trial", with_base("""
select a.trial_id, a.obj_tpr, a.obj_fpr from ov a
where not exists (select 1 from ov b where b.obj_tpr >= a.obj_tpr and b.obj_fpr >= a.obj_fpr
                  and (b.obj_tpr > a.obj_tpr or b.obj_fpr > a.obj_fpr))
order by a.obj_tpr, a.obj_fpr, a.trial_id limit 1""", extra=OV_EXTRA))
def picked_trial(spark, sf_dir):
    """TUN5: first trial of the front sorted ascending by its values."""
    ov = objective_values_frame(spark, sf_dir).select("trial_id", *FRONT_OBJECTIVES)
    return tu.pick_trial(tu.pareto_front(ov, FRONT_OBJECTIVES), FRONT_OBJECTIVES)


_CORRECTED = TRIALS_EXTRA + ",\n" + f"""ov as (select 1 as layer, trial_id, {_obj_sql('l1', 'corrected')} from tc
  union all select 2, trial_id, {_obj_sql('l2', 'corrected')} from tc)"""


def _corrected(spark, sf_dir) -> DataFrame:
    t = nb_trial_counts(spark, sf_dir)
    layers = [t.select(F.lit(n).alias("layer"), "trial_id", *tu.objective_columns(
        L1_OBJECTIVES, "corrected", *[f"l{n}_{c}" for c in ("tp", "fp", "tn", "fn")])) for n in (1, 2)]
    return layers[0].union(layers[1])


@query("objective_values_corrected", with_base("select * from ov", extra=_CORRECTED))
def objective_values_corrected(spark, sf_dir):
    """TUN3 (corrected mode), both layers: error rates as 1 - rate, all maximised."""
    return _corrected(spark, sf_dir)


@query("picked_trial_l2", with_base("""
select a.trial_id, a.obj_tpr, a.obj_fpr from ov a where a.layer = 2
and not exists (select 1 from ov b where b.layer = 2 and b.obj_tpr >= a.obj_tpr and b.obj_fpr >= a.obj_fpr
                and (b.obj_tpr > a.obj_tpr or b.obj_fpr > a.obj_fpr))
order by a.obj_tpr desc, a.obj_fpr desc, a.trial_id limit 1""", extra=_CORRECTED))
def picked_trial_l2(spark, sf_dir):
    """TUN5 (corrected mode), layer 2: the trial of the front with the largest first objective."""
    ov = _corrected(spark, sf_dir).where("layer = 2").select("trial_id", *FRONT_OBJECTIVES)
    return tu.pick_trial(tu.pareto_front(ov, FRONT_OBJECTIVES), FRONT_OBJECTIVES, mode="corrected")


def _scen_sql() -> str:
    def r(pre):
        tp, fp, tn, fn = (f"cast({pre}_{c} as double)" for c in ("tp", "fp", "tn", "fn"))

        def rz(n, d):
            return f"coalesce(({n}) / nullif(({d}), 0), 0e0)"
        return {"rec": rz(tp, f"{tp}+{fn}"), "prec": rz(tp, f"{tp}+{fp}"), "fpr": rz(fp, f"{fp}+{tn}"),
                "tnr": rz(tn, f"{tn}+{fp}"), "fnr": rz(fn, f"{fn}+{tp}")}
    a, b = r("l1"), r("l2")
    avg = {k: f"(({a[k]}) + ({b[k]})) / 2e0" for k in a}
    return (f"sc as (select trial_id, "
            f"round(5e-1 * (({a['rec']}) + ({b['rec']})) + 5e-1 * (({a['prec']}) + ({b['prec']})), 6) as s1, "
            f"round((({a['fpr']}) + ({b['fpr']})) / 2e0, 6) as s2, "
            f"round({avg['fpr']} + (1e0 - {avg['tnr']}), 6) as s3, "
            f"round(1e0 - ({avg['prec']} + {avg['fnr']}), 6) as s4, "
            f"round(5e-1 * {avg['rec']} - beta * {avg['fnr']} - greatest(0e0, {avg['rec']} - 8e-1), 6) as adaptive "
            f"from tc)")


SC_EXTRA = TRIALS_EXTRA + ",\n" + _scen_sql()


def scenario_frame(spark, sf_dir) -> DataFrame:
    return tu.scenario_scores(nb_trial_counts(spark, sf_dir)).select(
        "trial_id", "s1", "s2", "s3", "s4", "adaptive")


@query("scenario_scores", with_base("select * from sc", extra=SC_EXTRA))
def scenario_scores(spark, sf_dir):
    """TUN6: S1..S4 and the adaptive score per trial over both layers."""
    return scenario_frame(spark, sf_dir)


@query("scenario_best", with_base(" union all ".join(
    f"select * from (select '{s}' as scenario, trial_id, {s} as score from sc "
    f"order by {s} {'desc' if d == 'max' else 'asc'}, trial_id limit 1)"
    for s, d in tu.SCENARIO_DIRECTION.items()), extra=SC_EXTRA))
def scenario_best(spark, sf_dir):
    """TUN6: the best trial under each scenario's direction."""
    return tu.best_per_scenario(scenario_frame(spark, sf_dir))


@query("scenario_scores_special", with_base("""
select trial_id, s1, s2, s3, s4, round((coalesce(cast(l1_fn as double) / nullif(cast(l1_fn + l1_tp as double), 0), 0e0)
  + coalesce(cast(l2_fn as double) / nullif(cast(l2_fn + l2_tp as double), 0), 0e0)) / 2e0, 6) as adaptive
from sc join tc using (trial_id)""", extra=SC_EXTRA))
def scenario_scores_special(spark, sf_dir):
    """TUN6, the branch in which the adaptive score is the mean miss rate of both layers."""
    return tu.scenario_scores(nb_trial_counts(spark, sf_dir), special=True).select("trial_id", "s1", "s2", "s3", "s4", "adaptive")
