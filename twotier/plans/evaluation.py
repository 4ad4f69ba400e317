"""Evaluation queries: taxonomy counts, cascade, confusion, rates, ROC/AUC,
per-class and seen/unseen detection (PRJ6 AGG1-AGG12 CAS1-CAS3 STR6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade as cas
from ..operators import labels as lb
from ..operators import metrics as mt
from ..operators import sampling as sp
from ..sources import taxonomy as tx
from ..sources.flows import flows, load_table
from .common import labelled_flows, query, scored_flows
from .sqlparts import (class_case, confusion_sql, mcc_sql, outcome_sql, rates_sql,
                       snapshot_sql, with_base)


@query("flows_by_class", with_base("""
select c.attack_class, cast(coalesce(n, 0) as bigint) as n
from (values ('dos'), ('probe'), ('r2l'), ('u2r'), ('normal')) as c(attack_class)
left join (select attack_class, count(*) as n from lf group by attack_class) g
  on c.attack_class = g.attack_class"""))
def flows_by_class(spark, sf_dir):
    """PRJ6 (broadcast taxonomy join) + AGG2 (zero bars kept)."""
    return mt.class_histogram(lb.map_class(flows(spark, sf_dir)))


@query("fine_label_histogram", with_base(
    "select label, count(*) as n from flows group by label order by n desc, label"))
def fine_label_histogram(spark, sf_dir):
    """AGG1."""
    return mt.value_counts(flows(spark, sf_dir), "label")


@query("binary_targets", with_base(
    "select flow_id, attack_class, y_l1, y_l2, y_any, y_dos, y_probe, y_r2l, y_u2r from lf"))
def binary_targets(spark, sf_dir):
    """PRJ7."""
    return labelled_flows(spark, sf_dir).select(
        "flow_id", "attack_class", "y_l1", "y_l2", "y_any", "y_dos", "y_probe", "y_r2l", "y_u2r")


@query("mask_l1_classes", with_base(f"""
select flow_id, case when label in ({tx.sql_list(tx.L1_LABELS)}) then 'normal' else label end as label,
       {class_case("case when label in (" + tx.sql_list(tx.L1_LABELS) + ") then 'normal' else label end")}
       as attack_class
from flows"""))
def mask_l1_classes(spark, sf_dir):
    """PRJ8: dos and probe relabelled as normal (layer-2 view of the data)."""
    m = lb.mask_classes(flows(spark, sf_dir), ["dos", "probe"])
    return m.select("flow_id", "label", lb.class_expr().alias("attack_class"))


@query("layer2_population", with_base(f"""
select flow_id, label, attack_class from lf
where label in ('normal', {tx.sql_list(tx.U2R + tx.R2L)})"""))
def layer2_population(spark, sf_dir):
    """FLT1 / JON4."""
    return lb.layer2_population(labelled_flows(spark, sf_dir)).select("flow_id", "label", "attack_class")


def _scenario_sql(classes: list[str]) -> str:
    removed = [l for c in classes for l in tx.FULL[c]]
    return with_base(f"""
select flow_id, attack_class, case when rn <= floor(3e-1 * n) then 'valid' else 'train' end as split
from (select flow_id, attack_class,
             row_number() over (partition by attack_class order by md5('42:' || flow_id)) as rn,
             count(*) over (partition by attack_class) as n
      from lf where label not in ({tx.sql_list(removed)})) s""")


def _scenario(name):
    def run(spark, sf_dir):
        """FLT2 + SPL4: remove classes, then stratified split."""
        return sp.failure_scenario(labelled_flows(spark, sf_dir), name).select(
            "flow_id", "attack_class", "split")
    return run


for _name in ("f1", "f2", "f3", "f23"):
    query(f"scenario_{_name}", _scenario_sql(lb.FAILURE_SCENARIOS[_name]))(_scenario(_name))


@query("cascade_tags", with_base(
    "select tag, count(*) as n from scored group by tag"))
def cascade_tags(spark, sf_dir):
    """CAS1 tag distribution."""
    return scored_flows(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("cascade_offline", with_base(
    "select flow_id, l1_pred, l2_pred, pred, y_any from scored"))
def cascade_offline(spark, sf_dir):
    """CAS2 per row."""
    return scored_flows(spark, sf_dir).select("flow_id", "l1_pred", "l2_pred", "pred", "y_any")


@query("outcome_counts", with_base(f"select\n  {outcome_sql()}\nfrom scored"))
def outcome_counts(spark, sf_dir):
    """CAS3: layer-1 over all rows, layer-2 over non-quarantined L1 negatives."""
    return cas.outcome_counts_wide(scored_flows(spark, sf_dir))


@query("outcome_counts_long", with_base(f"""
select layer, outcome, cast(sum(n) as bigint) as n from (
  select 1 as layer, case when tag = 'L1_ANOMALY' then (case when y_any = 1 then 'tp' else 'fp' end)
                          else (case when y_any = 1 then 'fn' else 'tn' end) end as outcome, 1 as n
  from scored where y_any is not null
  union all
  select 2, case when tag = 'L2_ANOMALY' then (case when y_any = 1 then 'tp' else 'fp' end)
                 else (case when y_any = 1 then 'fn' else 'tn' end) end, 1
  from scored where y_any is not null and tag in ('L2_ANOMALY', 'NOT_ANOMALY2')
) t group by layer, outcome"""))
def outcome_counts_long(spark, sf_dir):
    """CAS3 long form (layer, outcome, n); zero outcomes dropped."""
    long = cas.outcome_counts_long(scored_flows(spark, sf_dir))
    return long.where(F.col("n") > 0)


@query("counts_all_layers", with_base("""
select outcome, cast(sum(n) as bigint) as n from (
  select case when tag = 'L1_ANOMALY' then (case when y_any = 1 then 'tp' else 'fp' end)
              else (case when y_any = 1 then 'fn' else 'tn' end) end as outcome, 1 as n from scored
  union all
  select case when tag = 'L2_ANOMALY' then (case when y_any = 1 then 'tp' else 'fp' end)
              else (case when y_any = 1 then 'fn' else 'tn' end) end, 1
  from scored where tag in ('L2_ANOMALY', 'NOT_ANOMALY2')
) t group by outcome"""))
def counts_all_layers(spark, sf_dir):
    """AGG17."""
    return mt.counts_all_layers(cas.outcome_counts_long(scored_flows(spark, sf_dir)))


@query("destination_ratios", with_base("""
select count(*) as total,
  round(sum(case when tag = 'NOT_ANOMALY2' then 1 else 0 end) / count(*), 6) as normal_ratio,
  round(sum(case when tag = 'QUARANTINE' then 1 else 0 end) / count(*), 6) as quarantined_ratio,
  round(sum(case when tag = 'L1_ANOMALY' then 1 else 0 end) / count(*), 6) as l1_anomaly_ratio,
  round(sum(case when tag = 'L2_ANOMALY' then 1 else 0 end) / count(*), 6) as l2_anomaly_ratio
from scored"""))
def destination_ratios(spark, sf_dir):
    """AGG7."""
    return cas.destination_ratios(scored_flows(spark, sf_dir))


@query("confusion", with_base(f"select\n  {confusion_sql('y_any', 'pred')}\nfrom scored"))
def confusion(spark, sf_dir):
    """AGG3 of the offline cascade against any-attack truth."""
    return mt.confusion(scored_flows(spark, sf_dir), "y_any", "pred")


@query("rates", with_base(f"""
select tn, fp, fn, tp,
  {rates_sql()}
from (select {confusion_sql('y_any', 'pred')} from scored) c"""))
def rates(spark, sf_dir):
    """AGG4."""
    return mt.rates(mt.confusion(scored_flows(spark, sf_dir), "y_any", "pred"))


@query("rates_by_layer", with_base(f"""
select layer, tn, fp, fn, tp,
  {rates_sql()},
  {mcc_sql()} as mcc
from (
  select 1 as layer, {confusion_sql('y_l1', 'l1_pred')} from scored
  union all
  select 2 as layer, {confusion_sql('y_l2', 'l2_pred')} from scored where attack_class in ('normal', 'u2r', 'r2l')
) c"""))
def rates_by_layer(spark, sf_dir):
    """AGG3-AGG5 per layer on its own population (layer 2 = normal+u2r+r2l)."""
    s = scored_flows(spark, sf_dir)
    l1 = s.select(F.lit(1).alias("layer"), F.col("y_l1").alias("y"), F.col("l1_pred").alias("p"))
    l2 = s.where(F.col("attack_class").isin("normal", "u2r", "r2l")).select(
        F.lit(2).alias("layer"), F.col("y_l2").alias("y"), F.col("l2_pred").alias("p"))
    return mt.scored_metrics(l1.unionByName(l2), "y", "p", by=["layer"])


@query("mcc", with_base(f"""
select tn, fp, fn, tp, {mcc_sql()} as mcc
from (select {confusion_sql('y_any', 'pred')} from scored) c"""))
def mcc(spark, sf_dir):
    """AGG5."""
    return mt.with_mcc(mt.confusion(scored_flows(spark, sf_dir), "y_any", "pred"))


@query("snapshot_metrics", with_base(f"""
select layer, tp, fp, tn, fn,
  {snapshot_sql()}
from (
  select 1 as layer, l1_tp as tp, l1_fp as fp, l1_tn as tn, l1_fn as fn from oc
  union all
  select 2, l2_tp, l2_fp, l2_tn, l2_fn from oc) c""",
                                      extra=f"oc as (select {outcome_sql()} from scored)"))
def snapshot_metrics(spark, sf_dir):
    """AGG6 over the CAS3 counts of both layers."""
    w = cas.outcome_counts_wide(scored_flows(spark, sf_dir))
    per_layer = w.select(F.expr(
        "stack(2, 1, l1_tp, l1_fp, l1_tn, l1_fn, 2, l2_tp, l2_fp, l2_tn, l2_fn) "
        "as (layer, tp, fp, tn, fn)"))
    return mt.snapshot_metrics(per_layer, keep=["layer", "tp", "fp", "tn", "fn"])


@query("detect_by_class", with_base("""
select attack_class, count(*) as total, cast(sum(pred) as bigint) as detected,
       round(cast(sum(pred) as double) / count(*), 6) as ratio
from scored where attack_class <> 'normal' group by attack_class"""))
def detect_by_class(spark, sf_dir):
    """AGG10."""
    return mt.detection_rate_by_class(scored_flows(spark, sf_dir))


@query("detect_seen_unseen", with_base(f"""
select seen, count(*) as total, cast(sum(pred) as bigint) as detected,
       round(cast(sum(pred) as double) / count(*), 6) as ratio
from (
  select t.pred, case when t.label in (select label from tr) then 'seen' else 'unseen' end as seen
  from te t where t.label <> 'normal') x
group by seen""", extra=f"""te as (select * from scored where md5('42:' || flow_id) < '4ccc'),
tr as (select * from scored where md5('42:' || flow_id) >= '4ccc'
        and label not in ({tx.sql_list(tx.PROBE)}))"""))
def detect_seen_unseen(spark, sf_dir):
    """AGG11 under failure scenario F1: the training side lost every probe
    label, so satan/portsweep in the test side are unseen."""
    s = sp.hash_split(scored_flows(spark, sf_dir))
    test = s.where(F.col("split") == "test")
    train = lb.remove_classes(s.where(F.col("split") == "train"), ["probe"])
    return mt.detection_rate_seen_unseen(test, train)


@query("roc_points", with_base("""
select threshold, round(cast(cneg as double) / nullif(nn, 0), 6) as fpr,
       round(cast(cpos as double) / nullif(pp, 0), 6) as tpr
from (select threshold,
             sum(pos) over (order by threshold desc rows between unbounded preceding and current row) as cpos,
             sum(neg) over (order by threshold desc rows between unbounded preceding and current row) as cneg,
             sum(pos) over () as pp, sum(neg) over () as nn
      from (select s1 as threshold, sum(case when y_l1 = 1 then 1 else 0 end) as pos,
                   sum(case when y_l1 = 0 then 1 else 0 end) as neg
            from scored group by s1) g) c
union all
select cast(null as double), 0e0, 0e0"""))
def roc_points(spark, sf_dir):
    """AGG8: ROC of the layer-1 score against the layer-1 target."""
    return mt.roc_points(scored_flows(spark, sf_dir), "s1", "y_l1")


@query("auc", with_base("""
select cast(sum(pos) over () as bigint) as positives, cast(sum(neg) over () as bigint) as negatives,
       round(sum(cast(neg as double) * (cast(above as double) + pos / 2e0)) over ()
             / (cast(sum(pos) over () as double) * cast(sum(neg) over () as double)), 6) as auc
from (select threshold, pos, neg,
             coalesce(sum(pos) over (order by threshold desc rows between unbounded preceding and 1 preceding), 0)
               as above
      from (select s1 as threshold, sum(case when y_l1 = 1 then 1 else 0 end) as pos,
                   sum(case when y_l1 = 0 then 1 else 0 end) as neg
            from scored group by s1) g) c
limit 1"""))
def auc(spark, sf_dir):
    """AGG9: trapezoid AUC of the layer-1 score (ties averaged)."""
    return mt.auc(scored_flows(spark, sf_dir), "s1", "y_l1")


@query("auc_hard", with_base("""
select cast(sum(y_l1) as bigint) as positives, cast(sum(1 - y_l1) as bigint) as negatives,
       round((sum(case when y_l1 = 1 and l1_pred = 1 then 1 else 0 end) / sum(y_l1)
            + sum(case when y_l1 = 0 and l1_pred = 0 then 1 else 0 end) / sum(1 - y_l1)) / 2e0, 6) as auc
from scored"""))
def auc_hard(spark, sf_dir):
    """AGG9 on hard 0/1 predictions: equals (TPR + TNR) / 2."""
    return mt.auc(scored_flows(spark, sf_dir), "l1_pred", "y_l1")


@query("metric_history", with_base("""
select layer, seq, round(cast(ctp as double) / (ctp + cfn), 6) as tpr,
       round(cast(cfp as double) / (cfp + ctn), 6) as fpr
from (select layer, seq,
        sum(tp) over w as ctp, sum(fp) over w as cfp, sum(tn) over w as ctn, sum(fn) over w as cfn
      from (
        select 1 as layer, flow_id as seq,
               case when tag = 'L1_ANOMALY' and y_any = 1 then 1 else 0 end as tp,
               case when tag = 'L1_ANOMALY' and y_any = 0 then 1 else 0 end as fp,
               case when tag <> 'L1_ANOMALY' and y_any = 0 then 1 else 0 end as tn,
               case when tag <> 'L1_ANOMALY' and y_any = 1 then 1 else 0 end as fn
        from scored
        union all
        select 2, flow_id,
               case when tag = 'L2_ANOMALY' and y_any = 1 then 1 else 0 end,
               case when tag = 'L2_ANOMALY' and y_any = 0 then 1 else 0 end,
               case when tag = 'NOT_ANOMALY2' and y_any = 0 then 1 else 0 end,
               case when tag = 'NOT_ANOMALY2' and y_any = 1 then 1 else 0 end
        from scored where tag in ('L2_ANOMALY', 'NOT_ANOMALY2')) u
      window w as (partition by layer order by seq rows between unbounded preceding and current row)) c
where ctp > 0 and cfp > 0 and ctn > 0 and cfn > 0"""))
def metric_history(spark, sf_dir):
    """STR6 batch form: running TPR/FPR per layer after each sample."""
    return mt.metric_history(scored_flows(spark, sf_dir))


@query("average_runs", with_base(f"""
select count(distinct run_id) as runs,
  round(avg(accuracy), 6) as avg_accuracy, round(avg(precision), 6) as avg_precision,
  round(avg(recall), 6) as avg_recall, round(avg(f1), 6) as avg_f1,
  round(avg(tnr), 6) as avg_tnr, round(avg(fpr), 6) as avg_fpr, round(avg(fnr), 6) as avg_fnr
from (select run_id, {rates_sql()}
      from (select run_id, {confusion_sql('y_any', 'pred')}
            from (select *, cast(('0x' || substr(md5('run:' || flow_id), 1, 8)) as bigint) % 5 as run_id
                  from scored) r group by run_id) c) m"""))
def average_runs(spark, sf_dir):
    """AGG12: every row is assigned to one of 5 runs by a hash draw, metrics
    are computed per run and averaged (repeat-and-average over disjoint
    folds of the whole table)."""
    s = scored_flows(spark, sf_dir).withColumn(
        "run_id", F.conv(F.substring(F.md5(F.concat(F.lit("run:"), F.col("flow_id"))), 1, 8), 16, 10)
        .cast("bigint") % 5)
    per_run = mt.rates(mt.confusion(s, "y_any", "pred", by=["run_id"]), keep=["run_id"])
    return mt.average_runs(per_run, ["accuracy", "precision", "recall", "f1", "tnr", "fpr", "fnr"])


@query("class_weights", with_base("""
select y_l2, count(*) as n, round(sum(count(*)) over () / (2e0 * count(*)), 6) as weight
from lf where attack_class in ('normal', 'u2r', 'r2l') group by y_l2"""))
def class_weights(spark, sf_dir):
    """AGG14 on the layer-2 population."""
    pop = lb.layer2_population(labelled_flows(spark, sf_dir))
    return mt.class_weights(pop, "y_l2")


@query("dataset_profile", with_base(f"""
select 'flows' as dataset, 13 as n_columns,
       '{",".join(["flow_id", "protocol_type", "service", "flag", "src_bytes", "count", "serror_rate",
                   "rerror_rate", "logged_in", "urgent", "label", "s1", "s2"])}' as column_names,
       count(*) as n_rows from flows"""))
def dataset_profile(spark, sf_dir):
    """AGG15 / AGG16."""
    return mt.dataset_profile(flows(spark, sf_dir), "flows")


@query("labelled_scores", """
select d.lang, cast(sum(case when l.quality = 0 and d.n_chars < 2000 then 1 else 0 end) as bigint) as tn,
       cast(sum(case when l.quality = 0 and d.n_chars >= 2000 then 1 else 0 end) as bigint) as fp,
       cast(sum(case when l.quality = 1 and d.n_chars < 2000 then 1 else 0 end) as bigint) as fn,
       cast(sum(case when l.quality = 1 and d.n_chars >= 2000 then 1 else 0 end) as bigint) as tp
from documents d join labels l on d.doc_id = l.doc_id group by d.lang""")
def labelled_scores(spark, sf_dir):
    """AGG3 on a non-flow table: document quality labels against a length
    rule (n_chars >= 2000), per language.  The label table covers only some
    documents: an inner equi-join, planned by size (AQE)."""
    from ..sources.flows import load_table
    d = load_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = load_table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id").withColumn("pred", (F.col("n_chars") >= 2000).cast("int"))
    return mt.confusion(j, "quality", "pred", by=["lang"])


@query("labelled_mcc", f"""
select lang, tn, fp, fn, tp, {mcc_sql()} as mcc, {rates_sql()}
from (select d.lang, {confusion_sql('l.toxic', "cast(d.source = 'forum' as integer)")}
      from documents d join labels l on d.doc_id = l.doc_id group by d.lang) c""")
def labelled_mcc(spark, sf_dir):
    """AGG4 + AGG5 on documents: toxicity labels against a source rule."""
    from ..sources.flows import load_table
    d = load_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    lab = load_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = d.join(lab, "doc_id").withColumn("pred", (F.col("source") == "forum").cast("int"))
    conf = mt.confusion(j, "toxic", "pred", by=["lang"])
    return mt.rates(mt.with_mcc(conf), keep=["lang", "mcc"])


@query("dataset_changed", """
select 'orders' as dataset, count(*) as old_n_rows, count(*) as n_rows, 0 as changed from orders
union all select 'customer', count(*), count(*) filter (where c_acctbal >= 0), 1 from customer
union all select 'supplier', null, count(*), 1 from supplier""")
def dataset_changed(spark, sf_dir):
    """AGG15: a second run against the stored profiles of the first: orders as before, customer with
    fewer rows, supplier new."""
    store = mt.ProfileStore(spark)
    orders, customer, supplier = (load_table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    store.changes({"orders": orders, "customer": customer}, 0).count()
    return store.changes({"orders": orders, "customer": customer.where("c_acctbal >= 0"), "supplier": supplier}, 1)
