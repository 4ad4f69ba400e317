"""Control-loop queries (CTL1-CTL7): snapshot messages from the NB+NB
cascade, objectives, strict parsing, routing, objective lists, update lists
and content dedup.  Messages are derived from the ``events`` table (one
message per event) or from per-run cascade counts, so the work grows with
the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import r6, ratio_or_zero, snapshot_metric_columns
from ..operators import cascade as cas
from ..operators import control as ctl
from ..sources.flows import load_table
from ..sources.thresholds import METRIC_ORDER, thresholds_values_sql
from .common import query
from .learning import NB_EXTRA, nb_scored
from .sqlparts import snapshot_sql, with_base

RUN_ID = "cast(('0x' || substr(md5('run:' || flow_id), 1, 8)) as bigint) % 5"

# event_type -> message type on the wire; 'error' events carry an unknown type
EVENT_MSG = {"view": "METRICS_SNAPSHOT_MSG", "click": "OBJECTIVES_MSG",
             "signup": "MULTIPLE_UPDATE_MSG", "purchase": "MODEL_UPDATE_MSG", "error": "ERROR"}


def run_id_col():
    return F.conv(F.substring(F.md5(F.concat(F.lit("run:"), F.col("flow_id"))), 1, 8), 16, 10) \
        .cast("bigint") % 5


def run_snapshots(spark, sf_dir) -> DataFrame:
    """Per run (5 hash folds of the test rows): both layers' snapshot
    metrics and the destination ratios, one wide row per run."""
    s = nb_scored(spark, sf_dir).withColumn("run_id", run_id_col())
    w = cas.outcome_counts_wide(s, by=["run_id"])
    t = F.col("total")
    ratios = {
        "normal_ratio": r6(ratio_or_zero(F.col("l2_tn") + F.col("l2_fn"), t)),
        "l1_anomaly_ratio": r6(ratio_or_zero(F.col("l1_tp") + F.col("l1_fp"), t)),
        "l2_anomaly_ratio": r6(ratio_or_zero(F.col("l2_tp") + F.col("l2_fp"), t)),
        "quarantined_ratio": r6(ratio_or_zero(F.col("quarantined"), t)),
    }
    l1 = snapshot_metric_columns("l1_tp", "l1_fp", "l1_tn", "l1_fn")
    l2 = snapshot_metric_columns("l2_tp", "l2_fp", "l2_tn", "l2_fn")
    from ..functions.rates import SNAPSHOT_METRICS
    cols = [c.alias(f"m1_{n}") for c, n in zip(l1, SNAPSHOT_METRICS)]
    cols += [c.alias(f"m2_{n}") for c, n in zip(l2, SNAPSHOT_METRICS)]
    return w.select("run_id", *cols, *[v.alias(k) for k, v in ratios.items()])


def _runs_sql() -> str:
    from ..functions.rates import SNAPSHOT_METRICS
    from .sqlparts import outcome_sql
    s1 = snapshot_sql("l1_tp", "l1_fp", "l1_tn", "l1_fn")
    s2 = snapshot_sql("l2_tp", "l2_fp", "l2_tn", "l2_fn")
    for n in SNAPSHOT_METRICS:
        s1 = s1.replace(f" as {n}", f" as m1_{n}")
        s2 = s2.replace(f" as {n}", f" as m2_{n}")
    return NB_EXTRA + f""",
roc as (select run_id, {outcome_sql()} from (select *, {RUN_ID} as run_id from nbs) r group by run_id),
runs as (select run_id, {s1}, {s2},
  round((l2_tn + l2_fn) / total, 6) as normal_ratio,
  round((l1_tp + l1_fp) / total, 6) as l1_anomaly_ratio,
  round((l2_tp + l2_fp) / total, 6) as l2_anomaly_ratio,
  round(quarantined / total, 6) as quarantined_ratio
  from roc),
rlong as (""" + " union all ".join(
        f"select run_id, {layer} as layer, '{m}' as metric, {i} as ordinal, m{layer}_{m} as value from runs"
        for layer in (1, 2) for i, m in enumerate(METRIC_ORDER)) + f"""),
th as (select * from {thresholds_values_sql()})"""


RUNS_EXTRA = _runs_sql()


def parsed_runs(spark, sf_dir) -> DataFrame:
    """CTL2 build -> CTL3 strict parse of the per-run snapshots."""
    msgs = ctl.build_snapshot(run_snapshots(spark, sf_dir), keep=["run_id"])
    accepted, _ = ctl.parse_snapshot(msgs, keep=["run_id"])
    return accepted


@query("snapshot_roundtrip", with_base(
    "select run_id, " + ", ".join(f"m{k}_{m}" for m in METRIC_ORDER for k in (1, 2))
    + ", normal_ratio, l1_anomaly_ratio, l2_anomaly_ratio, quarantined_ratio from runs",
    extra=RUNS_EXTRA))
def snapshot_roundtrip(spark, sf_dir):
    """CTL2 + CTL3: per-run snapshot JSON built and strictly parsed back."""
    a = parsed_runs(spark, sf_dir)
    cols = [F.col(f"metrics_{k}.{m}").alias(f"m{k}_{m}") for m in METRIC_ORDER for k in (1, 2)]
    return a.select("run_id", *cols, *[F.col(f"classification_metrics.{r}").alias(r)
                                       for r in ctl.RATIO_KEYS])


def _objectives_sql(mode: str) -> str:
    if mode == "reference":
        fire = "l.value < th.threshold"
    else:
        fire = ("case when th.lower_is_better then l.value > th.threshold "
                "else l.value < th.threshold end")
    return with_base(f"""
select l.run_id, l.layer, coalesce(string_agg(l.metric, ',' order by l.ordinal) filter (where {fire}), '') as objs
from rlong l join th on l.layer = th.layer and l.metric = th.metric
group by l.run_id, l.layer""", extra=RUNS_EXTRA)


def _objectives(mode: str):
    def run(spark, sf_dir):
        """CTL1 over parsed snapshots: metrics failing their layer threshold."""
        long = ctl.metrics_long(parsed_runs(spark, sf_dir), ["run_id"])
        lists = ctl.objectives(long, ["run_id"], mode)
        return lists.select("run_id", "layer", F.array_join("objs", ",").alias("objs"))
    return run


query("objectives", _objectives_sql("reference"))(_objectives("reference"))
query("objectives_corrected", _objectives_sql("corrected"))(_objectives("corrected"))


@query("objectives_message", with_base("""
select l.run_id,
       coalesce(string_agg(l.metric, ',' order by l.ordinal) filter (where l.layer = 1 and l.value < th.threshold), '') as objs_layer1,
       coalesce(string_agg(l.metric, ',' order by l.ordinal) filter (where l.layer = 2 and l.value < th.threshold), '') as objs_layer2
from rlong l join th on l.layer = th.layer and l.metric = th.metric group by l.run_id""", extra=RUNS_EXTRA))
def objectives_message(spark, sf_dir):
    """CTL1 + CTL5: one reply message per run, parsed back; a healthy layer's
    list is empty, and every run has a message."""
    lists = ctl.objectives(ctl.metrics_long(parsed_runs(spark, sf_dir), ["run_id"]), ["run_id"])
    parsed = ctl.parse_objectives(ctl.objectives_message(lists, ["run_id"]))
    return parsed.select("run_id", F.array_join("objs_layer1", ",").alias("objs_layer1"),
                         F.array_join("objs_layer2", ",").alias("objs_layer2"))


@query("snapshot_rejects", with_base("""
select run_id, case when run_id = 1 then 'metrics_2.fscore' else 'classification_metrics' end as missing
from runs where run_id in (1, 3)""", extra=RUNS_EXTRA))
def snapshot_rejects(spark, sf_dir):
    """CTL3 strict parse: run 1 loses metrics_2.fscore and run 3 its ratio
    block before serialisation (null fields are omitted), so both land in
    the rejects frame with the missing field named."""
    w = run_snapshots(spark, sf_dir)
    w = w.withColumn("m2_fscore", F.when(F.col("run_id") == 1, F.lit(None)).otherwise(F.col("m2_fscore")))
    msgs = ctl.build_snapshot(w, keep=["run_id"])
    msgs = msgs.withColumn("msg", F.when(
        F.col("run_id") == 3,
        F.regexp_replace("msg", r',"classification_metrics":\{[^}]*\}', "")).otherwise(F.col("msg")))
    _, rejects = ctl.parse_snapshot(msgs, keep=["run_id"])
    return rejects


# --------------------------------------------------------------------------- event messages
def event_messages(spark, sf_dir) -> DataFrame:
    """One wire message per event: type from ``event_type``, payload from
    ``props`` (``{"k": n}``); objectives and update lists are chosen by the
    bits of k."""
    ev = load_table(spark, sf_dir, "events").select(
        "event_id", "ts", "event_type", "props", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k = F.col("k")
    mtype = F.create_map(*[x for e, m in EVENT_MSG.items() for x in (F.lit(e), F.lit("msg_type." + m))])
    names = "array(" + ", ".join(f"'{m}'" for m in METRIC_ORDER) + ")"
    objs1 = F.expr(f"filter({names}, (m, i) -> (shiftright(k, i) & 1) = 1)")
    objs2 = F.expr(f"filter({names}, (m, i) -> (shiftright(k, i + 1) & 1) = 1)")
    upd = F.expr("filter(array('FEATURES', 'TRAIN', 'VALIDATE'), (u, i) -> (shiftright(k, i) & 1) = 1)")
    et = F.col("event_type")
    body = F.struct(
        mtype[et].alias("MSG_TYPE"),
        F.when((et == "click") & (k % 3 != 0), objs1).alias("objs_layer1"),
        F.when((et == "click") & (k % 2 == 0), objs2).alias("objs_layer2"),
        F.when(et == "signup", upd).alias("UPDATE"),
        F.when(et == "signup", F.lit("KnowledgeBase")).alias("SENDER"),
        F.col("props").alias("payload"),
    )
    return ev.select("event_id", "ts", F.to_json(body).alias("msg"), "k")


MSG_TYPE_SQL = "case event_type " + " ".join(
    f"when '{e}' then 'msg_type.{m}'" for e, m in EVENT_MSG.items()) + " end"
K_SQL = "cast(json_extract_string(props, '$.k') as integer)"


@query("route_messages", f"""
select case when t in ('msg_type.MODEL_UPDATE_MSG', 'msg_type.MULTIPLE_UPDATE_MSG',
                       'msg_type.METRICS_SNAPSHOT_MSG', 'msg_type.OBJECTIVES_MSG', 'msg_type.TUNING_END_MSG')
            then substr(t, 10) else 'unrouted' end as route, count(*) as n
from (select {MSG_TYPE_SQL} as t from events) e group by 1""")
def route_messages(spark, sf_dir):
    """CTL4: route by MSG_TYPE; unknown types go to ``unrouted``."""
    r = ctl.route_messages(event_messages(spark, sf_dir))
    return r.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def _bits_sql(names: list[str], shift: int = 0) -> str:
    parts = ", ".join(f"case when (k >> {i + shift}) & 1 = 1 then '{n}' end" for i, n in enumerate(names))
    return f"concat_ws(',', {parts})"


@query("objective_lists", f"""
select event_id,
       case when k % 3 <> 0 then {_bits_sql(METRIC_ORDER)} else '' end as objs_layer1,
       case when k % 2 = 0 then {_bits_sql(METRIC_ORDER, 1)} else '' end as objs_layer2
from (select event_id, {K_SQL} as k from events where event_type = 'click') e""")
def objective_lists(spark, sf_dir):
    """CTL5: parse objectives messages; a missing list is []."""
    m = ctl.route_messages(event_messages(spark, sf_dir)).where(F.col("route") == "OBJECTIVES_MSG")
    p = ctl.parse_objectives(m)
    return p.select("event_id", F.array_join("objs_layer1", ",").alias("objs_layer1"),
                    F.array_join("objs_layer2", ",").alias("objs_layer2"))


@query("updates", f"""
select event_id, 'KnowledgeBase' as sender, position, refresh from (
  select event_id, 0 as position, 'FEATURES' as refresh, k from u where k & 1 = 1
  union all select event_id, (k & 1), 'TRAIN', k from u where (k >> 1) & 1 = 1
  union all select event_id, (k & 1) + ((k >> 1) & 1), 'VALIDATE', k from u where (k >> 2) & 1 = 1
) x""".replace("from u", f"from (select event_id, {K_SQL} as k from events where event_type = 'signup') u"))
def updates(spark, sf_dir):
    """CTL6: explode the UPDATE list of every update message."""
    m = ctl.route_messages(event_messages(spark, sf_dir)).where(F.col("route") == "MULTIPLE_UPDATE_MSG")
    return ctl.explode_updates(m, keep=["event_id"])


@query("dedup", f"""
select event_id, msg_type, payload, copies from (
  select event_id, msg_type, payload, count(*) over (partition by msg_type, payload) as copies,
         row_number() over (partition by msg_type, payload order by ts, event_id) as rn
  from (select event_id, ts, {MSG_TYPE_SQL} as msg_type, props as payload from events) e) x
where rn = 1""")
def dedup(spark, sf_dir):
    """CTL7 (batch): first message of every distinct content, with the
    number of copies."""
    m = event_messages(spark, sf_dir).select(
        "event_id", "ts", F.get_json_object("msg", "$.MSG_TYPE").alias("msg_type"),
        F.get_json_object("msg", "$.payload").alias("payload"))
    d = ctl.dedup_messages(m, ["msg_type", "payload"], ["ts", "event_id"])
    return d.select("event_id", "msg_type", "payload", "copies")
