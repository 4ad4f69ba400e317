"""Streaming queries (S checks: the final state of each stream must equal the
batch oracle of the same rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_path
from ..sources.flows import load_table
from ..streaming import detection as sd
from .common import query
from .sqlparts import outcome_sql, snapshot_sql, with_base
from ..sources.thresholds import METRIC_ORDER, thresholds_values_sql


#: The micro-batch of a row: quiet traffic (no layer raises an alarm) first, then by line number.
STEPS = 6
STEP_SQL = f"case when l_extendedprice < 50000 and l_quantity < 10 then 0 else least(l_linenumber, {STEPS - 1}) end"


def _land(spark, sf_dir):
    """The feeder: the whole table in a landing folder, one part after the other."""
    path = shared_path(spark, "landing")
    load_table(spark, sf_dir, "lineitem").withColumn("step", F.expr(STEP_SQL)).write.partitionBy("step").parquet(path)
    return path


def _run(spark, sf_dir):
    """All landed files in micro-batches of a sixth of them."""
    out, landing = shared_path(spark, "snapshots"), _land(spark, sf_dir)
    files = len(spark.read.parquet(landing).inputFiles())
    # the glob keeps the folder names out: they are no columns of the records
    sd.run_detection(spark, f"{landing}/*", out, shared_path(spark, "ckpt-detect"), files_per_trigger=-(-files // STEPS))
    return out


_LAYER_COUNTS = f"""oc as (select {outcome_sql()} from scored),
lc as (select 1 as layer, l1_tp as tp, l1_fp as fp, l1_tn as tn, l1_fn as fn from oc
       union all select 2, l2_tp, l2_fp, l2_tn, l2_fn from oc)"""


@query("stream_counts", with_base("select 0 as epoch, layer, tp, fp, tn, fn from lc", extra=_LAYER_COUNTS))
def stream_counts(spark, sf_dir):
    """STR1 + STR2: flows streamed file by file, cascade-scored, counted in
    the state store; the last snapshot's counts equal the batch counts."""
    snap = sd.latest_snapshot(spark, _run(spark, sf_dir))
    return snap.select("epoch", "layer", "tp", "fp", "tn", "fn")


@query("stream_snapshot", with_base(f"select layer, tp, fp, tn, fn, {snapshot_sql()} from lc",
                                    extra=_LAYER_COUNTS))
def stream_snapshot(spark, sf_dir):
    """STR3 + STR4 + SNK3: per-batch gated snapshots appended by batch id;
    the last one equals the batch snapshot metrics."""
    snap = sd.latest_snapshot(spark, _run(spark, sf_dir))
    return snap.select("layer", "tp", "fp", "tn", "fn", "accuracy", "precision", "tpr", "fpr", "tnr",
                       "fnr", "fscore")


_OBJ_EXTRA = _LAYER_COUNTS + f""",
sm as (select layer, {snapshot_sql()} from lc),
sl as (""" + " union all ".join(
    f"select layer, '{m}' as metric, {i} as ordinal, {m} as value from sm" for i, m in enumerate(METRIC_ORDER)) \
    + f"""),
th as (select * from {thresholds_values_sql()})"""


@query("stream_objectives", with_base("""
select l.layer, coalesce(string_agg(l.metric, ',' order by l.ordinal) filter (where l.value < th.threshold), '') as objs
from sl l join th on l.layer = th.layer and l.metric = th.metric
group by l.layer""", extra=_OBJ_EXTRA))
def stream_objectives(spark, sf_dir):
    """STR7: objectives computed for every snapshot as it lands; those of
    the last snapshot equal the batch objectives."""
    snaps = _run(spark, sf_dir)
    out = shared_path(spark, "objectives")
    sd.objectives_stream(spark, snaps, out, shared_path(spark, "ckpt-objectives"))
    lists = spark.read.parquet(out)
    last = spark.read.parquet(snaps).agg(F.max("batch_id").alias("_b"))
    return (lists.join(F.broadcast(last), lists.batch_id == last._b)
            .select("layer", F.array_join("objs", ",").alias("objs")))


_STEP_COUNTS = """
st as (select scored.*, step from scored join (select md5(concat('flow:', cast(l_orderkey as string), '-', cast(l_partkey as string),
    '-', cast(l_suppkey as string), '-', cast(l_linenumber as string), '-',
    cast(cast(round(l_extendedprice * 100) as bigint) as string))) as id, """ + STEP_SQL + """ as step from lineitem) i on i.id = flow_id),
sc as (select step, """ + outcome_sql() + """ from st group by step),
cum as (select step as batch_id, """ + ", ".join(
    f"cast(sum(l{k}_{o}) over (order by step) as bigint) as l{k}_{o}" for k in (1, 2) for o in ("tp", "fp", "tn", "fn")) + """ from sc),
op as (select * from cum where (l1_tp > 0 and l1_fp > 0 and l1_tn > 0 and l1_fn > 0)
                            or (l2_tp > 0 and l2_fp > 0 and l2_tn > 0 and l2_fn > 0))"""


@query("stream_batches", with_base("""
select batch_id, 1 as layer, l1_tp as tp, l1_fp as fp, l1_tn as tn, l1_fn as fn from op
union all select batch_id, 2, l2_tp, l2_fp, l2_tn, l2_fn from op""", extra=_STEP_COUNTS))
def stream_batches(spark, sf_dir):
    """STR3 + STR4: one micro-batch per landed part; the first leaves the gate closed and sends
    no snapshot, and every snapshot after its opening has the running counts so far.  The
    stream stops and resumes between the parts, with its state."""
    landing, out, ckpt = (shared_path(spark, n) for n in ("landing", "snapshots", "ckpt-batches"))
    li = load_table(spark, sf_dir, "lineitem")
    for step in range(STEPS):
        li.where(F.expr(STEP_SQL) == step).write.mode("append").parquet(landing)
        sd.run_detection(spark, landing, out, ckpt, files_per_trigger=1_000_000)  # all that has landed
    return spark.read.parquet(out).select("batch_id", "layer", "tp", "fp", "tn", "fn")


DEDUP_HORIZON = 24


@query("stream_dedup", f"""
with recursive e as (select event_type, props as payload, cast(floor(epoch(cast(ts as timestamp)) / 3600) as bigint) as hour from events),
c as (select distinct event_type, payload, hour from e)
select event_type, payload, count(*) as n, max(hour) as last_hour from c a
where not exists (select 1 from c b where b.event_type = a.event_type and b.payload = a.payload
                  and b.hour < a.hour and b.hour >= a.hour - {DEDUP_HORIZON})
group by event_type, payload""")
def stream_dedup(spark, sf_dir):
    """CTL7 stream: repeats of a content within 24 hours go, later ones pass; how often each
    content passed and when last.  Only the store's hours within the horizon are read."""
    out, store, ckpt = (shared_path(spark, n) for n in ("dedup", "dedup-store", "ckpt-dedup"))
    sd.dedup_stream(spark, sf_dir, out, store, ckpt, DEDUP_HORIZON)
    passed = spark.read.parquet(out)
    return passed.groupBy("event_type", "payload").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.floor(F.unix_timestamp("ts") / 3600)).alias("last_hour"))
