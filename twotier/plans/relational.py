"""Relational, source and sampling queries (SRC1 SRC4 FLT3 FLT4 JON2 JON3
JON5 SET1-3 SPL1-SPL3 AGG15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rates import r6
from ..operators import labels as lb
from ..operators import relational as rel
from ..operators import sampling as sp
from ..session import shared_path
from ..sources import sinks
from ..sources.flows import flows, load_table, read_flows, read_headered
from ..sources.schema import loaded_flow_schema
from .common import labelled_flows, query
from .sqlparts import strat_split_sql, with_base

ORDERS_NOW = "1998-08-02 02:00:00"


@query("dict_query", """
select o_orderkey, o_totalprice, o_orderpriority from orders
where o_orderstatus = 'F' and o_totalprice > 1e5""")
def dict_query(spark, sf_dir):
    """FLT3: a {select, from, where} request against a named table."""
    tables = {"orders": load_table(spark, sf_dir, "orders")}
    return rel.perform_query(spark, {
        "select": "o_orderkey, o_totalprice, o_orderpriority",
        "from": "orders",
        "where": "o_orderstatus = 'F' and o_totalprice > 1e5",
    }, tables)


@query("dict_query_calls", """
select o_orderkey, round(o_totalprice, 0) as price, concat(o_orderstatus, ', ', substr(o_orderpriority, 1, 1)) as tag
from orders where o_totalprice > 1e5""")
def dict_query_calls(spark, sf_dir):
    """FLT3: SELECT items with commas inside calls and quotes."""
    tables = {"orders": load_table(spark, sf_dir, "orders")}
    return rel.perform_query(spark, {
        "select": "o_orderkey, round(o_totalprice, 0) as price, "
                  "concat(o_orderstatus, ', ', substr(o_orderpriority, 1, 1)) as tag",
        "from": "orders",
        "where": "o_totalprice > 1e5",
    }, tables)


@query("stale_sources", f"""
select o_orderkey, o_orderdate,
       cast(coalesce(o_orderdate < timestamp '{ORDERS_NOW}' - interval 3 hour, false) as integer) as stale
from orders""")
def stale_sources(spark, sf_dir):
    """FLT4: staleness of every order date against a fixed ``now``."""
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return rel.is_stale(o, "o_orderdate", ORDERS_NOW).withColumn("stale", F.col("stale").cast("int"))


@query("set_difference", """
select c_custkey, c_name from customer
where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_totalprice > 4e5)""")
def set_difference(spark, sf_dir):
    """JON3: customers that placed no large order (left anti-join)."""
    c = load_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = load_table(spark, sf_dir, "orders").where("o_totalprice > 4e5").select(F.col("o_custkey").alias("c_custkey"))
    return rel.set_difference(c, o, "c_custkey")


@query("append_by_position", with_base(
    "select flow_id, src_bytes, count, label, y_any from lf"))
def append_by_position(spark, sf_dir):
    """JON2: features and the target vector kept apart, re-attached by the
    shared row key (inner equi-join, alignment checked)."""
    lf = labelled_flows(spark, sf_dir)
    feats = lf.select("flow_id", "src_bytes", "count", "label")
    path = shared_path(spark, "targets")
    lf.select("flow_id", "y_any").write.parquet(path)
    target = spark.read.parquet(path)
    rel.check_aligned(feats, target, "flow_id")
    return rel.append_column_by_key(feats, target, "flow_id")


@query("append_by_file_order", with_base(
    "select protocol_type, src_bytes, count, serror_rate, y_any from lf"))
def append_by_file_order(spark, sf_dir):
    """JON2 by file order: a CSV file of features and a parquet file of targets, both without a key."""
    lf = labelled_flows(spark, sf_dir)
    features, targets = shared_path(spark, "features"), shared_path(spark, "file-targets")
    lf.select("protocol_type", "src_bytes", "count", "serror_rate").write.option("header", True).csv(features)
    lf.select("y_any").write.parquet(targets)
    left = spark.read.option("header", True).schema("protocol_type string, src_bytes double, count double, serror_rate double").csv(features)
    return rel.append_by_file_order(left, spark.read.parquet(targets))


@query("gather_subset", with_base(
    "select flow_id, pred from scored where label in ('rootkit', 'guess_passwd')",
    extra=""))
def gather_subset(spark, sf_dir):
    """JON5: predictions for the rows of a subset (semi-join on flow_id)."""
    from .common import scored_flows
    s = scored_flows(spark, sf_dir).select("flow_id", "pred")
    ids = flows(spark, sf_dir).where(F.col("label").isin("rootkit", "guess_passwd")).select("flow_id")
    return rel.gather(s, ids, "flow_id")


@query("unseen_labels", with_base("""
select label from (select distinct label from flows where md5('42:' || flow_id) < '4ccc' and label <> 'normal')
where label not in (select label from flows where md5('42:' || flow_id) >= '4ccc'
                    and label not in ('ipsweep', 'mscan', 'nmap', 'portsweep', 'saint', 'satan'))"""))
def unseen_labels(spark, sf_dir):
    """SET2: test attack labels minus train labels (scenario F1)."""
    f = sp.hash_split(flows(spark, sf_dir))
    test = f.where((F.col("split") == "test") & (F.col("label") != "normal"))
    train = lb.remove_classes(f.where(F.col("split") == "train"), ["probe"])
    return rel.except_lists(test, train, "label")


@query("labels_beyond", with_base("""
select distinct label from flows where label not in ('normal', 'smurf')"""))
def labels_beyond(spark, sf_dir):
    """SET2 with the larger left side: every label minus those of a few rows."""
    f = flows(spark, sf_dir)
    few = f.where(F.col("label").isin("normal", "smurf")).dropDuplicates(["label"])
    return rel.except_lists(f, few, "label")


@query("labels_in_both", with_base("""
select distinct label from flows where md5('42:' || flow_id) < '4ccc'
and label in (select label from flows where md5('42:' || flow_id) >= '4ccc')"""))
def labels_in_both(spark, sf_dir):
    """SET1: labels of both sides of the split."""
    f = sp.hash_split(flows(spark, sf_dir)).select("label", "split")
    return rel.intersect_lists(f.where("split = 'test'"), f.where("split = 'train'"), "label")


@query("union_by_name", with_base("""
select label, side, count(*) as n, count(src_bytes) as n_bytes from (
  select label, 'attack' as side, src_bytes from flows where label <> 'normal'
  union all select label, 'normal', null from flows where label = 'normal') u group by label, side"""))
def union_by_name(spark, sf_dir):
    """SET3: rows of two frames with different columns, missing ones NULL."""
    f = flows(spark, sf_dir)
    attack = f.where("label <> 'normal'").select("label", "src_bytes", F.lit("attack").alias("side"))
    normal = f.where("label = 'normal'").select(F.lit("normal").alias("side"), "label")
    return rel.union_rows(attack, normal).groupBy("label", "side").agg(
        F.count(F.lit(1)).alias("n"), F.count("src_bytes").alias("n_bytes"))


@query("raw_flows_roundtrip", with_base("""
select label, count(*) as n, cast(sum(cast(round(src_bytes * 100) as bigint)) as bigint) as sum_src_cents,
       count(distinct protocol_type) as n_protocols, round(sum(serror_rate), 6) as sum_serror_rate
from flows group by label"""))
def raw_flows_roundtrip(spark, sf_dir):
    """SRC1 + SRC4: export flows as headerless 43-column raw records and as a
    headered re-export, read both back with the fixed schema, aggregate."""
    f = flows(spark, sf_dir)
    raw_path = shared_path(spark, "raw-flows")
    sinks.write_raw_records(f, raw_path)
    back = read_flows(spark, raw_path)
    hdr_path = shared_path(spark, "headered-flows")
    sinks.write_headered(back, hdr_path)
    again = read_headered(spark, hdr_path, loaded_flow_schema())
    return again.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("src_bytes") * 100).cast("bigint")).alias("sum_src_cents"),
        F.countDistinct("protocol_type").alias("n_protocols"),
        r6(F.sum("serror_rate")).alias("sum_serror_rate"))


@query("stratified_split", with_base(f"""
select flow_id, attack_class, split from ({strat_split_sql("lf")}) x"""))
def stratified_split(spark, sf_dir):
    """SPL1: exact per-class 70/30 split by md5 rank."""
    return sp.stratified_split(labelled_flows(spark, sf_dir)).select("flow_id", "attack_class", "split")


@query("split_sizes", with_base(f"""
select attack_class, split, count(*) as n from ({strat_split_sql("lf")}) x group by attack_class, split"""))
def split_sizes(spark, sf_dir):
    """SPL1 class x split sizes."""
    s = sp.stratified_split(labelled_flows(spark, sf_dir))
    return s.groupBy("attack_class", "split").agg(F.count(F.lit(1)).alias("n"))


@query("random_split", with_base("""
select flow_id, case when cast(('0x' || substr(md5('42:' || flow_id), 1, 8)) as bigint) / 4294967296e0 < 2e-1
            then 'test' else 'train' end as split
from flows"""))
def random_split(spark, sf_dir):
    """SPL2: unstratified 80/20 by a uniform hash draw."""
    return sp.random_split(flows(spark, sf_dir)).select("flow_id", "split")


@query("hash_split", with_base("""
select label, case when md5('42:' || flow_id) < '4ccc' then 'test' else 'train' end as split, count(*) as n
from flows group by 1, 2"""))
def hash_split(spark, sf_dir):
    """SPL2 scale mode: hash-threshold split (no shuffle), sizes per label."""
    s = sp.hash_split(flows(spark, sf_dir))
    return s.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query("undersample_l2", with_base("""
select flow_id, y_l2 from (
  select flow_id, y_l2, row_number() over (partition by y_l2 order by md5('42:' || flow_id)) as rn
  from lf where attack_class in ('normal', 'u2r', 'r2l')) x
where rn <= (select min(n) from (select count(*) as n from lf
                                 where attack_class in ('normal', 'u2r', 'r2l') group by y_l2) c)"""))
def undersample_l2(spark, sf_dir):
    """SPL3: keep every layer-2 attack and as many normal flows (smallest
    hashes)."""
    pop = lb.layer2_population(labelled_flows(spark, sf_dir)).select("flow_id", "y_l2")
    return sp.undersample(pop, "y_l2")
