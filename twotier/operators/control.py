"""Control loop: snapshot messages, objectives, routing, dedup (CTL1-CTL7).

Messages are JSON strings in a column; building and parsing them uses
``to_json`` / ``from_json`` with explicit schemas, so the work stays
JVM-side and scales with the message volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.thresholds import METRIC_ORDER, WIRE_PREFIX, thresholds_frame

SNAPSHOT_KEYS = ["accuracy", "precision", "tpr", "fpr", "tnr", "fnr", "fscore"]
RATIO_KEYS = ["normal_ratio", "l1_anomaly_ratio", "l2_anomaly_ratio", "quarantined_ratio"]

METRICS_STRUCT = T.StructType([T.StructField(k, T.DoubleType()) for k in SNAPSHOT_KEYS])
RATIOS_STRUCT = T.StructType([T.StructField(k, T.DoubleType()) for k in RATIO_KEYS])
SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("MSG_TYPE", T.StringType()),
    T.StructField("metrics_1", METRICS_STRUCT),
    T.StructField("metrics_2", METRICS_STRUCT),
    T.StructField("classification_metrics", RATIOS_STRUCT),
])
OBJECTIVES_SCHEMA = T.StructType([
    T.StructField("MSG_TYPE", T.StringType()),
    T.StructField("objs_layer1", T.ArrayType(T.StringType())),
    T.StructField("objs_layer2", T.ArrayType(T.StringType())),
])
UPDATE_SCHEMA = T.StructType([
    T.StructField("MSG_TYPE", T.StringType()),
    T.StructField("UPDATE", T.ArrayType(T.StringType())),
    T.StructField("SENDER", T.StringType()),
])


def wire(msg_type: str) -> Column:
    return F.lit(WIRE_PREFIX + msg_type)


def metrics_struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{k}").alias(k) for k in SNAPSHOT_KEYS])


def build_snapshot(wide: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """CTL2: one JSON snapshot per row of a frame holding ``m1_<metric>``,
    ``m2_<metric>`` and the four destination ratios."""
    msg = F.struct(
        wire("METRICS_SNAPSHOT_MSG").alias("MSG_TYPE"),
        metrics_struct("m1_").alias("metrics_1"),
        metrics_struct("m2_").alias("metrics_2"),
        F.struct(*[F.col(k) for k in RATIO_KEYS]).alias("classification_metrics"),
    )
    return wide.select(*(keep or []), F.to_json(msg).alias("msg"))


def _missing_paths() -> list[tuple[str, Column]]:
    """(path, is-missing) for every required key of a snapshot."""
    out: list[tuple[str, Column]] = []
    for top in ("metrics_1", "metrics_2", "classification_metrics"):
        keys = RATIO_KEYS if top == "classification_metrics" else SNAPSHOT_KEYS
        out.append((top, F.col(f"_p.{top}").isNull()))
        for k in keys:
            out.append((f"{top}.{k}", F.col(f"_p.{top}").isNotNull() & F.col(f"_p.{top}.{k}").isNull()))
    return out


def parse_snapshot(df: DataFrame, col: str = "msg", keep: list[str] | None = None
                   ) -> tuple[DataFrame, DataFrame]:
    """CTL3: strict parse.  Returns (accepted, rejects); a reject names the
    first missing required field (JSON null counts as missing)."""
    parsed = df.select(*(keep or []), F.from_json(F.col(col), SNAPSHOT_SCHEMA).alias("_p"))
    checks = _missing_paths()
    first_missing = F.coalesce(*[F.when(c, F.lit(p)) for p, c in checks])
    tagged = parsed.withColumn("missing", first_missing)
    accepted = tagged.where(F.col("missing").isNull()).select(*(keep or []), "_p.*")
    rejects = tagged.where(F.col("missing").isNotNull()).select(*(keep or []), "missing")
    return accepted, rejects


def metrics_long(accepted: DataFrame, keep: list[str]) -> DataFrame:
    """Unpivot a parsed snapshot to (layer, metric, ordinal, value)."""
    parts = []
    for layer, top in ((1, "metrics_1"), (2, "metrics_2")):
        for i, m in enumerate(METRIC_ORDER):
            parts.append(f"{layer}, '{m}', {i}, {top}.{m}")
    stack = f"stack({len(parts)}, {', '.join(parts)}) as (layer, metric, ordinal, value)"
    return accepted.select(*keep, F.expr(stack))


def objectives(long: DataFrame, keep: list[str], mode: str = "reference") -> DataFrame:
    """CTL1: per layer, the metrics strictly below their threshold (in
    ``corrected`` mode error rates fire when strictly above).  Lists keep the
    message's metric order; a layer with nothing to fire has an empty list.
    Thresholds are a 14-row broadcast."""
    th = F.broadcast(thresholds_frame(long.sparkSession))
    j = long.join(th, ["layer", "metric", "ordinal"], "inner")
    if mode == "reference":
        fire = F.col("value") < F.col("threshold")
    else:
        fire = F.when(F.col("lower_is_better"), F.col("value") > F.col("threshold")) \
            .otherwise(F.col("value") < F.col("threshold"))
    lists = (j.groupBy(*keep, "layer")
             .agg(F.array_sort(F.collect_list(F.when(fire, F.struct("ordinal", "metric")))).alias("_o"))
             .select(*keep, "layer", F.transform("_o", lambda s: s["metric"]).alias("objs")))
    return lists


def objectives_message(lists: DataFrame, keep: list[str]) -> DataFrame:
    """The analyzer's reply as JSON (both layers' lists, [] when none)."""
    wide = lists.groupBy(*keep).agg(
        F.max(F.when(F.col("layer") == 1, F.col("objs"))).alias("objs_layer1"),
        F.max(F.when(F.col("layer") == 2, F.col("objs"))).alias("objs_layer2"))
    empty = F.array().cast("array<string>")
    msg = F.struct(wire("OBJECTIVES_MSG").alias("MSG_TYPE"),
                   F.coalesce("objs_layer1", empty).alias("objs_layer1"),
                   F.coalesce("objs_layer2", empty).alias("objs_layer2"))
    return wide.select(*keep, F.to_json(msg).alias("msg"))


def route_messages(df: DataFrame, col: str = "msg") -> DataFrame:
    """CTL4: classify by MSG_TYPE; unknown types are routed to ``unrouted``."""
    from ..sources.thresholds import MSG_TYPES
    t = F.get_json_object(F.col(col), "$.MSG_TYPE")
    known = F.substring_index(t, ".", -1)
    route = F.when(t.isin([WIRE_PREFIX + m for m in MSG_TYPES]), known).otherwise(F.lit("unrouted"))
    return df.withColumn("route", route)


def parse_objectives(df: DataFrame, col: str = "msg") -> DataFrame:
    """CTL5: missing lists become []."""
    p = F.from_json(F.col(col), OBJECTIVES_SCHEMA)
    empty = F.array().cast("array<string>")
    return df.withColumns({"objs_layer1": F.coalesce(p["objs_layer1"], empty),
                           "objs_layer2": F.coalesce(p["objs_layer2"], empty)})


def explode_updates(df: DataFrame, col: str = "msg", keep: list[str] | None = None) -> DataFrame:
    """CTL6: one row per requested refresh (FEATURES / TRAIN / VALIDATE)."""
    p = F.from_json(F.col(col), UPDATE_SCHEMA)
    return df.select(*(keep or []), p["SENDER"].alias("sender"),
                     F.posexplode(p["UPDATE"]).alias("position", "refresh"))


def dedup_messages(df: DataFrame, content_cols: list[str], order_cols: list[str]) -> DataFrame:
    """CTL7 (batch): keep the first message (by ``order_cols``) of every
    distinct content hash.  A grouped ``min`` of a struct: partial
    aggregation per key, no global sort, no per-group collection."""
    sha = F.sha2(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in content_cols]), 256)
    first = F.min(F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in df.columns
                                                              if c not in order_cols]))
    out = df.withColumn("sha", sha).groupBy("sha").agg(first.alias("_f"), F.count(F.lit(1)).alias("copies"))
    return out.select("sha", "_f.*", "copies")
