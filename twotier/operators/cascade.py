"""Two-layer cascade scoring (CAS1, CAS2, CAS3) and destination shares (AGG7).

Every decision is a column expression over two score columns, so scoring is a
narrow, codegen'd projection: no shuffle until counts are aggregated, and the
aggregation is a partial/final hash aggregate with at most 8 output keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import count_if, r6, ratio_or_zero
from ..sources.schema import ANOMALY_THRESHOLD2, BENIGN_THRESHOLD

TAGS = ["L1_ANOMALY", "L2_ANOMALY", "NOT_ANOMALY2", "QUARANTINE"]


def cascade_tag(l1_pred: Column, p2: Column, t_anom: float = ANOMALY_THRESHOLD2,
                t_benign: float = BENIGN_THRESHOLD) -> Column:
    """CAS1 decision for one row.  A row that layer 1 could not score (NULL)
    has no tag; a row whose layer-2 probability is NULL or NaN passes neither
    threshold and is quarantined."""
    return (
        F.when(l1_pred.isNull(), F.lit(None).cast("string"))
        .when(l1_pred == 1, F.lit("L1_ANOMALY"))
        .when(p2.isNull() | F.isnan(p2), F.lit("QUARANTINE"))
        .when(p2 >= F.lit(t_anom), F.lit("L2_ANOMALY"))
        .when(F.lit(1.0) - p2 >= F.lit(t_benign), F.lit("NOT_ANOMALY2"))
        .otherwise(F.lit("QUARANTINE"))
    )


def cascade_online(df: DataFrame, l1_pred: str = "l1_pred", p2: str = "p2",
                   t_anom: float = ANOMALY_THRESHOLD2, t_benign: float = BENIGN_THRESHOLD) -> DataFrame:
    """CAS1: adds ``tag``.  L2 probabilities of L1 positives are ignored."""
    return df.withColumn("tag", cascade_tag(F.col(l1_pred), F.col(p2), t_anom, t_benign))


def cascade_offline(df: DataFrame, l1_pred: str = "l1_pred", l2_pred: str = "l2_pred") -> DataFrame:
    """CAS2: final 0/1 = 1 if layer 1 fires, else the layer-2 hard prediction."""
    return df.withColumn(
        "pred", F.when(F.col(l1_pred).isNull(), F.lit(None).cast("int")).when(F.col(l1_pred) == 1, F.lit(1))
        .otherwise(F.col(l2_pred).cast("int")))


def outcome_flags(tag: Column, actual: Column) -> dict[str, Column]:
    """Per-row layer/outcome indicators of CAS3.

    Layer 1 counts every row; layer 2 counts rows layer 1 passed that were not
    quarantined; a NULL actual or tag is counted nowhere.
    """
    a1, a0 = actual == 1, actual == 0
    l1_pos = tag == "L1_ANOMALY"
    l1_neg = tag != "L1_ANOMALY"
    return {
        "l1_tp": l1_pos & a1, "l1_fp": l1_pos & a0,
        "l1_tn": l1_neg & a0, "l1_fn": l1_neg & a1,
        "l2_tp": (tag == "L2_ANOMALY") & a1, "l2_fp": (tag == "L2_ANOMALY") & a0,
        "l2_tn": (tag == "NOT_ANOMALY2") & a0, "l2_fn": (tag == "NOT_ANOMALY2") & a1,
    }


def outcome_counts_wide(df: DataFrame, tag: str = "tag", actual: str = "y_any",
                        by: list[str] | None = None) -> DataFrame:
    """CAS3 as one aggregate: l1_tp .. l2_fn (+ quarantined, total)."""
    flags = outcome_flags(F.col(tag), F.col(actual))
    aggs = [count_if(c).alias(k) for k, c in flags.items()]
    aggs += [count_if(F.col(tag) == "QUARANTINE").alias("quarantined"),
             F.count(F.lit(1)).alias("total")]
    g = df.groupBy(*(by or []))
    return g.agg(*aggs)


def outcome_counts_long(df: DataFrame, tag: str = "tag", actual: str = "y_any",
                        by: list[str] | None = None) -> DataFrame:
    """CAS3 as (layer, outcome, n) rows."""
    wide = outcome_counts_wide(df, tag, actual, by)
    keys = [f"l{layer}_{o}" for layer in (1, 2) for o in ("tp", "fp", "tn", "fn")]
    stack = "stack(8, " + ", ".join(
        f"{k[1]}, '{k[3:]}', {k}" for k in keys) + ") as (layer, outcome, n)"
    return wide.select(*(by or []), F.expr(stack)).withColumn("layer", F.col("layer").cast("int"))


def destination_ratios(df: DataFrame, tag: str = "tag", by: list[str] | None = None) -> DataFrame:
    """AGG7: share of all samples per destination (intended meaning)."""
    t = F.col(tag)
    total = F.count(F.lit(1))
    return df.groupBy(*(by or [])).agg(
        total.alias("total"),
        r6(ratio_or_zero(count_if(t == "NOT_ANOMALY2"), total)).alias("normal_ratio"),
        r6(ratio_or_zero(count_if(t == "QUARANTINE"), total)).alias("quarantined_ratio"),
        r6(ratio_or_zero(count_if(t == "L1_ANOMALY"), total)).alias("l1_anomaly_ratio"),
        r6(ratio_or_zero(count_if(t == "L2_ANOMALY"), total)).alias("l2_anomaly_ratio"),
    )


def rule_scores(df: DataFrame, l1_cut: float = 0.88) -> DataFrame:
    """Fixture scores -> model-shaped columns: l1_pred, p2, l2_pred."""
    return df.withColumns({
        "l1_pred": (F.col("s1") >= F.lit(l1_cut)).cast("int"),
        "p2": F.col("s2"),
        "l2_pred": (F.col("s2") >= F.lit(0.5)).cast("int"),
    })
