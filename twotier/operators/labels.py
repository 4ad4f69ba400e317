"""Label taxonomy operators: class mapping, binary targets, masks, filters
(PRJ6, PRJ7, PRJ8, FLT1, FLT2, JON1, JON4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import taxonomy as tx


def map_class(df: DataFrame, source: str = "full", label_col: str = "label") -> DataFrame:
    """PRJ6 / JON1: fine label -> attack class; unlisted labels are ``normal``.

    The taxonomy has a fixed 40-row bound, so it is broadcast: no shuffle of
    the (arbitrarily large) flow side.
    """
    tax = tx.read_taxonomy(df.sparkSession, source).select(
        F.col("label").alias("_tax_label"), "attack_class")
    return (
        df.join(F.broadcast(tax), F.col(label_col) == F.col("_tax_label"), "left")
        .drop("_tax_label")
        .withColumn("attack_class", F.coalesce(F.col("attack_class"), F.lit("normal")))
    )


def class_expr(label_col: str = "label", source: str = "full"):
    """Same mapping as a CASE expression (no join at all)."""
    lists = tx.FULL if source == "full" else tx.ICFS
    label = F.col(label_col)
    expr = None
    for cls in ("dos", "probe", "u2r", "r2l"):
        cond = label.isin(lists[cls])
        expr = F.when(cond, cls) if expr is None else expr.when(cond, cls)
    return expr.otherwise("normal")


def binary_targets(df: DataFrame, label_col: str = "label") -> DataFrame:
    """PRJ7: y_l1 (dos+probe), y_l2 (u2r+r2l), y_any (label <> 'normal'),
    plus one-vs-rest per class."""
    label = F.col(label_col)
    out = df.withColumns({
        "y_l1": label.isin(tx.L1_LABELS).cast("int"),
        "y_l2": label.isin(tx.L2_LABELS).cast("int"),
        "y_any": (label != "normal").cast("int"),
    })
    for cls in ("dos", "probe", "r2l", "u2r"):
        out = out.withColumn(f"y_{cls}", label.isin(tx.FULL[cls]).cast("int"))
    return out


def mask_classes(df: DataFrame, classes: list[str], label_col: str = "label") -> DataFrame:
    """PRJ8: relabel every label of the given classes as ``normal``."""
    labels = [l for c in classes for l in tx.FULL[c]]
    return df.withColumn(
        label_col, F.when(F.col(label_col).isin(labels), F.lit("normal")).otherwise(F.col(label_col)))


def filter_labels(df: DataFrame, labels: list[str], label_col: str = "label") -> DataFrame:
    """FLT1 / JON4: keep rows whose label is in the list (pushed as IN filter)."""
    return df.where(F.col(label_col).isin(labels))


def layer2_population(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Layer-2 training population: normal + u2r + r2l."""
    return filter_labels(df, ["normal", *tx.U2R, *tx.R2L], label_col)


def remove_classes(df: DataFrame, classes: list[str], label_col: str = "label") -> DataFrame:
    """FLT2: drop whole classes from the training data."""
    labels = [l for c in classes for l in tx.FULL[c]]
    return df.where(~F.col(label_col).isin(labels))


FAILURE_SCENARIOS = {"f1": ["probe"], "f2": ["r2l"], "f3": ["u2r"], "f23": ["u2r", "r2l"]}
