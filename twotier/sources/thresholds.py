"""Alert thresholds per layer and metric (14 rows, broadcast-safe)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Alert thresholds for layer 1 and layer 2, and the order in
# which metrics are read from a snapshot message.
# ---------------------------------------------------------------------------
THRESHOLDS = {
    1: {"accuracy": 0.85, "precision": 0.8, "fscore": 0.7, "tpr": 0.8, "fpr": 0.1,
        "tnr": 0.9, "fnr": 0.2},
    2: {"accuracy": 0.75, "precision": 0.88, "fscore": 0.65, "tpr": 0.82, "fpr": 0.12,
        "tnr": 0.87, "fnr": 0.25},
}
METRIC_ORDER = ["accuracy", "precision", "fscore", "tpr", "fpr", "tnr", "fnr"]
MSG_TYPES = ["MODEL_UPDATE_MSG", "MULTIPLE_UPDATE_MSG", "METRICS_SNAPSHOT_MSG",
             "OBJECTIVES_MSG", "TUNING_END_MSG"]
WIRE_PREFIX = "msg_type."
# ---------------------------------------------------------------------------

LOWER_IS_BETTER = {"fpr", "fnr"}


def thresholds_frame(spark: SparkSession) -> DataFrame:
    rows = [(layer, m, i, float(v), m in LOWER_IS_BETTER)
            for layer, d in THRESHOLDS.items() for i, m in enumerate(METRIC_ORDER) for v in [d[m]]]
    return spark.createDataFrame(
        rows, "layer int, metric string, ordinal int, threshold double, lower_is_better boolean")


def thresholds_values_sql() -> str:
    vals = ", ".join(f"({layer}, '{m}', {i}, cast({THRESHOLDS[layer][m]!r} as double), "
                     f"{str(m in LOWER_IS_BETTER).lower()})"
                     for layer in THRESHOLDS for i, m in enumerate(METRIC_ORDER))
    return f"(values {vals}) as th(layer, metric, ordinal, threshold, lower_is_better)"
