"""Novelty detection re-aimed (CLF12): squared standardized distance from the
training statistics (diagonal Mahalanobis), cut at an exact train quantile.

Fit = one aggregate (mean, population std per feature) + an exact k-th
smallest selection over the training scores (bucketed, no global sort).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import kth_smallest_value


@dataclass
class Novelty:
    means: dict[str, float]
    stds: dict[str, float]
    cut: float | None

    def score(self, inputs: dict[str, Column]) -> Column:
        expr = None
        for f, x in inputs.items():
            s = self.stds[f]
            s = s if s and not math.isnan(s) and s != 0 else 1.0
            z = (x - F.lit(self.means[f])) / F.lit(s)
            t = z * z
            expr = t if expr is None else expr + t
        return expr

    def transform(self, df: DataFrame, inputs: dict[str, Column], keep: list[str]) -> DataFrame:
        sc = self.score(inputs)
        return df.select(*keep, sc.alias("score")).withColumn(
            "novel", (F.col("score") > F.lit(self.cut)).cast("int"))


def fit_novelty(train: DataFrame, inputs: dict[str, Column], quantile: float = 0.95) -> Novelty:
    x = train.select(*[c.alias(f) for f, c in inputs.items()])
    row = x.agg(*[F.avg(f).alias(f"m_{f}") for f in inputs],
                *[F.stddev_pop(f).alias(f"s_{f}") for f in inputs],
                F.count(F.lit(1)).alias("_n")).first()
    model = Novelty({f: row[f"m_{f}"] for f in inputs}, {f: row[f"s_{f}"] for f in inputs}, None)
    n = int(row["_n"])
    k = math.ceil(quantile * n)
    scores = x.select(model.score({f: F.col(f) for f in inputs}).alias("score"))
    model.cut = kth_smallest_value(scores, "score", k)
    return model
