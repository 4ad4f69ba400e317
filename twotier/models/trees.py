"""Iterative learners on Spark ML (CLF1, CLF4, CLF7, CLF8, CLF10, CLF13, FEA8)
and model persistence (MOD1).

Parameter mapping from the reference's library names:
- ``max_depth`` is clamped to 30 (Spark's limit); ``None`` -> 30.
- ``min_samples_split`` has no Spark equivalent: it is folded into
  ``minInstancesPerNode = max(min_samples_leaf, ceil(min_samples_split / 2))``.
- criterion ``log_loss`` is ``entropy``; ``max_features`` None -> ``all``,
  ``auto`` -> ``sqrt``.
Extra trees are in ``extra_trees``.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import held

SPARK_MAX_DEPTH = 30


def forest_params(params: dict) -> dict:
    depth = params.get("max_depth")
    depth = SPARK_MAX_DEPTH if depth is None else min(int(depth), SPARK_MAX_DEPTH)
    leaf = int(params.get("min_samples_leaf", 1))
    split = int(params.get("min_samples_split", 2))
    crit = params.get("criterion", "gini")
    crit = "entropy" if crit == "log_loss" else crit
    mf = params.get("max_features", "sqrt")
    mf = {None: "all", "auto": "sqrt"}.get(mf, mf)
    if isinstance(mf, (int, float)) and not isinstance(mf, bool):
        mf = str(mf)
    out = {"maxDepth": depth, "minInstancesPerNode": max(leaf, math.ceil(split / 2)),
           "impurity": crit, "featureSubsetStrategy": mf}
    if "n_estimators" in params:
        out["numTrees"] = int(params["n_estimators"])
    return out


def make_classifier(kind: str, params: dict | None = None, seed: int = 42, features: str = "features",
                    label: str = "label_i", n_features: int | None = None):
    params = params or {}
    common = {"featuresCol": features, "labelCol": label}
    if kind == "rf":
        p = forest_params(params)
        return RandomForestClassifier(numTrees=p.pop("numTrees", 50), seed=seed, **p, **common)
    if kind == "dt":
        p = forest_params(params)
        p.pop("featureSubsetStrategy", None)
        p.pop("numTrees", None)
        return DecisionTreeClassifier(seed=seed, **p, **common)
    if kind == "gbt":
        return GBTClassifier(stepSize=params.get("learning_rate", 0.1),
                             maxIter=int(params.get("max_iter", 50)),
                             maxDepth=min(int(params.get("max_depth", 5)), SPARK_MAX_DEPTH),
                             minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
                             maxBins=255, seed=seed, **common)
    if kind == "mlp":
        hidden = params.get("hidden", [16])
        return MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], maxIter=params.get("max_iter", 100),
                                              seed=seed, **common)
    if kind == "logreg":
        return LogisticRegression(maxIter=params.get("max_iter", 100), regParam=params.get("reg", 0.0),
                                  **common)
    raise ValueError(kind)


def fit_model(train: DataFrame, kind: str, params: dict | None = None, features: str = "features",
              y: str = "y", n_features: int | None = None) -> PipelineModel:
    """The fitted learner; its rows (features and class) are held while it passes over them."""
    with held(learner_rows(train, features, y)) as data:
        return fit_held(data, kind, params, features, n_features)


def learner_rows(train: DataFrame, features: str = "features", y: str = "y") -> DataFrame:
    """What a learner reads: its features, and the class as ``label_i``."""
    return train.select(features, F.col(y).cast("double").alias("label_i"))


def fit_held(data: DataFrame, kind: str, params: dict | None = None, features: str = "features",
             n_features: int | None = None) -> PipelineModel:
    """The learner fitted on ``learner_rows`` that the caller holds, so that several fits share one copy."""
    clf = make_classifier(kind, params, features=features, n_features=n_features)
    if kind == "rf":
        clf.setCacheNodeIds(node_ids_fit(data, features, clf.getNumTrees()))
    return Pipeline(stages=[clf]).fit(data)


def node_ids_fit(data: DataFrame, features: str, trees: int) -> bool:
    """Whether each row's node in every tree can stay in memory beside the forest's own bagged rows.
    With them a pass does not walk all rows down from the roots; the model is the same.  On disk they
    would cost more than the walk."""
    first = data.select(features).first()
    if first is None or first[0] is None:
        return False
    # bytes of a row in the JVM: its objects and bins, its count in each tree, its nodes before and after a level
    row = 150 + 4 * first[0].size + 3 * 4 * trees
    return data.count() * row <= free_memory(data.sparkSession) // 2


def free_memory(spark: SparkSession) -> int:
    """Bytes that the executors could still hold in memory."""
    free, status = 0, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
    while status.hasNext():
        free += status.next()._2()
    return free


def feature_importance(model: PipelineModel, names: list[str], k: int | None = None) -> list[tuple[str, float]]:
    """FEA8: forest importances, descending (k = top-k)."""
    imp = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(names, imp), key=lambda t: (-t[1], t[0]))
    return ranked[:k] if k else ranked


def save_model(model: PipelineModel, path: str) -> None:
    """MOD1: versioned save (overwrite the version folder)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
