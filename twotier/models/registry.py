"""Versioned model registry (MOD1): publish / load / swap.

A model version is a folder ``<root>/v<version>``; ``<root>/versions`` lists
the version in use.  Readers (a streaming scorer in ``foreachBatch``) resolve
the pointer on every micro-batch, so a newly published model is picked up at
the next batch boundary.  Closed-form models (min-max + Gaussian NB) are
stored as one JSON document (bounded by the feature count); a detector of
fitted ML models is a folder of its own (``Detector.save``).
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from ..operators.features import MinMax
from .detector import Detector
from .naive_bayes import GaussianNB
from .svm_trials import KernelTrials
from .trees import load_model, save_model


def _nb_to_dict(mm: MinMax, nb: GaussianNB) -> dict:
    return {
        "mins": mm.mins, "maxs": mm.maxs,
        "features": nb.features, "classes": nb.classes,
        "counts": {str(k): v for k, v in nb.counts.items()},
        "means": {str(k): v for k, v in nb.means.items()},
        "variances": {str(k): v for k, v in nb.variances.items()},
        "max_var": nb.max_var, "var_smoothing": nb.var_smoothing,
    }


def _nb_from_dict(d: dict) -> tuple[MinMax, GaussianNB]:
    mm = MinMax(d["mins"], d["maxs"])
    nb = GaussianNB(d["features"], [int(c) for c in d["classes"]],
                    {int(k): v for k, v in d["counts"].items()},
                    {int(k): v for k, v in d["means"].items()},
                    {int(k): v for k, v in d["variances"].items()},
                    d["max_var"], d["var_smoothing"])
    return mm, nb


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _write_text(self, path: str, text: str) -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def _read_text(self, path: str) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(path).collect())

    def publish_layers(self, version: int, layers: dict[str, tuple[MinMax, GaussianNB]]) -> None:
        doc = json.dumps({name: _nb_to_dict(mm, nb) for name, (mm, nb) in layers.items()})
        self._write_text(f"{self.root}/v{version}", doc)
        self._announce(version)

    def publish_detector(self, version: int, detector: Detector) -> None:
        detector.save(self.spark, f"{self.root}/v{version}")
        self._announce(version)

    def publish_trials(self, version: int, forest: PipelineModel, svm: KernelTrials) -> None:
        """A fitted layer-1 pipeline and a fitted layer-2 kernel trial as one version."""
        save_model(forest, f"{self.root}/v{version}/forest")
        self._write_text(f"{self.root}/v{version}/svm", svm.to_json())
        self._announce(version)

    def _announce(self, version: int) -> None:
        """Appends the number of a version whose folder is complete: nothing is
        ever overwritten, so a reader always finds a version."""
        (self.spark.createDataFrame([(str(version),)], "value string").coalesce(1)
         .write.mode("append").text(f"{self.root}/versions"))

    def current_version(self) -> int:
        """The highest complete version."""
        return self.spark.read.text(f"{self.root}/versions").selectExpr("max(int(value)) as v").first()["v"]

    def load_layers(self, version: int | None = None) -> tuple[int, dict[str, tuple[MinMax, GaussianNB]]]:
        v = self.current_version() if version is None else version
        doc = json.loads(self._read_text(f"{self.root}/v{v}"))
        return v, {name: _nb_from_dict(d) for name, d in doc.items()}

    def load_detector(self, version: int | None = None) -> tuple[int, Detector]:
        v = self.current_version() if version is None else version
        return v, Detector.load(self.spark, f"{self.root}/v{v}")

    def load_trials(self, version: int | None = None) -> tuple[int, PipelineModel, KernelTrials]:
        v = self.current_version() if version is None else version
        return v, load_model(f"{self.root}/v{v}/forest"), KernelTrials.from_json(self._read_text(f"{self.root}/v{v}/svm"))
