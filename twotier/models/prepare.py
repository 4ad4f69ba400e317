"""Per-layer feature preparation as a Spark ML pipeline (FEA3, FEA4, FEA6).

select -> min-max (train constants, expressions) -> one-hot (StringIndexerModel
alphabetAsc + keep, OneHotEncoder dropLast: an unseen category is the zero
vector) -> VectorAssembler -> optional centred PCA.

PCA: ``pyspark.ml.feature.PCA`` fits the covariance with a distributed
aggregation; only the d x d matrix (bounded by the feature count) reaches the
driver.  Spark does not centre on transform, so the projection here is done
on centred inputs, keeps the smallest k reaching the variance target, and
fixes each component's sign so its largest-magnitude loading is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, PCA, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import MinMax
from ..session import held


def fit_prepare(train: DataFrame, numeric: list[str], categorical: list[str],
                out: str = "features") -> tuple[MinMax, PipelineModel]:
    """FEA6 fit: min-max constants + a fitted encoding/assembly pipeline.  One aggregate gives the
    ranges and the categories (the encoder takes its sizes from them, without a pass)."""
    found = train.agg(*[f(c).alias(f"{n}_{c}") for n, f in (("mn", F.min), ("mx", F.max)) for c in numeric],
                      *[F.collect_set(F.col(c).cast("string")).alias(f"v_{c}") for c in categorical]).first()
    mm = MinMax({c: found[f"mn_{c}"] for c in numeric}, {c: found[f"mx_{c}"] for c in numeric})
    stages = []
    enc_cols = []
    for c in categorical:
        # in StringIndexer's order alphabetAsc
        stages.append(StringIndexerModel.from_labels(sorted(found[f"v_{c}"]), inputCol=c, outputCol=f"_{c}_idx", handleInvalid="keep"))
        # the indexer's extra "unknown" slot is the last one, which dropLast
        # removes: an unseen category encodes as the zero vector
        stages.append(OneHotEncoder(inputCol=f"_{c}_idx", outputCol=f"_{c}_oh", dropLast=True))
        enc_cols.append(f"_{c}_oh")
    stages.append(VectorAssembler(inputCols=[f"_s_{c}" for c in numeric] + enc_cols, outputCol=out,
                                  handleInvalid="keep"))
    return mm, Pipeline(stages=stages).fit(scale(train.select(*numeric, *categorical), mm))


def scale(df: DataFrame, mm: MinMax) -> DataFrame:
    return df.withColumns({f"_s_{c}": mm.expr(c) for c in mm.mins})


def apply_prepare(df: DataFrame, mm: MinMax, model: PipelineModel) -> DataFrame:
    """FEA6 apply (works on batch and streaming frames)."""
    out = model.transform(scale(df, mm))
    drop = [c for c in out.columns if c.startswith("_")]
    return out.drop(*drop)


@dataclass
class CentredPCA:
    mean: np.ndarray
    model: object          # fitted PCAModel with k = d
    signs: np.ndarray      # +1 / -1 per component (largest loading positive)
    k: int                 # components kept
    explained: np.ndarray  # ratio per kept component
    components: np.ndarray  # d x k, sign-fixed (for inspection and tests)

    def transform(self, df: DataFrame, vec_col: str, keep: list[str], prefix: str = "PC") -> DataFrame:
        """Centre, project (JVM matrix-vector product), fix the signs of the first k."""
        mean = F.array(*[F.lit(float(m)) for m in self.mean])
        centred = df.select(*keep, array_to_vector(
            F.zip_with(vector_to_array(F.col(vec_col)), mean, lambda a, b: a - b)).alias("_c"))
        arr = self.model.transform(centred).select(*keep, vector_to_array("_p").alias("_a"))
        return arr.select(*keep, *[(F.col("_a")[j] * F.lit(float(self.signs[j]))).alias(f"{prefix}{j + 1}") for j in range(self.k)])


def fit_pca(train: DataFrame, vec_col: str, variance: float = 0.95, k: int | None = None) -> CentredPCA:
    """FEA4: smallest k with cumulative explained variance >= ``variance``
    (or a fixed ``k``, e.g. 2 for the class scatter of FEA5)."""
    with held(train.select(vec_col)) as rows:
        return _fit_pca(rows, vec_col, variance, k)


def _fit_pca(train: DataFrame, vec_col: str, variance: float, k: int | None) -> CentredPCA:
    k_fixed = k
    d = len(train.select(vec_col).first()[0])
    arr = vector_to_array(F.col(vec_col))
    means_row = train.select(arr.alias("_a")).agg(
        F.array(*[F.avg(F.col("_a")[i]) for i in range(d)]).alias("m")).first()
    mean = np.array(means_row["m"], dtype=float)
    mean_col = F.array(*[F.lit(float(m)) for m in mean])
    centred = train.select(array_to_vector(F.zip_with(arr, mean_col, lambda a, b: a - b)).alias("_c"))
    model = PCA(k=d, inputCol="_c", outputCol="_p").fit(centred)
    ev = np.array(model.explainedVariance.toArray(), dtype=float)
    cum = np.cumsum(ev)
    k = k_fixed or int(np.searchsorted(cum, variance - 1e-12) + 1)
    k = max(1, min(k, d))
    pc = model.pc.toArray()
    signs = np.ones(d)
    for j in range(d):
        if pc[np.argmax(np.abs(pc[:, j])), j] < 0:
            signs[j] = -1.0
    comps = (pc * signs[None, :])[:, :k]
    return CentredPCA(mean, model, signs, k, ev[:k], comps)
