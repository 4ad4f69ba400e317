"""k nearest neighbours over a bounded sample of labelled rows (CLF11).

The sample (the training rows of smallest hash, ``MAX_SAMPLE`` at most) goes along as one
matrix; a task measures the distances of its rows to each of them in numpy, ``ROWS`` rows at a
time, and keeps the k nearest.  No two large tables are compared and nothing shuffles.  The vote is exact for the
sample, which is the documented bound of this learner.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash

# the tasks' functions go to the executors by value: a cluster needs no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_SAMPLE = 1_000
ROWS = 2_000


def sample(train: DataFrame, inputs: dict[str, Column], y: str, size: int, key: str = "flow_id", seed: int = 42) -> list[tuple[list[float], int]]:
    """The scaled inputs and classes of the ``size`` labelled rows of smallest hash, in hash order."""
    if size > MAX_SAMPLE:
        raise ValueError(f"a sample of more than {MAX_SAMPLE} rows is no literal")
    rows = (train.where(F.col(y).isNotNull()).select(seeded_hash(key, seed).alias("_h"), F.col(y).alias("_y"),
                                                     *[c.alias(n) for n, c in inputs.items()]).orderBy("_h").limit(size).collect())
    return [([float(r[n]) for n in inputs], int(r["_y"])) for r in rows]


def vote_share(inputs: list[Column], points: list[tuple[list[float], int]], k: int = 5) -> Column:
    """The share of class 1 among the k nearest points (nearer hash order first on ties; a distance
    that is not a number, as of a missing value, is the farthest)."""
    if not points:
        raise ValueError("no labelled rows to vote")
    at, classes = np.array([x for x, _ in points], dtype=float), np.array([y for _, y in points], dtype=float)
    k = min(k, len(points))

    def share(*columns: pa.Array) -> pa.Array:
        rows = [c.to_numpy(zero_copy_only=False).astype(float) for c in columns]
        out = np.empty(len(rows[0]))
        for start in range(0, len(out), ROWS):
            part = slice(start, start + ROWS)
            distance = np.zeros((len(out[part]), len(at)))
            for j, x in enumerate(rows):
                distance += (x[part, None] - at[:, j]) ** 2
            distance[np.isnan(distance)] = np.inf
            row, votes = np.arange(len(distance)), np.zeros(len(distance))
            left = np.isfinite(distance).sum(axis=1) >= k
            for _ in range(k):
                nearest = distance.argmin(axis=1)  # the first of equals
                votes += classes[nearest]
                distance[row, nearest] = np.inf
            if not left.all():
                votes[~left] = _by_sorting([x[part][~left] for x in rows], at, classes, k)
            out[part] = votes / k
        return pa.array(out)

    return F.arrow_udf(share, "double")(*[c.cast("double") for c in inputs])


def _by_sorting(rows: list[np.ndarray], at: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    """The votes of rows with fewer than k finite distances: those come first, then infinite ones, then the others."""
    distance = np.zeros((len(rows[0]), len(at)))
    for j, x in enumerate(rows):
        distance += (x[:, None] - at[:, j]) ** 2
    return classes[np.argsort(distance, axis=1, kind="stable")[:, :k]].sum(axis=1)
