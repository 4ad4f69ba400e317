"""Deterministic splitting and sampling (SPL1-SPL4).

All randomness is ``md5(seed:key)``: reproducible across engines, partition
layouts and task retries.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash
from ..functions.scan import first_k_flag, hash_histogram, kth_hash_by_group
from . import labels as lb


def _hash(df: DataFrame, key: str, seed) -> DataFrame:
    return df.withColumn("_h", seeded_hash(key, seed))


def stratified_split(df: DataFrame, by: str = "attack_class", key: str = "flow_id",
                     frac: float = 0.3, seed: int = 42, out: str = "split") -> DataFrame:
    """SPL1: inside every class, the floor(frac * n) rows with the smallest
    ``md5(seed:key)`` go to ``valid``, the rest to ``train``.

    Exact, with no window over a whole class (which would put the largest
    class in one task): a bounded (class, hash-prefix) histogram locates each
    class's cut, only the edge buckets are ranked, and the split itself is a
    narrow projection against per-class literal cut hashes.  Classes are few
    (bounded by the taxonomy); see ``functions.scan.kth_hash_by_group``.
    """
    x = _hash(df, key, seed)
    kth = kth_hash_by_group(x, by, "_h", lambda n: math.floor(frac * n))
    flag = first_k_flag("_h", by, kth)
    return x.withColumn(out, F.when(flag == 1, F.lit("valid")).otherwise(F.lit("train"))).drop("_h")


def hash_split(df: DataFrame, key: str = "flow_id", cut: str = "4ccc", seed: int = 42,
               out: str = "split") -> DataFrame:
    """SPL2 (scale mode): ``md5(seed:key) < cut`` is the test side (~30 % for
    '4ccc').  A pure projection: no shuffle, no window."""
    return df.withColumn(
        out, F.when(seeded_hash(key, seed) < F.lit(cut), F.lit("test")).otherwise(F.lit("train")))


def random_split(df: DataFrame, frac: float = 0.2, key: str = "flow_id", seed: int = 42,
                 out: str = "split") -> DataFrame:
    """SPL2: unstratified split with a uniform draw from the key hash."""
    from ..functions.hashing import uniform
    return df.withColumn(
        out, F.when(uniform(key, seed) < F.lit(frac), F.lit("test")).otherwise(F.lit("train")))


def undersample(df: DataFrame, y: str, key: str = "flow_id", seed: int = 42) -> DataFrame:
    """SPL3: keep every minority row and the ``n_minority`` majority rows with
    the smallest ``md5(seed:key)`` (k per class = smallest class size), via the
    same bounded histogram cut as ``stratified_split``."""
    x = _hash(df, key, seed)
    hist = hash_histogram(x, y, "_h")
    m = min((sum(c for _, c in b) for b in hist.values()), default=0)
    kth = kth_hash_by_group(x, y, "_h", lambda n: min(n, m), hist=hist)
    return x.where(first_k_flag("_h", y, kth) == 1).drop("_h")


def failure_scenario(df: DataFrame, name: str, by: str = "attack_class", key: str = "flow_id",
                     frac: float = 0.3, seed: int = 42) -> DataFrame:
    """SPL4: remove whole classes from the data, then split (F1 probe, F2 r2l,
    F3 u2r, F23 u2r+r2l)."""
    return stratified_split(lb.remove_classes(df, lb.FAILURE_SCENARIOS[name]), by, key, frac, seed)
