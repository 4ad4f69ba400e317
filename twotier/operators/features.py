"""Feature preparation (FEA1-FEA7, AGG13).

Fitting is one aggregate pass over the training rows; the fitted state
(min/max, means, categories, correlations) is bounded by the number of
features and categories, so it is collected as small metadata and applied as
literal column expressions: scoring stays a narrow codegen'd projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import r6
from ..sources import taxonomy as tx


# --------------------------------------------------------------------------- min-max
@dataclass
class MinMax:
    mins: dict[str, float]
    maxs: dict[str, float]

    def expr(self, c: str) -> Column:
        lo, hi = self.mins[c], self.maxs[c]
        rng = (hi - lo) if (hi is not None and lo is not None and hi != lo) else 1.0
        return (F.col(c) - F.lit(lo if lo is not None else 0.0)) / F.lit(rng)

    def apply(self, df: DataFrame, keep: list[str] | None = None, suffix: str = "") -> DataFrame:
        """FEA1 apply: (x - min) / (max - min) with train constants; values
        outside [0, 1] are kept; a constant column maps to x - min."""
        cols = [self.expr(c).alias(c + suffix) for c in self.mins]
        if keep is None:
            other = [c for c in df.columns if c not in self.mins or suffix]
            return df.select(*other, *cols)
        return df.select(*keep, *cols)


def fit_minmax(df: DataFrame, cols: list[str]) -> MinMax:
    """FEA1 fit: one aggregate for every column."""
    row = df.agg(*[F.min(c).alias(f"mn_{c}") for c in cols],
                 *[F.max(c).alias(f"mx_{c}") for c in cols]).first()
    return MinMax({c: row[f"mn_{c}"] for c in cols}, {c: row[f"mx_{c}"] for c in cols})


def minmax_params(df: DataFrame, cols: list[str]) -> DataFrame:
    """FEA1 fit as a (feature, min, max) frame (stays distributed)."""
    wide = df.agg(*[F.min(c).alias(f"mn_{c}") for c in cols],
                  *[F.max(c).alias(f"mx_{c}") for c in cols])
    stack = "stack({n}, {parts}) as (feature, min, max)".format(
        n=len(cols), parts=", ".join(f"'{c}', mn_{c}, mx_{c}" for c in cols))
    return wide.select(F.expr(stack))


# --------------------------------------------------------------------------- one-hot
@dataclass
class OneHot:
    categories: dict[str, list[str]] = field(default_factory=dict)

    def columns(self) -> list[Column]:
        out = []
        for c, values in self.categories.items():
            for v in values:
                out.append(F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}"))
        return out

    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.categories.items() for v in vs]

    def apply(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """FEA2 apply: one 0/1 column per train category, sorted; an unseen
        value gets all zeros."""
        return df.select(*keep, *self.columns())


MAX_CATEGORIES = 10_000


def fit_onehot(df: DataFrame, cols: list[str]) -> OneHot:
    """FEA2 fit: sorted distinct categories of every column in ONE aggregate of
    (column, value) pairs, de-duplicated in the tasks.  At most ``MAX_CATEGORIES``
    pairs reach the driver; more raise: such a field is no category."""
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols]))
    rows = df.select(pair.alias("p")).select("p.c", "p.v").where("v is not null").distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories in {cols}")
    return OneHot({c: sorted(r["v"] for r in rows if r["c"] == c) for c in cols})


# --------------------------------------------------------------------------- z-score
@dataclass
class ZScore:
    means: dict[str, float]
    stds: dict[str, float]

    def expr(self, c: str) -> Column:
        s = self.stds[c]
        s = s if s and not math.isnan(s) and s != 0 else 1.0
        return (F.col(c) - F.lit(self.means[c])) / F.lit(s)

    def apply(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(*keep, *[self.expr(c).alias(c) for c in self.means])


def fit_zscore(df: DataFrame, cols: list[str]) -> ZScore:
    """FEA5: population standard deviation (as the reference library), a
    zero deviation leaves x - mean."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return ZScore({c: row[f"m_{c}"] for c in cols}, {c: row[f"s_{c}"] for c in cols})


# --------------------------------------------------------------------------- covariance
def covariance_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Population covariance of every feature pair (i <= j) in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    stack = "stack({n}, {parts}) as (feature_a, feature_b, cov)".format(
        n=len(pairs), parts=", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs)))
    return wide.select(F.expr(stack)).withColumn("cov", r6("cov"))


# --------------------------------------------------------------------------- correlation
def pearson(x: Column, y: Column) -> Column:
    """ANSI-safe Pearson r: NULL for a constant column (``corr`` would raise)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def feature_target_corr(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """AGG13: r of every feature against a binary target, one pass."""
    yc = F.col(y).cast("double")
    wide = df.agg(*[pearson(F.col(f).cast("double"), yc).alias(f"r_{f}") for f in features])
    stack = "stack({n}, {parts}) as (feature, r)".format(
        n=len(features), parts=", ".join(f"'{f}', r_{f}" for f in features))
    return wide.select(F.expr(stack)).withColumn("r", r6("r"))


# The four tests with their thresholds on the correlation.
ICFS_TESTS = {
    # name: (population labels or None for all rows, positive labels, threshold, layer)
    "dos": (None, tx.ICFS_DOS, 0.1, 1),
    "probe": (None, tx.ICFS_PROBE, 0.1, 1),
    "u2r": (["normal", *tx.ICFS_U2R], tx.ICFS_U2R, 0.01, 2),
    "r2l": (["normal", *tx.ICFS_R2L], tx.ICFS_R2L, 0.01, 2),
}


def icfs_correlations(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """The four one-vs-rest correlation tests of FEA7 from ONE pass.

    Rows are grouped by the test whose positive labels they have (else normal
    or other: at most six groups) with count, mean and variance of every
    feature.  A correlation with a 0/1 target follows from the moments of its
    two sides: (mean1 - mean0) * sqrt(p * (1 - p)) / stddev.  NULL for a
    constant feature or an empty side.
    """
    from ..models.naive_bayes import combine_moments
    kind = F.when(F.col(label) == "normal", "normal").otherwise("other")
    for name, (_pop, pos, _thr, _layer) in ICFS_TESTS.items():
        kind = F.when(F.col(label).isin(pos), name).otherwise(kind)
    groups = df.groupBy(kind.alias("_kind")).agg(
        *[F.count(F.col(f)).alias(f"n_{f}") for f in features],
        *[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in features],
        *[F.var_pop(F.col(f).cast("double")).alias(f"v_{f}") for f in features]).collect()
    rows = []
    for name, (pop, _pos, _thr, _layer) in ICFS_TESTS.items():
        inside = [g for g in groups if pop is None or g["_kind"] in ("normal", name)]
        for f in features:
            parts = {side: combine_moments([(g[f"n_{f}"], g[f"m_{f}"], g[f"v_{f}"]) for g in inside
                                            if (g["_kind"] == name) is side and g[f"n_{f}"]]) for side in (True, False)}
            n, _, var = combine_moments([p for p in parts.values() if p[0]])
            share = parts[True][0] / n if n else 0.0
            r = None
            if var and 0 < share < 1:
                r = (parts[True][1] - parts[False][1]) * math.sqrt(share * (1 - share) / var)
            rows.append((name, f, r))
    return df.sparkSession.createDataFrame(rows, "test string, feature string, r double")


def select_features_icfs(df: DataFrame, features: list[str], label: str = "label",
                         thresholds: dict[str, float] | None = None) -> DataFrame:
    """FEA7: per layer, features passing |r| > threshold in BOTH of its tests
    (set intersection).  Returns (layer, feature).  ``thresholds`` replaces those of some tests."""
    corr = icfs_correlations(df, features, label)
    own = {n: t for n, (_, _, t, _) in ICFS_TESTS.items()} | (thresholds or {})
    thr = F.create_map(*[x for n, t in own.items() for x in (F.lit(n), F.lit(t))])
    lay = F.create_map(*[x for n, (_, _, _, l) in ICFS_TESTS.items() for x in (F.lit(n), F.lit(l))])
    passed = corr.where(F.abs(F.col("r")) > thr[F.col("test")]).withColumn("layer", lay[F.col("test")])
    return (passed.groupBy("layer", "feature").agg(F.countDistinct("test").alias("_n"))
            .where(F.col("_n") == 2).select(F.col("layer").cast("int"), "feature"))
