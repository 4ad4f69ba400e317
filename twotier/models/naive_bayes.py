"""Gaussian naive Bayes with variance smoothing, in closed form (CLF3).

Fit = one ``groupBy(y)`` aggregate of count / mean / population variance per
feature, plus one aggregate for the largest feature variance (epsilon =
var_smoothing * max variance).  The fitted state is ``classes x features``
numbers, collected as metadata; scoring is a literal column expression
(stable log-sum-exp), so it runs inside whole-stage codegen on batch and
streaming frames alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_2PI = math.log(2.0 * math.pi)


@dataclass
class GaussianNB:
    features: list[str]
    classes: list[int]
    counts: dict[int, int]
    means: dict[int, dict[str, float]]
    variances: dict[int, dict[str, float]]  # raw population variances
    max_var: float
    var_smoothing: float = 1e-9

    @property
    def epsilon(self) -> float:
        return self.var_smoothing * (self.max_var or 0.0)

    def with_smoothing(self, var_smoothing: float) -> "GaussianNB":
        return GaussianNB(self.features, self.classes, self.counts, self.means, self.variances,
                          self.max_var, var_smoothing)

    def joint_log_likelihood(self, c: int, inputs: dict[str, Column] | None = None) -> Column:
        total = sum(self.counts.values())
        prior = self.counts[c] / total
        eps = self.epsilon
        const = math.log(prior)
        terms = []
        for f in self.features:
            v = (self.variances[c][f] or 0.0) + eps
            const -= 0.5 * (LOG_2PI + math.log(v))
            x = inputs[f] if inputs and f in inputs else F.col(f).cast("double")
            d = x - F.lit(self.means[c][f])
            terms.append(d * d / F.lit(2.0 * v))
        expr = F.lit(const)
        for t in terms:
            expr = expr - t
        return expr

    def proba(self, positive: int = 1, inputs: dict[str, Column] | None = None) -> Column:
        """P(positive | x) via a stable softmax over the classes.  ``inputs``
        maps a feature to an expression (e.g. its scaled form)."""
        jll = {c: self.joint_log_likelihood(c, inputs) for c in self.classes}
        if positive not in jll:
            return F.lit(0.0)
        m = F.greatest(*jll.values()) if len(jll) > 1 else jll[positive]
        num = F.exp(jll[positive] - m)
        den = None
        for c in self.classes:
            e = F.exp(jll[c] - m)
            den = e if den is None else den + e
        return num / den

    def decision(self, inputs: dict[str, Column] | None = None) -> Column:
        """Binary log-odds jll(1) - jll(0) as a per-feature quadratic
        C + sum_f x_f * (b_f + a_f * x_f): the same value as the difference of
        the joint log-likelihoods, a fraction of the expression size (p > 0.5
        exactly when it is > 0)."""
        if 1 not in self.counts or 0 not in self.counts:  # single-class training data
            return F.lit(1.0 if 1 in self.counts else -1.0)
        eps = self.epsilon
        total = sum(self.counts.values())
        const = math.log(self.counts[1] / total) - math.log(self.counts[0] / total)
        expr = None
        for f in self.features:
            v0 = (self.variances[0][f] or 0.0) + eps
            v1 = (self.variances[1][f] or 0.0) + eps
            m0, m1 = self.means[0][f], self.means[1][f]
            const += -0.5 * math.log(v1) + 0.5 * math.log(v0) - m1 * m1 / (2 * v1) + m0 * m0 / (2 * v0)
            a = 1.0 / (2 * v0) - 1.0 / (2 * v1)
            b = m1 / v1 - m0 / v0
            x = inputs[f] if inputs and f in inputs else F.col(f).cast("double")
            term = x * (F.lit(b) + F.lit(a) * x)
            expr = term if expr is None else expr + term
        return F.lit(const) + expr

    def transform(self, df: DataFrame, prob_col: str = "p1", pred_col: str = "nb_pred") -> DataFrame:
        p = self.proba(1)
        return df.withColumn(prob_col, p).withColumn(pred_col, (F.col(prob_col) > F.lit(0.5)).cast("int"))


def fit_gaussian_nb(df: DataFrame, features: list[str], y: str,
                    var_smoothing: float = 1e-9) -> GaussianNB:
    """One grouped aggregate (+ one global) over the training rows."""
    per = df.groupBy(y).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in features],
        *[F.var_pop(F.col(f).cast("double")).alias(f"v_{f}") for f in features],
    ).collect()
    glob = df.agg(*[F.var_pop(F.col(f).cast("double")).alias(f) for f in features]).first()
    classes = sorted(int(r[y]) for r in per if r[y] is not None)
    counts = {int(r[y]): int(r["_n"]) for r in per if r[y] is not None}
    means = {int(r[y]): {f: r[f"m_{f}"] for f in features} for r in per if r[y] is not None}
    variances = {int(r[y]): {f: r[f"v_{f}"] for f in features} for r in per if r[y] is not None}
    max_var = max((glob[f] or 0.0) for f in features) if features else 0.0
    return GaussianNB(features, classes, counts, means, variances, max_var, var_smoothing)


def nb_params_frame(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """The fitted statistics as a (class, feature, n, mean, var) frame."""
    per = df.groupBy(y).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in features],
        *[F.var_pop(F.col(f).cast("double")).alias(f"v_{f}") for f in features])
    stack = "stack({k}, {parts}) as (feature, mean, var)".format(
        k=len(features), parts=", ".join(f"'{f}', m_{f}, v_{f}" for f in features))
    return per.select(F.col(y).alias("y"), "n", F.expr(stack))


def combine_moments(parts: list[tuple[int, float, float]]) -> tuple[int, float, float]:
    """(n, mean, population variance) of a union of groups (Chan et al.)."""
    n = sum(p[0] for p in parts)
    if n == 0:
        return 0, 0.0, 0.0
    mean = sum(p[0] * p[1] for p in parts) / n
    m2 = sum(p[0] * p[2] + p[0] * (p[1] - mean) ** 2 for p in parts)
    return n, mean, m2 / n


def moments_by_group(df: DataFrame, keys: list[str], features: list[str]) -> list:
    """One aggregate: per key group count, min, max, mean, population
    variance of every feature (bounded output: one row per key combination)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.col(f)).alias(f"n_{f}") for f in features],
        *[F.min(F.col(f).cast("double")).alias(f"mn_{f}") for f in features],
        *[F.max(F.col(f).cast("double")).alias(f"mx_{f}") for f in features],
        *[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in features],
        *[F.var_pop(F.col(f).cast("double")).alias(f"v_{f}") for f in features],
    ).collect()


def nb_from_moments(groups: list, y: str, features: list[str], var_smoothing: float = 1e-9):
    """Min-max scaler + Gaussian NB on the scaled features, derived exactly
    from per-group raw moments: scaled mean = (mean - lo) / range, scaled
    variance = variance / range^2.  NULL values have no weight; a class
    without any value of a feature takes the feature's overall moments."""
    from ..operators.features import MinMax
    mins = {f: min((g[f"mn_{f}"] for g in groups if g[f"mn_{f}"] is not None), default=0.0) for f in features}
    maxs = {f: max((g[f"mx_{f}"] for g in groups if g[f"mx_{f}"] is not None), default=0.0) for f in features}
    mm = MinMax(mins, maxs)
    rng = {f: (maxs[f] - mins[f]) if maxs[f] != mins[f] else 1.0 for f in features}
    classes = sorted({int(g[y]) for g in groups})
    counts, means, variances = {}, {}, {}
    glob_var, overall = {}, {}
    for f in features:
        overall[f] = combine_moments([(g[f"n_{f}"], g[f"m_{f}"], g[f"v_{f}"]) for g in groups if g[f"n_{f}"]])
        glob_var[f] = overall[f][2] / rng[f] ** 2
    for c in classes:
        part = [g for g in groups if int(g[y]) == c]
        counts[c] = sum(g["_n"] for g in part)
        means[c], variances[c] = {}, {}
        for f in features:
            n, m, v = combine_moments([(g[f"n_{f}"], g[f"m_{f}"], g[f"v_{f}"]) for g in part if g[f"n_{f}"]])
            if not n:
                _, m, v = overall[f]
            means[c][f] = (m - mins[f]) / rng[f]
            variances[c][f] = v / rng[f] ** 2
    nb = GaussianNB(features, classes, counts, means, variances, max(glob_var.values()), var_smoothing)
    return mm, nb
