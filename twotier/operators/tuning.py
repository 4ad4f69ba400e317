"""Tuning in relational form (TUN1, TUN3-TUN6, JON6).

Trials are rows: ``trial_id`` plus one column per parameter, drawn
deterministically from ``md5(seed:name:trial_id)``.  Objective values,
Pareto dominance and scenario scores are column expressions and joins over
that small, size-checked trials frame.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.rates import objective_value, r6, ratio_or_zero

MAX_TRIALS_FOR_PAIRWISE = 10_000


@dataclass(frozen=True)
class IntParam:
    low: int
    high: int
    step: int = 1


@dataclass(frozen=True)
class FloatParam:
    low: float
    high: float
    log: bool = False


@dataclass(frozen=True)
class CatParam:
    choices: tuple[str, ...]


@dataclass(frozen=True)
class When:
    """A conditional parameter: only drawn when ``parent`` equals ``value``."""
    param: object
    parent: str
    values: tuple[str, ...]


def _draw(name: str, spec, seed) -> Column:
    key = F.concat(F.lit(f"{name}:"), F.col("trial_id").cast("string"))
    u = uniform(key, seed)
    if isinstance(spec, IntParam):
        n = (spec.high - spec.low) // spec.step + 1
        return (F.lit(spec.low) + F.floor(u * F.lit(n)).cast("bigint") * F.lit(spec.step)).cast("bigint")
    if isinstance(spec, FloatParam):
        if spec.log:
            lo, hi = math.log(spec.low), math.log(spec.high)
            return F.exp(F.lit(lo) + u * F.lit(hi - lo))
        return F.lit(spec.low) + u * F.lit(spec.high - spec.low)
    if isinstance(spec, CatParam):
        arr = F.array(*[F.lit(c) for c in spec.choices])
        return F.element_at(arr, (F.floor(u * F.lit(len(spec.choices))) + 1).cast("int"))
    raise TypeError(spec)


def sample_trials(spark: SparkSession, space: dict, n: int, seed: int = 42) -> DataFrame:
    """TUN1: deterministic random search, one row per trial."""
    df = spark.range(n).select(F.col("id").alias("trial_id"))
    for name, spec in space.items():
        if isinstance(spec, When):
            draw = _draw(name, spec.param, seed)
            df = df.withColumn(name, F.when(F.col(spec.parent).isin(list(spec.values)), draw))
        else:
            df = df.withColumn(name, _draw(name, spec, seed))
    return df


def objective_columns(names: list[str], mode: str = "reference",
                      tp="tp", fp="fp", tn="tn", fn="fn") -> list[Column]:
    """TUN3: one maximised value per objective name."""
    return [r6(objective_value(n, tp, fp, tn, fn, mode)).alias(f"obj_{n}") for n in names]


def check_trial_bound(trials: DataFrame) -> int:
    n = trials.count()
    if n > MAX_TRIALS_FOR_PAIRWISE:
        raise ValueError(f"{n} trials exceed the pairwise bound {MAX_TRIALS_FOR_PAIRWISE}")
    return n


def pareto_front(trials: DataFrame, objs: list[str], key: str = "trial_id") -> DataFrame:
    """TUN4 / JON6: non-dominated trials (all objectives maximised).

    A dominance anti-join; the trials frame is size-checked (it is bounded by
    the number of trials, not by the data) and broadcast, so the theta join
    is a broadcast nested loop over at most ``MAX_TRIALS_FOR_PAIRWISE`` rows.
    """
    check_trial_bound(trials)
    other = trials.select(*[F.col(c).alias(f"_b_{c}") for c in [key, *objs]])
    ge = [F.col(f"_b_{o}") >= F.col(o) for o in objs]
    gt = [F.col(f"_b_{o}") > F.col(o) for o in objs]
    cond = ge[0]
    for c in ge[1:]:
        cond = cond & c
    any_gt = gt[0]
    for c in gt[1:]:
        any_gt = any_gt | c
    return trials.join(F.broadcast(other), cond & any_gt, "left_anti")


def pick_trial(front: DataFrame, objs: list[str], key: str = "trial_id", mode: str = "reference") -> DataFrame:
    """TUN5: sort the front by its value vector and take the first
    (ascending in ``reference`` mode = lowest first objective; descending in
    ``corrected`` mode); trial id breaks ties."""
    order = [F.col(o).asc() if mode == "reference" else F.col(o).desc() for o in objs]
    return front.orderBy(*order, F.col(key).asc()).limit(1)


def layer_rates(prefix: str) -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(f"{prefix}{c}").cast("double") for c in ("tp", "fp", "tn", "fn"))
    return {
        "rec": ratio_or_zero(tp, tp + fn),
        "prec": ratio_or_zero(tp, tp + fp),
        "fpr": ratio_or_zero(fp, fp + tn),
        "tnr": ratio_or_zero(tn, tn + fp),
        "fnr": ratio_or_zero(fn, fn + tp),
    }


def scenario_scores(df: DataFrame, beta: str | None = "beta", special: bool = False) -> DataFrame:
    """TUN6: S1..S4 and the adaptive score from both layers' confusion counts
    (columns ``l1_tp`` .. ``l2_fn``)."""
    a, b = layer_rates("l1_"), layer_rates("l2_")
    avg = {k: (a[k] + b[k]) / F.lit(2.0) for k in a}
    s1 = F.lit(0.5) * (a["rec"] + b["rec"]) + F.lit(0.5) * (a["prec"] + b["prec"])
    s2 = (a["fpr"] + b["fpr"]) / F.lit(2.0)
    s3 = avg["fpr"] + (F.lit(1.0) - avg["tnr"])
    s4 = F.lit(1.0) - (avg["prec"] + avg["fnr"])
    bcol = F.col(beta) if beta else F.lit(0.0)
    if special:
        adaptive = avg["fnr"]
    else:
        adaptive = (F.lit(0.5) * avg["rec"] - bcol * avg["fnr"]
                    - F.greatest(F.lit(0.0), avg["rec"] - F.lit(0.8)))
    return df.withColumns({"s1": r6(s1), "s2": r6(s2), "s3": r6(s3), "s4": r6(s4),
                           "adaptive": r6(adaptive)})


SCENARIO_DIRECTION = {"s1": "max", "s2": "min", "s3": "min", "s4": "min", "adaptive": "max"}


def best_per_scenario(scores: DataFrame, key: str = "trial_id") -> DataFrame:
    """Best trial per scenario in ONE aggregate: a min over (signed score,
    trial id) structs per scenario, then unpivot.  No sort, no union."""
    aggs = []
    for s, d in SCENARIO_DIRECTION.items():
        signed = F.col(s) if d == "min" else -F.col(s)
        aggs.append(F.min(F.struct(signed.alias("v"), F.col(key).alias("k"), F.col(s).alias("score")))
                    .alias(f"_b_{s}"))
    wide = scores.agg(*aggs)
    parts = ", ".join(f"'{s}', _b_{s}.k, _b_{s}.score" for s in SCENARIO_DIRECTION)
    return wide.select(F.expr(f"stack({len(SCENARIO_DIRECTION)}, {parts}) as (scenario, {key}, score)"))
