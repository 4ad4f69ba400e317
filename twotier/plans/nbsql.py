"""Oracle SQL generators for the feature-prep and naive-Bayes queries.

They restate in DuckDB SQL what ``operators.features`` and
``models.naive_bayes`` compute in Spark: min-max constants from the training
rows, per-class mean and population variance, epsilon from the largest
feature variance, and a stable softmax over the joint log-likelihoods.
"""

from __future__ import annotations

import math

LOG_2PI_SQL = f"ln({2.0 * math.pi!r})"

TRAIN = "md5('42:' || flow_id) >= '4ccc'"
TEST = "md5('42:' || flow_id) < '4ccc'"


def minmax_cte(name: str, src: str, cols: list[str]) -> str:
    aggs = ", ".join(f"min({c}) as mn_{c}, max({c}) as mx_{c}" for c in cols)
    return f"{name} as (select {aggs} from {src})"


def scaled_cols(mm: str, cols: list[str]) -> str:
    return ", ".join(
        f"({c} - {mm}.mn_{c}) / (case when {mm}.mx_{c} - {mm}.mn_{c} = 0 then 1e0 "
        f"else {mm}.mx_{c} - {mm}.mn_{c} end) as {c}" for c in cols)


def nb_ctes(prefix: str, train_src: str, y: str, cols: list[str], var_smoothing: str = "1e-9") -> str:
    """CTEs ``{prefix}_mm`` (scaler), ``{prefix}_tr`` (scaled train),
    ``{prefix}_p`` (one wide row of NB parameters)."""
    per = ", ".join(f"avg({c}) as m_{c}, var_pop({c}) as v_{c}" for c in cols)
    gv = " union all ".join(f"select var_pop({c}) as v from {prefix}_tr" for c in cols)
    wide = []
    for k in (0, 1):
        wide.append(f"max(case when {y} = {k} then n end) as n{k}")
        for c in cols:
            wide.append(f"max(case when {y} = {k} then m_{c} end) as m{k}_{c}")
            wide.append(f"max(case when {y} = {k} then v_{c} end) as v{k}_{c}")
    return f""",
{minmax_cte(prefix + '_mm', train_src, cols)},
{prefix}_tr as (select {y}, {scaled_cols(prefix + '_mm', cols)} from {train_src}, {prefix}_mm),
{prefix}_st as (select {y}, count(*) as n, {per} from {prefix}_tr group by {y}),
{prefix}_p as (select {", ".join(wide)},
               {var_smoothing} * (select max(v) from ({gv}) g) as eps,
               (select max(v) from ({gv}) g) as maxv from {prefix}_st)"""


def jll_sql(prefix: str, k: int, cols: list[str], x: str = "x") -> str:
    p = f"{prefix}_p"
    const = f"ln(cast({p}.n{k} as double) / ({p}.n0 + {p}.n1))"
    logs = " + ".join(f"({LOG_2PI_SQL} + ln({p}.v{k}_{c} + {p}.eps))" for c in cols)
    quad = " + ".join(
        f"({x}.{c} - {p}.m{k}_{c}) * ({x}.{c} - {p}.m{k}_{c}) / (2e0 * ({p}.v{k}_{c} + {p}.eps))"
        for c in cols)
    return f"({const} - 5e-1 * ({logs}) - ({quad}))"


def proba_sql(j0: str = "j0", j1: str = "j1") -> str:
    m = f"greatest({j0}, {j1})"
    return f"exp({j1} - {m}) / (exp({j0} - {m}) + exp({j1} - {m}))"
