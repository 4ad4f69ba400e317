"""Shared SQL fragments for the DuckDB oracle texts.

Each fragment states in SQL the same rows that a Spark operator computes,
so a registered query can be checked against an independent engine.
"""

from __future__ import annotations

from ..sources import taxonomy as tx
from ..sources.flows import FLOWS_SQL


def class_case(label: str = "label", source: str = "full") -> str:
    lists = tx.FULL if source == "full" else tx.ICFS
    parts = " ".join(f"when {label} in ({tx.sql_list(lists[c])}) then '{c}'"
                     for c in ("dos", "probe", "u2r", "r2l"))
    return f"case {parts} else 'normal' end"


def targets_sql(label: str = "label") -> str:
    cols = [
        f"cast({label} in ({tx.sql_list(tx.L1_LABELS)}) as integer) as y_l1",
        f"cast({label} in ({tx.sql_list(tx.L2_LABELS)}) as integer) as y_l2",
        f"cast({label} <> 'normal' as integer) as y_any",
    ]
    for c in ("dos", "probe", "r2l", "u2r"):
        cols.append(f"cast({label} in ({tx.sql_list(tx.FULL[c])}) as integer) as y_{c}")
    return ",\n  ".join(cols)


TAG_SQL = ("case when s1 >= 88e-2 then 'L1_ANOMALY' when s2 >= 8e-1 then 'L2_ANOMALY' "
           "when 1e0 - s2 >= 6e-1 then 'NOT_ANOMALY2' else 'QUARANTINE' end")

BASE = f"""flows as (
{FLOWS_SQL}
),
lf as (
  select flows.*, {class_case()} as attack_class,
  {targets_sql()}
  from flows
),
scored as (
  select lf.*, cast(s1 >= 88e-2 as integer) as l1_pred, s2 as p2,
         cast(s2 >= 5e-1 as integer) as l2_pred,
         {TAG_SQL} as tag,
         case when s1 >= 88e-2 then 1 else cast(s2 >= 5e-1 as integer) end as pred
  from lf
)"""


def with_base(body: str, extra: str = "") -> str:
    """``with <base CTEs>[, extra] <body>``."""
    ctes = BASE + (",\n" + extra if extra else "")
    return f"with {ctes}\n{body}"


def rates_sql(tp="tp", fp="fp", tn="tn", fn="fn") -> str:
    def rz(n, d):
        return f"coalesce(cast({n} as double) / nullif(cast({d} as double), 0), 0e0)"
    return ",\n  ".join([
        f"round({rz(f'{tp}+{tn}', f'{tp}+{tn}+{fp}+{fn}')}, 6) as accuracy",
        f"round({rz(tp, f'{tp}+{fp}')}, 6) as precision",
        f"round({rz(tp, f'{tp}+{fn}')}, 6) as recall",
        f"round({rz(f'2*{tp}', f'2*{tp}+{fp}+{fn}')}, 6) as f1",
        f"round({rz(tn, f'{tn}+{fp}')}, 6) as tnr",
        f"round({rz(fp, f'{fp}+{tn}')}, 6) as fpr",
        f"round({rz(fn, f'{fn}+{tp}')}, 6) as fnr",
    ])


def confusion_sql(y: str, pred: str) -> str:
    return ",\n  ".join([
        f"cast(sum(case when {y} = 0 and {pred} = 0 then 1 else 0 end) as bigint) as tn",
        f"cast(sum(case when {y} = 0 and {pred} = 1 then 1 else 0 end) as bigint) as fp",
        f"cast(sum(case when {y} = 1 and {pred} = 0 then 1 else 0 end) as bigint) as fn",
        f"cast(sum(case when {y} = 1 and {pred} = 1 then 1 else 0 end) as bigint) as tp",
    ])


def mcc_sql(tp="tp", fp="fp", tn="tn", fn="fn") -> str:
    d = lambda c: f"cast({c} as double)"
    den = f"sqrt(({d(tp)}+{d(fp)})*({d(tp)}+{d(fn)})*({d(tn)}+{d(fp)})*({d(tn)}+{d(fn)}))"
    return f"round(coalesce(({d(tp)}*{d(tn)} - {d(fp)}*{d(fn)}) / nullif({den}, 0), 0e0), 6)"


def snapshot_sql(tp="tp", fp="fp", tn="tn", fn="fn") -> str:
    d = lambda c: f"cast({c} as double)"
    ready = f"({tp} > 0 and {fp} > 0 and {tn} > 0 and {fn} > 0)"
    tpr = f"{d(tp)}/({d(tp)}+{d(fn)})"
    prec = f"{d(tp)}/({d(tp)}+{d(fp)})"
    vals = {
        "accuracy": f"({d(tp)}+{d(tn)})/({d(tp)}+{d(tn)}+{d(fp)}+{d(fn)})",
        "precision": prec,
        "tpr": tpr,
        "fpr": f"{d(fp)}/({d(fp)}+{d(tn)})",
        "tnr": f"{d(tn)}/({d(tn)}+{d(fn)})",
        "fnr": f"{d(fn)}/({d(tn)}+{d(fn)})",
        "fscore": f"2e0*(({prec})*({tpr}))/(({prec})+({tpr}))",
    }
    return ",\n  ".join(f"round(case when {ready} then {v} else 0e0 end, 6) as {k}"
                         for k, v in vals.items())


def outcome_sql(tag: str = "tag", actual: str = "y_any") -> str:
    conds = {
        "l1_tp": f"{tag} = 'L1_ANOMALY' and {actual} = 1",
        "l1_fp": f"{tag} = 'L1_ANOMALY' and {actual} = 0",
        "l1_tn": f"{tag} <> 'L1_ANOMALY' and {actual} = 0",
        "l1_fn": f"{tag} <> 'L1_ANOMALY' and {actual} = 1",
        "l2_tp": f"{tag} = 'L2_ANOMALY' and {actual} = 1",
        "l2_fp": f"{tag} = 'L2_ANOMALY' and {actual} = 0",
        "l2_tn": f"{tag} = 'NOT_ANOMALY2' and {actual} = 0",
        "l2_fn": f"{tag} = 'NOT_ANOMALY2' and {actual} = 1",
    }
    cols = [f"cast(sum(case when {c} then 1 else 0 end) as bigint) as {k}" for k, c in conds.items()]
    cols.append(f"cast(sum(case when {tag} = 'QUARANTINE' then 1 else 0 end) as bigint) as quarantined")
    cols.append("count(*) as total")
    return ",\n  ".join(cols)


def hash_sql(key: str = "flow_id", seed: int = 42) -> str:
    return f"md5('{seed}:' || cast({key} as varchar))"


def strat_split_sql(src: str, by: str = "attack_class", key: str = "flow_id",
                    frac: str = "3e-1", seed: int = 42) -> str:
    """Reference formulation of SPL1 with a per-class window."""
    return f"""select s.*, case when rn <= floor({frac} * n) then 'valid' else 'train' end as split
  from (select {src}.*, row_number() over (partition by {by} order by {hash_sql(key, seed)}) as rn,
               count(*) over (partition by {by}) as n
        from {src}) s"""
