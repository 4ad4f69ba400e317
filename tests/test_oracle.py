"""Every query with an oracle: Spark result == DuckDB result (row count,
column names, order-insensitive values; doubles compared at 6 places)."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as E

SQL = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


def test_every_query_has_a_callable():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 90


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(s_cols, s_rows) == _rows(d_cols, d_rows)
