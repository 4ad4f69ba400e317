"""Deterministic per-row randomness from ``md5(seed:key)``.

Unlike ``rand()`` / ``randomSplit`` these draws do not depend on partitioning
or task retries, so a recomputed partition after executor loss yields the
same rows, and DuckDB can reproduce every draw exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(key, seed: int | str = 42) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def uniform_from_hash(h: Column, offset: int = 0) -> Column:
    """Uniform [0, 1) double from 8 hex digits of a hash (32 bits)."""
    digits = F.substring(h, 1 + offset, 8)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


def uniform(key, seed: int | str = 42, offset: int = 0) -> Column:
    return uniform_from_hash(seeded_hash(key, seed), offset)


def uniform_sql(key_sql: str, seed: int | str = 42, offset: int = 0) -> str:
    """DuckDB text of ``uniform`` for the oracle."""
    return (f"(cast(('0x' || substr(md5('{seed}:' || cast({key_sql} as varchar)), {1 + offset}, 8)) as bigint)"
            f" / 4294967296e0)")
