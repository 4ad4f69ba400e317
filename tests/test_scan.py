"""Window-free scan helpers against brute force."""

from __future__ import annotations

import hashlib
import math
import random

from pyspark.sql import functions as F

from twotier.functions.hashing import seeded_hash
from twotier.functions.scan import (hash_prefix_bucket, kth_smallest_value, prefix_sums,
                                    rank_cutoff, rank_flag)


def _frame(spark, n=3000, groups=3):
    rows = [(f"k{i}", f"g{i % groups}") for i in range(n)]
    return spark.createDataFrame(rows, "key string, g string").withColumn("h", seeded_hash("key", 7))


def test_rank_flag_matches_sorted_cut(spark):
    df = _frame(spark)
    k = spark.createDataFrame([("g0", 10), ("g1", 0), ("g2", 5000)], "g string, k long")
    got = {(r["key"]) for r in rank_flag(df, ["g"], "h", k, "f", digits=2).where("f = 1").collect()}
    want = set()
    for g, kk in (("g0", 10), ("g1", 0), ("g2", 5000)):
        keys = sorted((hashlib.md5(f"7:{r}".encode()).hexdigest(), r)
                      for r in (f"k{i}" for i in range(3000)) if int(r[1:]) % 3 == int(g[1:]))
        want |= {r for _, r in keys[:kk]}
    assert got == want


def test_rank_cutoff_global_group(spark):
    df = _frame(spark, n=500, groups=1)
    k = spark.createDataFrame([(37,)], "k long")
    got = sorted(r["h"] for r in rank_cutoff(df, [], "h", k, digits=1).collect())
    allh = sorted(hashlib.md5(f"7:k{i}".encode()).hexdigest() for i in range(500))
    assert got == allh[:37]


def test_prefix_sums_equal_running_sum(spark):
    rows = [(f"{hashlib.md5(str(i).encode()).hexdigest()}", i % 2, 1 + i % 5) for i in range(2000)]
    df = spark.createDataFrame(rows, "seq string, part int, v long").withColumn("b", hash_prefix_bucket("seq", 2))
    out = {(r["part"], r["seq"]): r["cum_v"] for r in prefix_sums(df, ["seq"], ["v"], "b", ["part"]).collect()}
    for p in (0, 1):
        run = 0
        for seq, part, v in sorted(r for r in rows if r[1] == p):
            run += v
            assert out[(p, seq)] == run


def test_kth_smallest_value_refines(spark):
    random.seed(3)
    vals = [random.random() * 100 for _ in range(5000)] + [50.0] * 40
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = sorted(vals)
    for k in (1, 777, 2520, len(vals)):
        assert kth_smallest_value(df, "x", k, max_values=300) == s[k - 1]
    assert kth_smallest_value(df, "x", len(vals) + 1) is None
    assert math.isfinite(s[0]) and F is not None


def test_kth_hash_by_group_with_refinement(spark):
    from twotier.functions.scan import first_k_flag, kth_hash_by_group
    df = _frame(spark, n=3000, groups=3)
    kth = kth_hash_by_group(df, "g", "h", lambda n: n // 3, digits=1, max_rank_rows=50)
    got = {r["key"] for r in df.where(first_k_flag("h", "g", kth) == 1).collect()}
    want = set()
    for gi in range(3):
        keys = sorted((hashlib.md5(f"7:k{i}".encode()).hexdigest(), f"k{i}") for i in range(3000) if i % 3 == gi)
        want |= {r for _, r in keys[:len(keys) // 3]}
    assert got == want


def _largest(df, n):
    from twotier.functions.scan import quantile_buckets
    sizes = quantile_buckets(df, "v", n, "b").groupBy("b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    order = sorted(sizes, key=lambda r: r["b"])
    assert all(a["hi"] <= b["lo"] for a, b in zip(order, order[1:]))  # monotone
    return max(r["n"] for r in sizes), len(sizes)


def test_sketch_buckets_keep_their_target(spark):
    million = spark.range(1_000_000).select(F.pow(F.rand(3), 4).alias("v"))
    assert _largest(million, 50)[0] <= 1.2 * 1_000_000 / 50
    most, buckets = _largest(million, 1000)
    assert most <= 1.5 * 1_000_000 / 1000 and buckets >= 900
    assert _largest(million, 1) == (1_000_000, 1)


def test_kth_value_of_many_and_of_tied_values(spark):
    from twotier.functions.scan import kth_smallest_value
    many = spark.range(10_000_000, numPartitions=8).select(((F.col("id") * 7919) % 10_000_000).cast("double").alias("v"))
    assert kth_smallest_value(many, "v", 9_500_000) == 9_499_999.0
    tied = spark.range(100_000).select(F.when(F.col("id") < 90_000, 1.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert kth_smallest_value(tied, "v", 90_000, max_values=100) == 1.0
    assert kth_smallest_value(tied, "v", 90_001, max_values=100) == 90_000.0
    assert kth_smallest_value(tied, "v", 100_001) is None and kth_smallest_value(tied, "v", 0) is None
