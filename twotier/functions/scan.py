"""Scalable running sums and exact rank cut-offs.

A plain ``Window.orderBy(...)`` without ``partitionBy`` moves every row into a
single task.  The helpers here replace it with a two-level scan:

1. every row gets a coarse *bucket* that is monotone in the sort order
   (hash prefix for md5 keys, approximate-quantile bins for doubles);
2. per-bucket totals are aggregated (partial/final, tiny result) and turned
   into bucket offsets with a window over at most ``n_buckets`` rows;
3. rows are scanned with a window partitioned by bucket (parallel) and the
   broadcast offset is added.  The offsets frame has a proven bound of
   ``n_buckets x n_groups`` rows, so the broadcast is safe.

``rank_cutoff`` uses the same idea to keep the k smallest rows per group
exactly: histogram, locate the bucket holding the k-th row, and rank only
inside that one bucket.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


MAX_BROADCAST_GROUPS = 100_000


def hash_prefix_bucket(col: str | Column, digits: int = 2) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.substring(c, 1, digits)


#: Buckets that one level of sketches cuts; the sketch's rank error (about 0.1 %) is far below their share.
LEVEL_BUCKETS = 64
SKETCH_K = 4096


def _bounds(col: str, parts: int) -> Column:
    """The inner bounds of ``parts`` parts of equal weight, from a mergeable KLL sketch."""
    ranks = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(F.col(col), SKETCH_K), ranks)


def quantile_buckets(df: DataFrame, col: str, n_buckets: int = 64, out: str = "_bucket") -> DataFrame:
    """Bucket index monotone in ``col``, of about equal numbers of rows.  For distinct values
    none is above twice its share; callers count ties as weights of one row.

    Bounds come from KLL sketches.  Up to ``LEVEL_BUCKETS`` they are one sketch and literals;
    more buckets are cut level by level, with a sketch per bucket of the level before (a
    table of ``n_buckets`` rows at most, broadcast only if small).
    """
    if n_buckets <= 1:
        return df.withColumn(out, F.lit(0))
    if n_buckets <= LEVEL_BUCKETS:
        found = df.where(F.col(col).isNotNull() & ~F.isnan(col)).agg(_bounds(col, n_buckets).alias("b")).first()["b"]
        splits = [-math.inf, *sorted({float(b) for b in found or []}), math.inf]
        tmp = f"{out}_d"
        b = Bucketizer(splits=splits, inputCol=col, outputCol=tmp, handleInvalid="keep")
        return b.transform(df).withColumn(out, F.col(tmp).cast("int")).drop(tmp)
    parts, have = math.ceil(n_buckets / LEVEL_BUCKETS), LEVEL_BUCKETS
    df = quantile_buckets(df, col, LEVEL_BUCKETS, out)
    while parts > 1:
        now = min(LEVEL_BUCKETS, parts)
        cuts = df.where(F.col(col).isNotNull() & ~F.isnan(col)).groupBy(out).agg(_bounds(col, now).alias("_cuts"))
        df = df.join(F.broadcast(cuts) if have * now <= MAX_BROADCAST_OFFSETS else cuts, out, "left").withColumn(
            out, (F.col(out) * now + F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(col))), F.lit(0))).cast("int")).drop("_cuts")
        parts, have = math.ceil(parts / now), have * now
    return df


ROWS_PER_BUCKET = 250_000
MAX_BROADCAST_OFFSETS = 200_000


def digits_for_rows(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET, min_digits: int = 2) -> int:
    """Hex-prefix length giving about ``rows_per_bucket`` rows per bucket."""
    need = max(1.0, n_rows / rows_per_bucket)
    return max(min_digits, min(7, math.ceil(math.log(need, 16)) if need > 1 else min_digits))


def buckets_for_rows(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, math.ceil(n_rows / rows_per_bucket))


def prefix_sums(df: DataFrame, order_cols: list[str], value_cols: list[str],
                bucket_col: str, partition_cols: list[str] | None = None,
                prefix: str = "cum_", n_offsets: int | None = None) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ascending ``order_cols``
    within ``partition_cols``.  ``bucket_col`` must be non-decreasing in that
    order.  Adds ``{prefix}{v}`` columns.  ``n_offsets`` (buckets x
    partitions) decides whether the offsets are broadcast (bounded) or
    joined with a shuffle (beyond ``MAX_BROADCAST_OFFSETS``)."""
    parts = partition_cols or []
    w_in = (Window.partitionBy(*parts, bucket_col).orderBy(*order_cols)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = df.withColumns({f"_loc_{v}": F.sum(v).over(w_in) for v in value_cols})
    totals = df.groupBy(*parts, bucket_col).agg(*[F.sum(v).alias(f"_tot_{v}") for v in value_cols])
    w_b = (Window.partitionBy(*parts).orderBy(bucket_col)
           .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        *parts, bucket_col,
        *[F.coalesce(F.sum(f"_tot_{v}").over(w_b), F.lit(0)).alias(f"_off_{v}") for v in value_cols])
    small = n_offsets is not None and n_offsets <= MAX_BROADCAST_OFFSETS
    joined = local.join(F.broadcast(offsets) if small else offsets, [*parts, bucket_col], "inner")
    return joined.select(
        *df.columns,
        *[(F.col(f"_loc_{v}") + F.col(f"_off_{v}")).alias(f"{prefix}{v}") for v in value_cols])


def kth_hash(df: DataFrame, group_cols: list[str], hash_col: str, k: DataFrame,
             k_col: str = "k", digits: int = 3) -> DataFrame:
    """Per group, the value of ``hash_col`` (hex md5, unique) at rank ``k``.

    Exact and window-free over whole groups: a hex-prefix histogram (partial
    aggregation) finds the one bucket holding the k-th row; only that bucket is
    ranked.  Returns ``group_cols + [_kth]`` (one row per group, bounded), with
    ``_kth`` = the largest hash when k >= group size and NULL when k <= 0.
    """
    n_groups = k.count()  # k is one row per group: check before broadcasting it
    if n_groups > MAX_BROADCAST_GROUPS:
        raise ValueError(f"{n_groups} groups exceed the broadcast bound {MAX_BROADCAST_GROUPS}")
    bucket = "_hb"
    x = df.select(*group_cols, hash_col).withColumn(bucket, hash_prefix_bucket(hash_col, digits))
    hist = x.groupBy(*group_cols, bucket).agg(F.count(F.lit(1)).alias("_n"),
                                             F.max(hash_col).alias("_hmax"))
    w = (Window.partitionBy(*group_cols).orderBy(bucket)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = hist.withColumn("_cum", F.sum("_n").over(w)).withColumn("_before", F.col("_cum") - F.col("_n"))
    kk = F.broadcast(k.select(*group_cols, F.col(k_col).alias("_k")))
    cum = cum.join(kk, group_cols, "inner")
    # the single bucket per group that contains the k-th row
    cut = cum.where((F.col("_before") < F.col("_k")) & (F.col("_cum") >= F.col("_k"))).select(
        *group_cols, F.col(bucket).alias("_cut"), (F.col("_k") - F.col("_before")).alias("_rest"))
    edge = x.join(F.broadcast(cut), [*group_cols], "inner").where(F.col(bucket) == F.col("_cut"))
    w_edge = Window.partitionBy(*group_cols, bucket).orderBy(hash_col)
    inside = (edge.withColumn("_r", F.row_number().over(w_edge))
              .where(F.col("_r") == F.col("_rest")).select(*group_cols, F.col(hash_col).alias("_kth")))
    # k beyond the group size: every row qualifies
    over = (cum.groupBy(*group_cols).agg(F.max("_hmax").alias("_kth"), F.max("_cum").alias("_tot"),
                                         F.first("_k").alias("_k"))
            .where(F.col("_k") > F.col("_tot")).select(*group_cols, "_kth"))
    return inside.unionByName(over)


def rank_cutoff(df: DataFrame, group_cols: list[str], hash_col: str, k: DataFrame,
                k_col: str = "k", digits: int = 3, keep: bool = True) -> DataFrame:
    """Rows whose rank by ``hash_col`` within ``group_cols`` is <= k (or the
    complement when ``keep`` is False).  The per-group cut-off frame is
    bounded by the number of groups and broadcast, so the big side is only
    filtered, never shuffled."""
    if not group_cols:  # one global group: constant key, never a cross join
        out = rank_cutoff(df.withColumn("_g", F.lit(0)), ["_g"], hash_col,
                          k.withColumn("_g", F.lit(0)), k_col, digits, keep)
        return out.drop("_g")
    kth = kth_hash(df, group_cols, hash_col, k, k_col, digits)
    j = df.join(F.broadcast(kth), group_cols, "left")
    inside = F.coalesce(F.col(hash_col) <= F.col("_kth"), F.lit(False))
    return j.where(inside if keep else ~inside).drop("_kth")


def rank_flag(df: DataFrame, group_cols: list[str], hash_col: str, k: DataFrame,
              out: str, k_col: str = "k", digits: int = 3) -> DataFrame:
    """Adds ``out`` = 1 when the row is among the first k of its group."""
    kth = kth_hash(df, group_cols, hash_col, k, k_col, digits)
    j = df.join(F.broadcast(kth), group_cols, "left")
    return j.withColumn(out, F.coalesce(F.col(hash_col) <= F.col("_kth"), F.lit(False)).cast("int")) \
        .drop("_kth")


def kth_smallest_value(df: DataFrame, col: str, k: int, max_values: int = 20_000) -> float | None:
    """Exact k-th smallest value (1-based) of a double column.

    Ties count as weights of one value, written once.  While more distinct values than
    ``max_values`` are in question, KLL bounds cut them into buckets and the weights of those say
    which one holds the k-th row: it is at most a small share of the values, so the search ends
    for any input.  Only bucket weights and the last few values reach the driver.
    """
    if k <= 0:
        return None
    values = df.select(F.col(col).alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v").agg(F.count(F.lit(1)).alias("_w"))
    values = written(values, "values")
    sizes = values.agg(F.sum("_w").alias("rows"), F.count(F.lit(1)).alias("values")).first()
    if k > (sizes["rows"] or 0):
        return None
    rest, n = k, sizes["values"]
    while n > max_values:
        b = quantile_buckets(values, "_v", LEVEL_BUCKETS, out="_b")
        hist = sorted(tuple(r) for r in b.groupBy("_b").agg(F.sum("_w"), F.count(F.lit(1))).collect())  # one row a bucket
        for bucket, weight, count in hist:
            if weight >= rest:
                break
            rest -= weight
        values, n = b.where(F.col("_b") == bucket).select("_v", "_w"), count
    for value, weight in sorted(tuple(r) for r in values.collect()):  # max_values rows at most
        if weight >= rest:
            return float(value)
        rest -= weight
    return None


MAX_LOCAL_GROUPS = 1_000


def hash_histogram(df: DataFrame, group_col: str, hash_col: str, digits: int = 3) -> dict:
    """{group: [(prefix, count), ...]} collected from one aggregate; no more than
    MAX_LOCAL_GROUPS x 16^digits rows are fetched."""
    hist = df.groupBy(F.col(group_col).alias("_g"), hash_prefix_bucket(hash_col, digits).alias("_b")) \
        .agg(F.count(F.lit(1)).alias("_n")).limit(MAX_LOCAL_GROUPS * 16 ** digits + 1).collect()
    groups: dict = {}
    for r in hist:
        groups.setdefault(r["_g"], []).append((r["_b"], r["_n"]))
    if len(groups) > MAX_LOCAL_GROUPS or len(hist) > MAX_LOCAL_GROUPS * 16 ** digits:
        raise ValueError("too many groups for a driver-side histogram; use kth_hash")
    return groups


def kth_hash_by_group(df: DataFrame, group_col: str, hash_col: str, k_of_n, digits: int = 3,
                      max_rank_rows: int = ROWS_PER_BUCKET, hist: dict | None = None) -> dict:
    """Exact k-th smallest ``hash_col`` per group for a FEW groups (at most
    ``MAX_LOCAL_GROUPS``), with ``k = k_of_n(group_size)``.

    Pass 1 collects a (group, hash-prefix) histogram, bounded by
    groups x 16^digits rows; it yields both the group sizes and the bucket
    that holds each k-th row.  Pass 2 ranks only the rows of those edge
    buckets (a longer prefix is tried first while an edge bucket is larger
    than ``max_rank_rows``).  Returns {group: kth hash or None (k = 0)}.
    """
    x = df.select(F.col(group_col).alias("_g"), F.col(hash_col).alias("_h"))
    groups = hist if hist is not None else hash_histogram(df, group_col, hash_col, digits)
    targets = {}  # group -> (prefix, rank inside prefix)
    result: dict = {}
    for g, buckets in groups.items():
        n = sum(c for _, c in buckets)
        k = int(k_of_n(n))
        if k <= 0:
            result[g] = None
            continue
        k = min(k, n)
        before = 0
        for b, c in sorted(buckets):
            if before + c >= k:
                targets[g] = (b, k - before, c)
                break
            before += c
    # refine any edge bucket that is still too large for one ranking task, down to whole hashes
    while True:
        big = {g: t for g, t in targets.items() if t[2] > max_rank_rows and len(t[0]) < 32}
        if not big:
            break
        for g, (prefix, rest, _) in big.items():
            plen = len(prefix) + 2
            sub = (x.where((F.col("_g") == F.lit(g)) & F.col("_h").startswith(prefix))
                   .groupBy(hash_prefix_bucket("_h", plen).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
                   .collect())
            before = 0
            for r in sorted(sub, key=lambda r: r["_b"]):
                if before + r["_n"] >= rest:
                    targets[g] = (r["_b"], rest - before, r["_n"])
                    break
                before += r["_n"]
    if targets:
        # cheap prefix test first (one hash per row); the (group, prefix)
        # pairing is checked only on the few rows that pass it
        by_len: dict = {}
        for prefix, _, _ in targets.values():
            by_len.setdefault(len(prefix), set()).add(prefix)
        pre = None
        for plen, prefixes in by_len.items():
            c = F.substring("_h", 1, plen).isin(sorted(prefixes))
            pre = c if pre is None else pre | c
        cond = None
        for g, (prefix, _, _) in targets.items():
            c = (F.col("_g") == F.lit(g)) & F.col("_h").startswith(prefix)
            cond = c if cond is None else cond | c
        rank = Window.partitionBy("_g").orderBy("_h")
        edge = x.where(pre).where(cond).withColumn("_r", F.row_number().over(rank))
        want = F.lit(False)
        for g, (_, rest, _) in targets.items():
            want = want | ((F.col("_g") == F.lit(g)) & (F.col("_r") == F.lit(rest)))
        for r in edge.where(want).collect():
            result[r["_g"]] = r["_h"]
    return result


def first_k_flag(hash_col: str, group_col: str, kth: dict) -> Column:
    """1 when the row's hash is within its group's first k (a literal CASE,
    no join): rows of groups with k = 0 or unseen groups get 0."""
    expr = None
    for g, h in kth.items():
        if h is None:
            continue
        c = (F.col(group_col) == F.lit(g)) & (F.col(hash_col) <= F.lit(h))
        expr = c if expr is None else expr | c
    return (expr if expr is not None else F.lit(False)).cast("int")
