"""Relational base: projections, dict-driven queries, staleness, positional
append, set operations (PRJ1-PRJ4, FLT3, FLT4, JON2, JON3, JON5, SET1-SET3)."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select_features(df: DataFrame, names: list[str]) -> DataFrame:
    """PRJ1: projection by list (pruned down to the parquet scan)."""
    return df.select(*names)


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """PRJ2."""
    return df.drop(*names)


def split_target(df: DataFrame) -> tuple[DataFrame, str]:
    """PRJ3: the last column is the target, the rest are features."""
    return df.select(*df.columns[:-1]), df.columns[-1]


def cast_numeric(df: DataFrame, target: str | None = None,
                 skip: list[str] | None = None) -> DataFrame:
    """PRJ4: every feature to double, the target to int."""
    skip = set(skip or [])
    cols = []
    for f in df.schema.fields:
        if f.name == target:
            cols.append(F.col(f.name).cast("int").alias(f.name))
        elif f.name in skip or isinstance(f.dataType, T.StringType):
            cols.append(F.col(f.name))
        else:
            cols.append(F.col(f.name).cast("double").alias(f.name))
    return df.select(*cols)


def perform_query(spark: SparkSession, request: dict, tables: dict[str, DataFrame] | None = None
                  ) -> DataFrame | None:
    """FLT3: ``{select, from, where?}`` -> DataFrame, or None on a SQL error.

    The clauses are applied as separate DataFrame calls (no string
    concatenation into one statement); WHERE and SELECT text stay Spark SQL
    expressions.  ``from`` names a catalog table or a key of ``tables``.
    """
    try:
        src = request["from"]
        df = tables[src] if tables and src in tables else spark.table(src)
        where = request.get("where")
        if where:
            df = df.where(F.expr(where))
        sel = request.get("select", "*")
        exprs = _select_items(sel) if isinstance(sel, str) else list(sel)
        df = df.selectExpr(*exprs)
        df.schema  # force analysis so bad column names surface here
        return df
    except (AnalysisException, ParseException, KeyError):
        return None


def _select_items(select: str) -> list[str]:
    """The items of a SELECT list: commas inside brackets or quotes do not
    separate."""
    items, depth, quote = [""], 0, ""
    for c in select:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        else:
            depth += (c in "([") - (c in ")]")
        if c == "," and not depth and not quote:
            items.append("")
        else:
            items[-1] += c
    return [i.strip() for i in items]


def is_stale(df: DataFrame, ts_col: str, now: str, hours: int = 3, out: str = "stale") -> DataFrame:
    """FLT4: ``now - ts > hours``; a missing timestamp is not stale.  ``now``
    is passed in (testable, deterministic)."""
    now_ts = F.to_timestamp(F.lit(now))
    limit = now_ts - F.expr(f"INTERVAL {int(hours)} HOURS")
    return df.withColumn(out, F.coalesce(F.col(ts_col).cast("timestamp") < limit, F.lit(False)))


def with_row_index(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Row position for files that carry no key (file order).  Uses
    ``zipWithIndex`` (one extra job to count partitions), never a global
    window."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType(), False)])
    rdd = df.rdd.zipWithIndex().map(lambda rv: (*rv[0], rv[1]))
    return df.sparkSession.createDataFrame(rdd, schema)


MAX_SPLITS = 1_000_000


def with_file_order(df: DataFrame, name: str = "row_id") -> DataFrame:
    """The position of each row in file order (files by path, rows as they stand), for a frame
    read from files and not changed since.

    The rows of each file split are counted in one aggregate; a row's position is its split's
    offset plus its place in the split.  Splits (not rows) reach the driver and go back."""
    marked = df.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
                             "_at": F.monotonically_increasing_id()})
    splits = marked.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).limit(MAX_SPLITS + 1).collect()
    if len(splits) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} file splits")
    offsets, total = [], 0
    for s in sorted(splits, key=lambda s: (s["_file"], s["_start"])):
        offsets.append((s["_file"], s["_start"], total - s["_first"]))
        total += s["_n"]
    table = df.sparkSession.createDataFrame(offsets, "_file string, _start long, _offset long")
    return marked.join(F.broadcast(table), ["_file", "_start"]).withColumn(name, F.col("_at") + F.col("_offset")).drop(
        "_file", "_start", "_at", "_offset")


def append_by_file_order(df: DataFrame, values: DataFrame) -> DataFrame:
    """JON2 for files without keys: the columns of ``values`` beside those of ``df``, row by row in
    file order.  Raises if the files differ in length."""
    a, b = with_file_order(df, "_row"), with_file_order(values, "_row")
    n, m = df.count(), values.count()
    if n != m:
        raise ValueError(f"{n} rows beside {m} values")
    return a.join(b, "_row").drop("_row")


def append_column_by_key(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """JON2: attach a target column kept beside the table.  Inner equi-join
    on the shared row key; raises if the sides do not align one to one."""
    joined = df.join(values, key, "inner")
    return joined


def check_aligned(df: DataFrame, values: DataFrame, key: str) -> None:
    """Every key must stand exactly once on each side (one aggregate job)."""
    a = df.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = values.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    bad = a.union(b).groupBy(key).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).where("_a <> 1 or _b <> 1")
    if not bad.isEmpty():
        raise ValueError("table and value column do not align by row key")


def set_difference(df1: DataFrame, df2: DataFrame, key: str | list[str]) -> DataFrame:
    """JON3: rows of df1 whose key is not in df2."""
    return df1.join(df2.select(key if isinstance(key, str) else list(key)).distinct(), key, "left_anti")


def gather(scored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JON5: predictions for a subset of rows (semi-join on the key)."""
    return scored.join(ids.select(key), key, "left_semi")


def _sides(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Each value of either list once, with the sides that hold it (``_a``, ``_b``): one aggregate with
    map-side combine, so that only distinct values shuffle and no value's rows meet in a task."""
    marked = a.select(col, F.lit(True).alias("_a"), F.lit(False).alias("_b")).union(
        b.select(col, F.lit(False).alias("_a"), F.lit(True).alias("_b")))
    return marked.groupBy(col).agg(F.bool_or("_a").alias("_a"), F.bool_or("_b").alias("_b"))


def intersect_lists(a: DataFrame, b: DataFrame, col: str = "feature") -> DataFrame:
    """SET1: the distinct values of both lists (nulls are equal)."""
    return _sides(a, b, col).where("_a and _b").select(col)


def except_lists(a: DataFrame, b: DataFrame, col: str = "label") -> DataFrame:
    """SET2: the distinct values of ``a`` that are not in ``b`` (set
    difference: how often a value repeats on either side does not count; a null
    of ``a`` is in no list)."""
    return _sides(a, b, col).where(F.col("_a") & (~F.col("_b") | F.col(col).isNull())).select(col)


def union_rows(*dfs: DataFrame) -> DataFrame:
    """SET3."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
