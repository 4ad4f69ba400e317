"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import shared_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the cluster's shared folder and read it back: its
    lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of documents that no model learns from: the crc32 of
    the id as text is divisible by 5.  A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample_by_hash(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by the hash of ``key`` (the same
    rows in every run); all of them where there are no more."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * rows / total))


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable], schema: str) -> DataFrame:
    """``mapInArrow`` over ``columns`` of ``df``.  ``make()`` runs once a task and
    returns a function from the batch's column lists to a list of output columns
    in the order of ``schema``."""
    spark = df.sparkSession
    out = spark.createDataFrame([], schema).schema
    arrow, owner = to_arrow_schema(out), uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_worker(owner)
        work = make()
        for batch in batches:
            # some hundred texts at a time bound the memory of a batch of long texts
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols = work(*[part.column(i).to_pylist() for i in range(part.num_columns)])
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                         for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def row_udf(spark: SparkSession, make: Callable[[], Callable], returns: str) -> Callable[..., Column]:
    """An Arrow UDF of one value per row, so that the other columns stay in the JVM
    under whatever names they have.  ``make()`` runs once a task and returns the
    function of one row's values; ``returns`` is the DDL of the result's type."""
    kind = to_arrow_schema(spark.createDataFrame([], f"x {returns}").schema).field(0).type
    state: list[Callable] = []
    owner = uuid.uuid4().hex

    def run(*columns: pa.Array) -> pa.Array:
        if not state:
            _own_worker(owner)
            state.append(make())
        return pa.array([state[0](*row) for row in zip(*[c.to_pylist() for c in columns])], type=kind)

    return F.arrow_udf(run, returns)


def _own_worker(owner: str) -> None:
    """Frees what a Python worker holds for another operator than ``owner``."""
    held = sys.__dict__.setdefault("_twotier_held", {})
    if held.get("owner") != owner:
        held.clear()
        held["owner"] = owner


def per_worker(name: str, make: Callable):
    """An object that a Python worker keeps from task to task of one operator: a memo or
    a loaded file, never anything that results depend on."""
    held = sys.__dict__.setdefault("_twotier_held", {})
    if name not in held:
        held[name] = make()
    return held[name]


def spans_of(kinds: list[str], column: str = "spans") -> Column:
    """The spans of some kinds."""
    return F.filter(column, lambda s: s["kind"].isin(kinds))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
