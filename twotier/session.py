"""Spark session and shared-storage helpers.

The library never creates machine-local scratch space on a cluster: lineage is
cut with ``DataFrame.checkpoint()`` into the folder the cluster names in
``spark.checkpoint.dir``.  Only in local mode, where that setting is absent in
tests, do we pick a private folder under the system temp directory; on a cluster
a missing setting is an error.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, app: str = "twotier") -> SparkSession:
    """Session for tests and the bench: AQE on, UI off, UTC, Arrow on."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(sc) -> bool:
    """True where driver and executors are one process."""
    return sc is not None and re.match(r"local(\[|$)", sc.master or "") is not None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a private one only if unset.

    Reads ``spark.checkpoint.dir`` from the session (classic or Connect); the
    SparkContext route is used only where the session exposes it.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and sc is not None:
        conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir and not is_local(sc):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="twotier-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", conf_dir)
        except Exception:
            pass
    if sc is not None:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    return conf_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint (never localCheckpoint): survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared folder and read back: later steps read it, and a
    lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of one partition of a held frame, at most on average; rows that are worth a task of their own.
ROWS_PER_PART = 250_000
ROWS_WORTH_A_TASK = 25_000


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` kept in memory, then on disk, for a learner that passes over it many times.

    A compressed table of few splits gives few tasks with many rows each; such a frame is dealt
    out evenly over as many partitions as its rows need, in whole rounds of the cores where the
    rows are worth that many tasks.  A frame of small partitions stays as it is."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # one row a partition
    n, cores = sum(sizes), df.sparkSession.sparkContext.defaultParallelism
    parts = -(-n // ROWS_PER_PART)
    rounds = -(-parts // cores) * cores
    if n >= rounds * ROWS_WORTH_A_TASK:
        parts = rounds
    # too many rows a partition, or most of them in few of the partitions
    if n > ROWS_PER_PART * len(sizes) or max(sizes, default=0) * parts > 2 * n:
        df = df.repartition(parts)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()
