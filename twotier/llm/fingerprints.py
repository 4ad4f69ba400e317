"""MinHash document fingerprints.

A fingerprint is the text's signature under 128 universal hash permutations of
its five-word shingles, in vectorised numpy: the lower 16 bits of each minimum,
as 512 hexadecimal digits; empty for a text without words.  Equal texts have equal
fingerprints.  The likeness of two fingerprints is the share of equal positions,
corrected for positions that agree by chance.

``similar_documents`` joins signature bands in Spark and verifies the Jaccard
similarity of each candidate; ``edited_fingerprints`` measures how a fingerprint
holds against an edit and against an unrelated neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_rows, read, shuffle_partitions
from .near_dedup import near_duplicates
from .words import MinHash, shingle_set

QUERY = "op10_fingerprints"
PERMUTATIONS = 128
CHANCE = 2.0 ** -16
#: Range buckets for each shuffle partition, so that unequal buckets even out.
BUCKETS_PER_PARTITION = 3

RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def fingerprint(text: str | None, family: MinHash) -> np.ndarray:
    """128 16-bit values; an empty array for a text without words."""
    s = shingle_set(text)
    return family.signature(s).astype(np.uint16) if len(s) else np.zeros(0, np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; two empty fingerprints are alike, an empty one and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return max(0.0, (float((a == b).mean()) - CHANCE) / (1 - CHANCE))


def as_hex(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as many first code
    points of ``following``, or all of it."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every text; a null text counts as empty."""
    def make():
        family = MinHash(PERMUTATIONS)

        def work(ids, texts):
            return [ids, [len(t or "") for t in texts], [as_hex(fingerprint(t, family)) for t in texts]]
        return work

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id", "text"], make,
                    "doc_id bigint, n_chars bigint, fingerprint string")


def similar_documents(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Documents that have near-duplicates, with their class: doc_id, class_id (the
    smallest doc_id of the class).  Bands of the signatures are joined in Spark and
    every link is verified on the full shingle sets; copies are not expanded into
    pairs.  Same rules for nulls, ties and repeats as ``near_duplicates``."""
    found = near_duplicates(docs, percent).select("doc_id", F.col("component_id").alias("class_id"))
    classes = found.groupBy("class_id").agg(F.count_distinct("doc_id").alias("n")).where("n > 1").select("class_id")
    return found.join(classes, "class_id").select("doc_id", "class_id")


def _neighbours(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id and sorted descending within a range, largest
    first; each range also holds a copy (borrowed) of the first row of the range below
    it, and the lowest range one of the first row of all."""
    parts = shuffle_partitions(docs.sparkSession)
    ranges = parts * BUCKETS_PER_PARTITION
    # an eighth of a range's share of the rows is the error of a cut
    cuts = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], min(0.0005, 1 / (8 * ranges)))
    cuts = np.unique(np.array(cuts, np.int64))
    # a range is the number of cuts below the id; null ids come last, below all others
    deal = F.arrow_udf(lambda ids: pa.array(np.searchsorted(cuts, ids.to_numpy(zero_copy_only=False)).astype(np.int32)),
                       "int", ArrowUDFType.SCALAR)
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(deal(F.coalesce("doc_id", F.lit(0))))
    rows = docs.select("doc_id", "text", bucket.alias("bucket"))
    # the largest id of each range: no more rows than there are ranges
    found = rows.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy(F.desc("bucket")).collect()
    order = [r["bucket"] for r in found]
    lend_to = {b: order[i - 1] for i, b in enumerate(order)}  # the range above; the top range lends to the lowest
    head_of = {r["bucket"]: r["head"] for r in found}

    def lend(buckets: pa.Array, ids: pa.Array) -> pa.Array:
        return pa.array([lend_to[b] if i == head_of[b] else None
                         for b, i in zip(buckets.to_pylist(), ids.to_pylist())], pa.int32())

    lend = F.arrow_udf(lend, "int", ArrowUDFType.SCALAR)("bucket", "doc_id")
    both = F.array_compact(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("borrowed")),
                                   F.when(F.col("lend").isNotNull(), F.struct(F.col("lend").alias("bucket"),
                                                                              F.lit(1).alias("borrowed")))))
    spread = rows.withColumn("lend", lend).select("doc_id", "text", F.inline(both).alias("bucket", "borrowed"))
    return (spread.repartition(parts, "bucket")
            .sortWithinPartitions(F.desc("bucket"), "borrowed", F.desc_nulls_last("doc_id"), "text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, the SHA-256 of the edited
    text, both fingerprints, and the likeness of the text's fingerprint to the edited
    text's (near_edited) and to the next document's (near_next).

    The next document is the one with the next smaller doc_id; after the smallest
    comes the largest.  Rows that repeat a doc_id follow one another by text; rows
    with a null id come after the smallest.  A null text is empty.  A single document
    is its own neighbour.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = docs.sparkSession.createDataFrame([], RESULT).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = MinHash(PERMUTATIONS)
        rows, last = [], None  # last: the row before, with its fingerprint

        def pair(row, print_, following, next_print):
            edited = edited_text(row[1], following)
            edited_print = fingerprint(edited, family)
            return (row[0], len(row[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                    as_hex(print_), as_hex(edited_print), likeness(print_, edited_print), likeness(print_, next_print))

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                now = fingerprint(row[1], family)
                if last is not None and last[0][2] == row[2] and not last[0][3]:
                    rows.append(pair(*last, row[1], now))
                    if len(rows) >= 2000:
                        yield _batch(rows, arrow)
                        rows = []
                last = row, now
        if rows:
            yield _batch(rows, arrow)

    return _neighbours(docs).select("doc_id", "text", "bucket", "borrowed").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))
