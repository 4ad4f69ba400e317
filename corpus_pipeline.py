"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twotier.llm.best_fit_packing import pack
from twotier.llm.common import kept, read
from twotier.llm.decontamination import contaminated
from twotier.llm.language_id import language_filter
from twotier.llm.near_dedup import near_duplicates
from twotier.llm.pii import pseudonymize_column


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are text of a learned language.  Null and empty texts and
    texts without a letter go; rows that repeat an id are judged one by one.  Where no
    language can be learned all texts with letters stay.  An empty table stays empty."""
    return language_filter(docs)


def _row_key() -> Column:
    """One number for equal rows (id and text), never null."""
    return F.xxhash64("doc_id", "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group, and one row
    of those that repeat both id and text (null ids and texts are equal here).  Other
    rows of one id stay or go together; a document with a null id, or without words,
    belongs to no group.  An empty table stays empty."""
    dropped = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    left = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    # repeats are few or none: only their keys, and then their rows, are shuffled
    key = "row key of " + " ".join(docs.columns)
    repeats = kept(docs.groupBy(_row_key().alias(key)).count().where("count > 1").select(key), "repeats")
    left = left.withColumn(key, _row_key())
    once = left.join(repeats, key, "left_anti")
    several = left.join(repeats, key, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(*docs.columns).unionByName(several.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold three quarters of a benchmark item or more.  Each
    row is judged by its own text, also where ids repeat or are null; null and empty
    texts stay, as does everything where the benchmark is empty."""
    key = "row key of " + " ".join(docs.columns)
    leaks = contaminated(docs.select(_row_key().alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    leaks = leaks.select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, _row_key()).join(leaks, key, "left_anti").select(*docs.columns)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal numbers, dates and addresses by pseudonyms of the same format
    and length.  Every row stays; null and empty texts stay as they are, and equal values
    get equal pseudonyms in all rows."""
    return pseudonymize_column(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences.  Null and
    empty texts are one piece of one token; rows that repeat an id have a place each; an
    empty table has no pieces."""
    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", pseudonymize),
    ("packing", pack_sequences),
]

#: No SQL: the stages fit profiles, permute values and tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table of documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
