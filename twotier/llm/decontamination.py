"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document may be long, so their Jaccard similarity is
tiny even where the item stands in the document.  Items are therefore partitioned
by set size (upper bounds 4, 8, 16, 32, ...), and each partition is searched in
document windows of twice its bound that overlap by half: an item that stands
whole in a document stands whole in one window, where the similarity is at least
0.15 even at a containment of 0.75.  A window is a candidate for an item if any of
their 64 MinHash values agree.  Candidates are verified by exact shingle
containment in the whole document, in the same task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read
from .words import MinHash, shingle_hashes, shingle_set, word_hashes

QUERY = "op3_decontamination"
PERMUTATIONS = 64
SMALLEST = 4
#: Items go to the executors in blocks of at most so many shingles (8 bytes each, and
#: 64 MinHash values an item), whatever the size of the benchmark table.
BLOCK_SHINGLES = 1_000_000

RESULT = "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint, containment double"


class ItemIndex:
    """MinHash tables of one block of items, one for each size partition."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.sets = [s for _, s in items]
        family = MinHash(PERMUTATIONS)
        slot = np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32)
        parts: dict[int, tuple[list, list]] = {}
        for n, s in enumerate(self.sets):
            bound = SMALLEST
            while bound < len(s):
                bound *= 2
            keys, owners = parts.setdefault(bound, ([], []))
            keys.append(slot + family.signature(s).astype(np.uint64))
            owners.append(np.full(PERMUTATIONS, n))
        self.block = min(parts)  # the block whose minima all windows are made of
        self.parts = {}
        for bound, (keys, owners) in parts.items():
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            self.parts[bound] = key[order], owner[order]

    def candidates(self, blocks: np.ndarray) -> set[int]:
        """Items that share a MinHash value with a window.  ``blocks`` has the
        minima of the document's blocks of ``self.block`` shingles, permutation by row."""
        found: set[int] = set()
        slot = (np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32))[:, None]
        for bound in sorted(self.parts):
            key, owner = self.parts[bound]
            step = bound // self.block
            wide = np.minimum.reduceat(blocks, np.arange(0, blocks.shape[1], step), axis=1)
            if wide.shape[1] > 1:
                wide = np.minimum(wide[:, :-1], wide[:, 1:])
            seen = (slot + wide.astype(np.uint64)).ravel()
            low = np.searchsorted(key, seen)
            low[low == len(key)] = 0
            seen = np.unique(seen[key[low] == seen])
            for a, b in zip(np.searchsorted(key, seen), np.searchsorted(key, seen, "right")):
                found.update(owner[a:b].tolist())
        return found

    def leaks(self, text: str | None, family: MinHash, threshold: float) -> list[tuple[int, int, int, float]]:
        """(item_id, item shingles, shared shingles, containment) of each item that
        the text contains at the threshold or more."""
        ordered = shingle_hashes(word_hashes(text))
        if not len(ordered):
            return []
        # blocks of a piece of the text at a time bound the memory of a very long one
        blocks = np.concatenate([
            np.minimum.reduceat(values := family.values(ordered[at:at + 4096]), np.arange(0, values.shape[1], self.block),
                                axis=1) for at in range(0, len(ordered), 4096)], axis=1)
        found = self.candidates(blocks)
        if not found:
            return []
        whole, out = np.unique(ordered), []
        for n in sorted(found):
            item = self.sets[n]
            at = np.searchsorted(whole, item)
            at[at == len(whole)] = 0
            shared = int((whole[at] == item).sum())
            if shared >= threshold * len(item):
                out.append((self.ids[n], len(item), shared, shared / len(item)))
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[ItemIndex]:
    """The items in blocks of bounded size.  They stream through the driver one
    partition at a time; only one block is held."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("bigint"), "text").where("item_id is not null").toLocalIterator()
    for item_id, text in rows:
        s = shingle_set(text)
        if len(s):
            block.append((item_id, s))
            size += len(s) + PERMUTATIONS
        if size >= BLOCK_SHINGLES:
            yield ItemIndex(block)
            block, size = [], 0
    if block:
        yield ItemIndex(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row for each document and item of which the document holds at least
    ``threshold`` of the distinct shingles: doc_id, item_id, n_item, n_shared,
    containment.

    Null, empty and white-space texts of either side contain nothing and are
    contained in nothing; items or documents with a null id give no row; an item of
    one to four words has one shingle and is found only in a text of just these
    words.  Rows that repeat an id give one row each where their text matches.  Empty tables give
    an empty result.  No column but the ids and texts is read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    out = spark.createDataFrame([], RESULT)
    for index in item_blocks(benchmark):
        def make(index=index):  # the block goes with the function, which Spark broadcasts
            family = MinHash(PERMUTATIONS)

            def work(ids, texts):
                rows = [(i, *r) for i, t in zip(ids, texts) for r in index.leaks(t, family, threshold)]
                return list(zip(*rows)) if rows else [[]] * 5
            return work

        out = out.union(map_rows(docs, ["doc_id", "text"], make, RESULT))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
with t as (select 0 as kind, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
w as (select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as ws from t),
s as (select kind, id, unnest(case when len(ws) = 0 then []
        when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end) as x from w),
n as (select id, count(*) as n_item from s where kind = 1 group by id)
select d.id as doc_id, b.id as item_id, n.n_item, count(*) as n_shared, count(*) / n.n_item as containment
from s d join s b on d.x = b.x and d.kind = 0 and b.kind = 1 join n on n.id = b.id
group by d.id, b.id, n.n_item having count(*) >= 0.75 * n.n_item
"""
