"""Best-fit packing planned on the length histogram.

Documents are tokenized and cut into pieces of at most one sequence.  Best-fit
decreasing then runs over the counts of each length, not over documents: bins with
the same free space are one group, and a length fills whole groups at once.  The plan
says, for each length, which ranks go to which sequences.  Pieces get their rank
within their length and take the planned slot by a join.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, map_rows, per_worker, read, shuffle_partitions

QUERY = "op5_best_fit_packing"
CAPACITY = 2048
SEPARATOR = 0
MEMO = 600_000
LINE = 200
#: Texts whose new chunks are learned together, in alphabetical order, which is faster.
TEXTS = 1000
#: Lower-case Latin-1 letters.  A word of them is one token sequence of its own: neither
#: the tokenizer's normalizer nor its patterns change or cut it.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_PLAIN = re.compile(f"[{_LETTERS}]+")
#: A full stop or comma before a gap that does not follow a letter.
_ODD_STOP = re.compile(f"[.,](?= )(?<=[^{_LETTERS}].)")

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Ids:
    """Token ids of a text as little-endian 32-bit bytes.

    A text is tokenized between its spaces, tabs and line ends, with a memo: the tokenizer
    drops these, and neither its normalizer nor its patterns reach across.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole = Tokenizer.from_file(path)
        # for plain words only: the model alone, on words in the letters that stand for bytes
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xAA, 0x100)}
        vocabulary = self.whole.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {"": b""}

    @staticmethod
    def chunks(text: str | None) -> list[str]:
        """A text between its gaps.  Latin-1 text is lower-cased, as the tokenizer would do
        it, and its full stops and commas after words stand alone, as they are tokens."""
        text = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.split(" ")
        text = text.lower() + " "
        if not _ODD_STOP.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ")
        return text.split(" ")

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks many to a line.  Plain words end with a token that ends a word;
        others are told apart by the places of their tokens in the line."""
        plain = list(filter(_PLAIN.fullmatch, chunks))
        lines = self._lines(plain)
        texts = [text if text.isascii() else text.translate(self.as_bytes) for _, text in lines]
        for (line, _), found in zip(lines, self.plain.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            self._keep(line, ids, [0, *(np.flatnonzero(self.ends_word[ids]) + 1).tolist()])
        for line, text in self._lines(sorted(set(chunks).difference(plain))):
            found = self.whole.encode(text, add_special_tokens=False)
            starts = np.cumsum([0, *(len(c) + 1 for c in line[:-1])])
            cuts = np.searchsorted(np.array([o[0] for o in found.offsets], np.int64), starts)
            self._keep(line, np.array(found.ids, "<u4"), [*cuts.tolist(), len(found.ids)])

    @staticmethod
    def _lines(chunks: list[str]) -> list[tuple[list[str], str]]:
        lines = [chunks[at:at + LINE] for at in range(0, len(chunks), LINE)]
        return [(line, " ".join(line)) for line in lines]

    def _keep(self, line: list[str], ids: np.ndarray, cuts: list[int]) -> None:
        data = ids.tobytes()
        self.memo.update({c: data[4 * a:4 * b] for c, a, b in zip(line, cuts[:-1], cuts[1:], strict=True)})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.chunks(t) for t in texts]
        if len(self.memo) > MEMO:  # only a memo: nothing depends on what it holds
            self.memo = {"": b""}
        self._learn(sorted(set().union(*split).difference(self.memo)))
        get = self.memo.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of every document: its ids and the separator, cut every ``capacity``
    ids only where there are more."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def make():
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = per_worker(f"ids {path}", lambda: Ids(path))
        end = np.array([SEPARATOR], "<u4").tobytes()

        def work(doc_ids, texts):
            out = []
            for at in range(0, len(texts), TEXTS):
                for doc_id, data in zip(doc_ids[at:at + TEXTS], ids.encode(texts[at:at + TEXTS])):
                    data += end
                    for n, start in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[start:start + 4 * capacity]
                        out.append((doc_id, n, start // 4, len(part) // 4, zlib.crc32(part)))
            return list(zip(*out)) if out else [[]]
        return work

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id", "text"], make, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a length histogram.

    Rows (length, first, last, sequence, place, each): the pieces of ``length`` with
    rank first <= r < last go to sequence + (r - first) // each, at place +
    (r - first) % each * length.  A length goes first to the bins with the least free
    space that holds it, ``each`` times as often as it fits.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space: (first sequence, bins)
    out, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, total = 0, histogram[length]
        while rank < total:
            space = min((s for s in free if s >= length), default=None)
            if space is None:  # open as many empty bins as the rest of this length needs
                space, bins = capacity, -(-(total - rank) // (capacity // length))
                free[space].append((sequences, bins))
                sequences += bins
            first, bins = free[space].pop()
            if not free[space]:
                del free[space]
            each = space // length
            full = min(bins, (total - rank) // each)
            if full:
                out.append((length, rank, rank + full * each, first, capacity - space, each))
                rank += full * each
                free[space - each * length].append((first, full))
            if full < bins and rank < total:  # one more bin is filled in part
                out.append((length, rank, total, first + full, capacity - space, each))
                free[space - (total - rank) * length].append((first + full, 1))
                rank, full = total, full + 1
            if full < bins:
                free[space].append((first + full, bins - full))
    return out


PLAN = "length bigint, first bigint, last bigint, sequence bigint, place bigint, each bigint"


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and
    offset.  Every id of every document is placed once, no sequence exceeds
    ``capacity``, and offsets leave no gap.

    A null or empty text is the separator alone, one id.  Rows that repeat an id and
    null ids are packed like others; equal pieces may change places.  An empty table gives an empty
    result.  No column but the id and text is read.
    """
    spark = docs.sparkSession
    parts = kept(pieces(docs, capacity, path), "pieces")
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # <= capacity rows
    slots = spark.createDataFrame(plan(histogram, capacity), PLAN)
    # a frequent length is ranked in salted shares, whose sizes give each share's first rank
    shares = shuffle_partitions(spark)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)))
    before = (salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (salted.withColumn("own", own).join(before, ["length", "salt"])
              .withColumn("rank", F.col("own") + F.col("before")))
    if slots.count() <= 100_000:  # a plan has a few rows for each length, whatever the input
        slots = F.broadcast(slots)
    in_slot = F.col("rank") - F.col("first")
    return (ranked.join(slots, "length").where("rank >= first and rank < last")
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("sequence") + F.floor(in_slot / F.col("each"))).alias("sequence_id"),
                    (F.col("place") + in_slot % F.col("each") * F.col("length")).alias("offset")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
