"""Spelling variant groups by Bloom-guided neighbourhoods.

The vocabulary is counted in Spark and put into blocked Bloom filters, one for each word
length, that are broadcast.  Each word then generates its edits, all of them as hashes that
are updated in place, and probes the filter of the edit's length: deletions find the words
that are one letter shorter (and those find it by insertion), replacements by smaller
letters find the words of the same length (and those find it by larger ones).  Only edits
that the filter lets through are shuffled, to a join with the vocabulary that is exact.

The filters of a pass have a fixed largest size.  A vocabulary beyond it is probed in
several passes, each with other ranges of blocks; no word is left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_rows, read, shuffle_partitions
from .words import mix

QUERY = "op13_spelling_variants"
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: One in so many (document, run) hashes deletes a letter of the run.
NOISE = 97
#: A form's count is at least so many times its word's.
FORM_RATIO = 2

#: Words of this length or more share one filter.
LAST_SHARD = 48
BLOCK_BITS = 512
BITS_PER_WORD = 16
PROBES = 6
#: Blocks of a filter segment that one task builds; bytes of all filters of one pass.
SEGMENT = 1024
PASS_BYTES = 64 << 20
#: Distinct words that a task holds before it hands them on; edits hashed at a time.
FLUSH = 200_000
CHUNK = 1 << 20

#: What a lower-cased run consists of, as Latin-1 bytes, ascending.
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint8)
_SMALLER = np.searchsorted(LETTERS, np.arange(256)).astype(np.int64)
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if c in LETTERS else 32 for c in range(256))

_rng = np.random.default_rng(20250713)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = np.uint64(pow(_BASE, -1, 2**64))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """The words of a text, as Latin-1 bytes, with their counts: its letter runs with A-Z
    lower-cased, of which those chosen by the hash of (doc_id, run) lose a letter."""
    runs = Counter((text or "").encode("latin-1", "replace").translate(_RUNS).split())
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % NOISE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


class Spelled:
    """The hashes of a batch of words and of their edits."""

    def __init__(self, words: list[bytes]):
        self.length = np.array([len(w) for w in words], np.int64)
        self.letter = np.frombuffer(b"".join(words), np.uint8)
        self.owner = np.repeat(np.arange(len(words)), self.length)
        start = np.cumsum(self.length) - self.length
        self.place = np.arange(len(self.letter)) - start[self.owner]
        power = np.full(int(self.length.max(initial=0)) + 1, _BASE, np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)[self.place]
        self.term = _VALUE[self.letter] * self.power
        running = np.cumsum(self.term)
        self.before = running - self.term - (running[start] - self.term[start])[self.owner]
        self.sum = np.add.reduceat(self.term, start) if len(words) else np.zeros(0, np.uint64)

    @staticmethod
    def final(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return mix(sums + lengths.astype(np.uint64) * _LENGTH)

    def words(self) -> np.ndarray:
        return self.final(self.sum, self.length)

    def edits(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(index of the word, hash of the edit, its length) of all distinct deletions and of
        all replacements by a smaller letter, in bounded chunks."""
        same = np.zeros(len(self.letter), bool)  # a run of equal letters gives one deletion
        same[1:] = (self.letter[1:] == self.letter[:-1]) & (self.place[1:] > 0)
        for at in range(0, len(self.letter), CHUNK):
            here = np.flatnonzero(~same[at:at + CHUNK]) + at
            who = self.owner[here]
            behind = self.sum[who] - self.before[here] - self.term[here]
            yield who, self.final(self.before[here] + behind * _UNBASE, self.length[who] - 1), self.length[who] - 1
        several = _SMALLER[self.letter]
        until = np.cumsum(several)
        at = 0
        while at < len(several):
            end = max(at + 1, int(np.searchsorted(until, until[at] - several[at] + CHUNK, "right")))
            here = np.repeat(np.arange(at, end), several[at:end])
            letter = LETTERS[np.arange(len(here)) - (until[here] - several[here] - (until[at] - several[at]))]
            who = self.owner[here]
            sums = self.sum[who] + _VALUE[letter] * self.power[here] - self.term[here]
            yield who, self.final(sums, self.length[who]), self.length[who]
            at = end


def probe_bits(hashes: np.ndarray) -> np.ndarray:
    """The bits of a hash inside its block: PROBES of 9 bits each, lowest first."""
    return mix(hashes ^ np.uint64(0x5851F42D4C957F2D))


class Filters:
    """Ranges of blocks of the length-sharded filters, end to end in one array of 64-bit
    words.  ``ranges`` has (first block, end, place in the array) by shard."""

    def __init__(self, blocks: dict[int, int], ranges: dict[int, tuple[int, int, int]], data: np.ndarray):
        self.blocks = np.zeros(LAST_SHARD + 1, np.uint64)
        self.first, self.end, self.at = (np.zeros(LAST_SHARD + 1, np.int64) for _ in range(3))
        for shard, (first, end, at) in ranges.items():
            self.blocks[shard] = blocks[shard]
            self.first[shard], self.end[shard], self.at[shard] = first, end, at
        self.data = data

    def passes(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be words of that length, in the blocks held here."""
        shard = np.minimum(lengths, LAST_SHARD)
        block = (((hashes >> np.uint64(32)) * self.blocks[shard]) >> np.uint64(32)).astype(np.int64)
        ok = np.flatnonzero((block >= self.first[shard]) & (block < self.end[shard]))
        shard, block = shard[ok], block[ok]
        row = (block - self.first[shard] + self.at[shard]) * (BLOCK_BITS // 64)
        bits = probe_bits(hashes[ok])
        for j in range(PROBES):
            bit = (bits >> np.uint64(9 * j)) & np.uint64(BLOCK_BITS - 1)
            word = self.data[row + (bit >> np.uint64(6)).astype(np.int64)]
            hit = ((word >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
            ok, row, bits = ok[hit], row[hit], bits[hit]
        return ok


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n, length, h) of all words of LEAST_COUNT occurrences or more."""
    spark = docs.sparkSession

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flushed():
            words = [w.decode("latin-1") for w in total]
            out = pa.RecordBatch.from_pydict({"word": words, "n": pa.array(total.values(), pa.int64())})
            total.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                total.update(words_of(i, text.as_py()))
                if len(total) >= FLUSH:
                    yield flushed()
        if total:
            yield flushed()

    counts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, spark.createDataFrame([], "word string, n bigint").schema)
    counts = counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)

    def make():
        def work(words, n):
            spelled = Spelled([w.encode("latin-1") for w in words])
            return [words, n, pa.array(spelled.length), pa.array(spelled.words().view(np.int64))]
        return work

    return map_rows(counts, ["word", "n"], make, "word string, n bigint, length bigint, h bigint")


def filter_segments(vocab: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """(shard, segment, bits): the filters of the vocabulary, built segment by segment."""
    spark = vocab.sparkSession
    shard = F.least(F.col("length"), F.lit(LAST_SHARD)).cast("int")
    many = F.element_at(F.create_map(*[F.lit(x) for s, n in blocks.items() for x in (s, n)]), shard)
    rows = vocab.select(shard.alias("shard"), "h", F.shiftright(F.shiftrightunsigned("h", 32) * many, 32).alias("block"))
    rows = rows.withColumn("segment", F.floor(F.col("block") / SEGMENT).cast("int"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            shards, hashes, block, segment = (batch.column(i).to_numpy() for i in range(4))
            group = shards.astype(np.int64) << 32 | segment
            for key in np.unique(group).tolist():
                ok = np.flatnonzero(group == key)
                held = built.setdefault((key >> 32, key & 0xFFFFFFFF), np.zeros(SEGMENT * BLOCK_BITS, bool))
                bits, row = probe_bits(hashes[ok].view(np.uint64)), (block[ok] % SEGMENT) * BLOCK_BITS
                for j in range(PROBES):
                    held[row + ((bits >> np.uint64(9 * j)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)] = True
        if built:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in built], pa.int32()), pa.array([k[1] for k in built], pa.int32()),
                 pa.array([np.packbits(v, bitorder="little").tobytes() for v in built.values()], pa.binary())],
                names=["shard", "segment", "bits"])

    return rows.repartition(shuffle_partitions(spark), "shard", "segment").mapInArrow(
        run, spark.createDataFrame([], "shard int, segment int, bits binary").schema)


def filter_passes(blocks: dict[int, int], pass_bytes: int) -> list[list[tuple[int, int]]]:
    """The (shard, segment) pairs of each pass."""
    out, size = [], 0
    most = max(1, pass_bytes // (SEGMENT * BLOCK_BITS // 8))
    for shard, n in sorted(blocks.items()):
        for segment in range(-(-n // SEGMENT)):
            if size % most == 0:
                out.append([])
            out[-1].append((shard, segment))
            size += 1
    return out


def likely_pairs(vocab: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(h, other): hashes of the words and of their edits that the filters let through."""
    spark = vocab.sparkSession
    shard = F.least(F.col("length"), F.lit(LAST_SHARD)).cast("int")
    blocks = {r["shard"]: -(-r["count"] * BITS_PER_WORD // BLOCK_BITS)
              for r in vocab.groupBy(shard.alias("shard")).count().collect()}  # LAST_SHARD rows at most
    if not blocks:
        return vocab.select("h", F.col("h").alias("other"))
    segments = kept(filter_segments(vocab, blocks), "filters")
    out = None
    for held in filter_passes(blocks, pass_bytes):
        first = {s: min(g for t, g in held if t == s) * SEGMENT for s, _ in held}
        end = {s: min(blocks[s], (max(g for t, g in held if t == s) + 1) * SEGMENT) for s, _ in held}
        at, ranges = 0, {}
        for s in first:
            ranges[s] = (first[s], end[s], at)
            at += -(-(end[s] - first[s]) // SEGMENT) * SEGMENT
        data = np.zeros(at * (BLOCK_BITS // 64), np.uint64)
        key = F.col("shard") * F.lit(1 << 31) + F.col("segment")
        low, high = (s * (1 << 31) + g for s, g in (held[0], held[-1]))
        for row in segments.where(key.between(low, high)).toLocalIterator():
            place = (ranges[row["shard"]][2] + row["segment"] * SEGMENT - ranges[row["shard"]][0]) * (BLOCK_BITS // 64)
            bits = np.frombuffer(row["bits"], np.uint64)
            data[place:place + len(bits)] = bits
        pairs = _probed(vocab, spark.sparkContext.broadcast(Filters(blocks, ranges, data)))
        out = pairs if out is None else out.union(pairs)
    return out


def _probed(vocab: DataFrame, filters) -> DataFrame:
    def make():
        held = filters.value

        def work(words):
            spelled = Spelled([w.encode("latin-1") for w in words])
            own = spelled.words().view(np.int64)
            source, other = [], []
            for who, hashes, lengths in spelled.edits():
                ok = held.passes(hashes, lengths)
                source.append(own[who[ok]])
                other.append(hashes[ok].view(np.int64))
            return [pa.array(np.concatenate(source)), pa.array(np.concatenate(other))]
        return work

    return map_rows(vocab, ["word"], make, "h bigint, other bigint")


def near_words(vocab: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, n, other, m): all pairs of words at one insertion, deletion or replacement,
    each once."""
    pairs = likely_pairs(vocab, pass_bytes).distinct()
    right = vocab.select(F.col("h").alias("other"), F.col("word").alias("w"), F.col("n").alias("m"))
    return (pairs.join(right, "other").join(vocab.select("h", "word", "n"), "h")
            .where(F.levenshtein("word", "w", 1) == 1).select("word", "n", F.col("w").alias("other"), "m"))


def spelling_variants(docs: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per word of the vocabulary: word, form (its most frequent near word, of
    ``FORM_RATIO`` times its count or more; the smaller word on ties), root (the last word
    that the forms lead to, the word itself without one), n, n_near and form_n.

    Null and empty texts have no words; a null doc_id is hashed as an empty one; rows that
    repeat count as often as they stand.  An empty table gives an empty result; other
    columns of ``docs`` are not read.
    """
    vocab = kept(vocabulary(docs), "vocabulary")
    near = kept(near_words(vocab, pass_bytes), "near")
    both = near.union(near.select("other", "m", "word", "n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    stats = kept(vocab.select("word", "n").join(best, "word", "left").withColumn(
        "has", -F.col("best.m") >= FORM_RATIO * F.col("n")).select(
        "word", F.when(F.col("has"), F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), -F.col("best.m")).alias("form_n")), "forms")
    roots = _roots(stats.where("form is not null").select("word", F.col("form").alias("root")))
    return stats.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """The ends of the chains word -> root, by doubling: the counts at least double along a
    chain, so that it has no circle and few steps."""
    links = kept(links, "roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = kept(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if step.where("next is not null").isEmpty():
            return links
        links = step.select("word", "root")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


SQL = r"""
with recursive
bit(i, c, k) as (select i, i, 0 from range(256) r(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bit where k < 8),
crc as (select list(c order by i) as tab from bit where k = 8),
r as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\x{00C0}-\x{00FF}]+')) as run from documents),
q as (select doc_id, run, count(*) as c, hex(encode(doc_id || ':' || run)) as x from r where length(run) >= 5 group by all),
b as (select run, c, list_transform(range(0, length(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint)) as bytes from q),
h as (select run, c, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), bytes),
        lambda a, y: xor(tab[(xor(a, y) & 255) + 1], a >> 8))) as h from b, crc),
v as (select word, cast(sum(c) as bigint) as n from (select c, case when h % 97 = 0
        then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from h)
      where length(word) >= 5 group by word having sum(c) >= 3),
cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
        from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
one as (select a.word, b.word as other, b.n as m from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
        union select a.word, b.word, b.n from cut a join v b on a.rest = b.word
        union select b.word, a.word, a.n from cut a join v b on a.rest = b.word),
best as (select word, count(*) as n_near, min(struct_pack(m := -m, other := other)) as top from one group by word),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when -top.m >= 2 * v.n then top.other end as form,
        case when -top.m >= 2 * v.n then -top.m end as form_n from v left join best using (word)),
w(word, root, d) as (select word, word, 0 from f union all select w.word, f.form, d + 1 from w join f on w.root = f.word where f.form is not null)
select f.word, form, e.root, n, n_near, form_n
from f join (select word, arg_max(root, d) as root from w group by word) e on e.word = f.word
"""
