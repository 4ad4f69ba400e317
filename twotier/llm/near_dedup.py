"""MinHash near-duplicates with odd sketches.

Each shingle set gets 512 MinHash values.  Bands of four of the first 128 find the
candidate pairs (a pair of similarity 0.75 shares no band with probability
5e-6); an odd sketch, the parity bitmap of all values, rejects candidates whose
estimated similarity is well below the threshold; the others are confirmed on
their full shingle sets.

Large groups never become all their pairs.  Equal sets are one class from the
start.  In each band bucket every member is first compared with the smallest
one; buckets whose members are then still in different components compare the
minority with a pivot of the largest component; only what is open after that is
compared pair by pair, in blocks of bounded size inside the tasks, across components
only, past the sketch and each pair once: a task puts out links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_rows, read, shuffle_partitions
from .words import MinHash, jaccard_counts, mix, shingle_set

QUERY = "op9_near_dedup"
BANDS = 32
BAND_ROWS = 4
SAMPLES = 512
SKETCH_BITS = 1024
#: A pair goes on to the exact check if its sketch estimates a similarity of the
#: threshold less this: about five standard deviations of the estimate.
SKETCH_SLACK = 0.11

#: Members of a bucket that one task compares with as many others at a time.
BLOCK = 512

SIGNATURES = ("doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, "
              + ", ".join(f"s{i} bigint" for i in range(SKETCH_BITS // 64)))
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of the signature; equal rows, equal key."""
    rows = signature.reshape(bands, -1).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for j in range(rows.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key


def odd_sketch(signature: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap: each (position, minimum) flips one bit.  Words of 64 bits."""
    at = np.arange(len(signature), dtype=np.uint64) << np.uint64(32)
    bit = mix(at + signature.astype(np.uint64)) % np.uint64(bits)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=bits) & 1).view(np.uint64)


def sketch_similarity(differing_bits: Column, bits: int = SKETCH_BITS, samples: int = SAMPLES) -> Column:
    """Similarity estimated from the population count of the XOR of two sketches:
    d differing bits come from about -bits/2 * ln(1 - 2d/bits) differing samples."""
    odd = F.greatest(F.lit(1e-9), 1 - 2 * differing_bits / F.lit(float(bits)))
    return 1 + F.log(odd) * (bits / (4.0 * samples))


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set, the same for equal sets."""
    n = np.uint64(len(shingles))
    a = mix(np.array([mix(shingles).sum() + n]))[0]
    b = mix(np.array([mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum() ^ n]))[0]
    return int(a.view(np.int64)), int(b.view(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, set size, set key, band keys and odd sketch of each text; keys and
    bands are null for a text without words or with a null id."""
    def make():
        family = MinHash(SAMPLES)

        def work(ids, texts):
            rows = []
            for i, text in zip(ids, texts):
                s = shingle_set(text)
                if not len(s) or i is None:
                    rows.append((i, len(s), None, None, None, *[None] * len(SKETCH)))
                    continue
                sig = family.signature(s)
                rows.append((i, len(s), *set_keys(s), band_keys(sig[:BANDS * BAND_ROWS]).view(np.int64),
                             *odd_sketch(sig).view(np.int64).tolist()))
            return list(zip(*rows)) if rows else [[]]
        return work

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id", "text"], make,
                    SIGNATURES)


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >=
    percent * union.  ``texts`` has cid and text."""
    both = (pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b"))

    def make():
        def work(a, b, text_a, text_b):
            out, last, last_set = [], None, None
            for i, j, x, y in zip(a, b, text_a, text_b):
                if last_set is None or y != last:  # rows come sorted by b
                    last, last_set = y, shingle_set(y)
                n, union = jaccard_counts(shingle_set(x), last_set)
                if union and 100 * n >= percent * union:
                    out.append((i, j))
            return [[r[0] for r in out], [r[1] for r in out]]
        return work

    return map_rows(both, ["a", "b", "text_a", "text_b"], make, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the edges (a, b), by
    alternating large-star and small-star steps until nothing changes."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, digest = kept(edges, "edges"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.hash("v", "u"))).first()
        if tuple(now) == digest or not now[0]:
            break
        digest = tuple(now)
        around = edges.union(edges.select("v", "u"))
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(small.union(low.select("u", "m")).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest
    doc_id reachable over links, itself included) and kept (doc_id is that one).

    Null or empty texts and texts of white space only have no shingles and no
    links.  A row with a null doc_id has no links either, a null component_id and
    kept true.  Rows that repeat a doc_id are one document with the links of all
    of them.  Ties do not arise: the smallest id of a component stays.  An empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    sigs = kept(signatures(docs), "signatures")
    classes = kept(sigs.where("k1 is not null").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("cid"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
        *[F.first(s).alias(s) for s in SKETCH]), "classes")
    sketches = classes.select("cid", "n", *SKETCH)

    banded = classes.select("cid", F.posexplode("bands").alias("pos", "band"))
    buckets = banded.groupBy("band").agg(F.min("cid").alias("rep"), F.count("*").alias("members")).where("members > 1")
    members = kept(banded.join(buckets, "band"), "members")
    wanted = members.select(F.col("cid").alias("doc_id")).distinct()
    texts = kept(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
                 .join(wanted, "doc_id", "left_semi").withColumnRenamed("doc_id", "cid"), "texts")

    edges = [_shared_ids(sigs, classes)]

    def labelled(links: DataFrame) -> DataFrame:
        edges.append(kept(links, "links"))
        out = edges[0]
        for more in edges[1:]:
            out = out.union(more)
        return kept(components(out), "labels")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        return verified(kept(_likely(pairs, sketches, percent), "pairs"), texts, percent)

    labels = labelled(confirmed(members.where("cid != rep").select(F.col("cid").alias("a"), F.col("rep").alias("b"))))
    labels = labelled(confirmed(_pivot_pairs(_open_members(members, labels))))
    labels = labelled(_cross_links(_open_members(members, labels), classes, texts, percent))

    named = classes.select("k1", "k2", "cid").join(labels, F.col("cid") == F.col("node"), "left").select(
        "k1", "k2", F.coalesce("label", "cid").alias("component_id"))
    linked = sigs.select("doc_id", "n_shingles", "k1", "k2").where("k1 is not null").join(named, ["k1", "k2"])
    alone = sigs.where("k1 is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")]
    return linked.select(*columns).union(alone.select(*columns))


def _shared_ids(sigs: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of rows that have one doc_id and different sets."""
    several = sigs.where("k1 is not null").groupBy("doc_id").agg(
        F.min("k1").alias("x"), F.max("k1").alias("y")).where("x != y").select("doc_id")
    own = (sigs.join(several, "doc_id", "left_semi").select("doc_id", "k1", "k2")
           .join(classes.select("k1", "k2", "cid"), ["k1", "k2"]))
    return own.select(F.col("doc_id").alias("a"), F.col("cid").alias("b"))


def _sketch_passes(left: str, right: str, percent: int) -> Column:
    """The odd-sketch test and the bound that set sizes put on the similarity."""
    bits = sum((F.bit_count(F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))) for s in SKETCH), F.lit(0))
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    return ((100 * F.least(n, m) >= percent * F.greatest(n, m))
            & (sketch_similarity(bits) >= percent / 100 - SKETCH_SLACK))


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    return (pairs.join(sketches.alias("x"), F.col("a") == F.col("x.cid"))
            .join(sketches.alias("y"), F.col("b") == F.col("y.cid"))
            .where(_sketch_passes("x", "y", percent)).select("a", "b").distinct())


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets of three or more that still hold several components
    (a bucket of two has had its only pair tested)."""
    named = members.where("members > 2").join(labels, F.col("cid") == F.col("node"), "left").select(
        "band", "pos", "members", "cid", F.coalesce("label", "cid").alias("label"))
    several = named.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y")
    return kept(named.join(several.select("band"), "band", "left_semi"), "open")


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """Each member outside the bucket's largest component, with one member of it
    that the hash of (bucket, member) picks: another one in each band."""
    sizes = members.groupBy("band", "label").agg(
        F.count("*").alias("size"), F.min_by("cid", F.xxhash64("band", "cid")).alias("pivot"))
    top = sizes.groupBy("band").agg(F.max(F.struct("size", "label", "pivot")).alias("top"))
    return (members.join(top, "band").where("label != top.label")
            .select(F.col("cid").alias("a"), F.col("top.pivot").alias("b")))


def _cross_links(members: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The links between members of a bucket that are in two components.  A first pass
    over sketches finds the members that may have one, a second one over their texts
    confirms it."""
    full = members.join(classes.select("cid", "n", "bands", *SKETCH), "cid")
    maybe = kept(_blocks(full, percent, confirm=False), "maybe").distinct()
    near = full.join(maybe.select(F.col("a").alias("cid"), F.col("b").alias("band")), ["cid", "band"], "left_semi")
    return _blocks(near.join(texts, "cid"), percent, confirm=True)


def _blocks(members: DataFrame, percent: int, confirm: bool) -> DataFrame:
    """Compares the members of each bucket across components, each pair of blocks in a
    group of its own.  Gives links (a, b) with ``confirm``, else (member, bucket) of the
    members that have a likely partner."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = members.withColumn("own", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).select(
        "band", "low", "high", "own", "pos", "cid", "label", "n", "bands", *SKETCH, *(["text"] if confirm else []))
    cut = percent / 100 - SKETCH_SLACK
    schema = members.sparkSession.createDataFrame([], "a bigint, b bigint").schema

    def compare(group: pa.Table) -> list[tuple[int, int]]:
        col = {c: group.column(c).to_numpy() for c in ("cid", "label", "n", "own")}
        band, pos = group.column("band")[0].as_py(), group.column("pos")[0].as_py()
        mixed = group.column("low")[0].as_py() != group.column("high")[0].as_py()
        sketch = np.column_stack([group.column(s).to_numpy() for s in SKETCH]).view(np.uint64)
        bands = np.array(group.column("bands").combine_chunks().flatten()).reshape(len(sketch), -1)
        sets, out = {}, []
        for i in range(len(sketch) - 1):
            rest = slice(i + 1, None)
            ok = col["label"][rest] != col["label"][i]
            if mixed:
                ok &= col["own"][rest] != col["own"][i]
            ok &= 100 * np.minimum(col["n"][rest], col["n"][i]) >= percent * np.maximum(col["n"][rest], col["n"][i])
            at = np.flatnonzero(ok) + i + 1
            if len(at):
                bits = np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1)
                odd = np.maximum(1e-9, 1 - 2 * bits / SKETCH_BITS)
                at = at[1 + np.log(odd) * (SKETCH_BITS / (4.0 * SAMPLES)) >= cut]
            if len(at) and pos:  # a pair belongs to the first band that it shares
                at = at[~(bands[at, :pos] == bands[i, :pos]).any(axis=1)]
            for j in at.tolist():
                if not confirm:
                    out += [(int(col["cid"][i]), band), (int(col["cid"][j]), band)]
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = shingle_set(group.column("text")[k].as_py())
                both, union = jaccard_counts(sets[i], sets[j])
                if union and 100 * both >= percent * union:
                    out.append((int(col["cid"][i]), int(col["cid"][j])))
        return list(set(out))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["band", "low", "high"]):
            found = compare(group) if group.num_rows > 1 else []
            if found:
                yield pa.RecordBatch.from_pydict({"a": [f[0] for f in found], "b": [f[1] for f in found]})

    parts = shuffle_partitions(members.sparkSession)
    return (rows.repartition(parts, "band", "low", "high").sortWithinPartitions("band", "low", "high")
            .mapInArrow(run, schema))


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows of equal ``keys`` in sorted batches; only the last run is held."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        change = np.zeros(max(table.num_rows - 1, 0), bool)
        for k in keys:
            values = table.column(k).to_numpy()
            change |= values[1:] != values[:-1]
        start = 0
        for end in (np.flatnonzero(change) + 1).tolist():
            yield table.slice(start, end - start)
            start = end
        held = table.slice(start)
    if held is not None and held.num_rows:
        yield held


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


SQL = r"""
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then []
        when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
p as (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id
      group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(doc_id, root) as (select doc_id, doc_id from documents union select r.doc_id, p.b from r join p on r.root = p.a)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from s join (select doc_id, min(root) as component_id from r group by doc_id) c using (doc_id)
"""
