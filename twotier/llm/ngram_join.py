"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are the distinct shingle sets, columns the shingles.  Size-derived bounds
cut the product.  Sets of n shingles that link share at least s of their first
n - ceil(0.85 n) + s columns, in any order of the columns that all rows follow; the order is
by a count of each column's rows (a table of fixed size, so rare columns come first), then by
hash, and s grows with n.  So only those entries, only columns of two rows or more, and
only rows with enough of these columns are multiplied.

Equal sets are one row from the start, and columns of equal members one column.  A row of a
column of more than a block is first multiplied with the representative (a column's smallest
row) that shares most of its columns, then with such a pivot of a larger component.  What
is still in different components goes to the product in blocks of rows: column ranges are
multiplied one after the other, overlap counts accumulate, and pairs whose count plus all they
have left stays below what their sizes need are dropped.  A pair is multiplied in the largest
open column of its rows if they agree on it, or rows that columns connect are blocked as one
where that ships fewer rows.  A block puts out the links of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, map_rows, read, shuffle_partitions
from .near_dedup import components, set_keys
from .words import shingle_hashes, word_hashes

QUERY = "op12_ngram_join"
SHINGLE = 4
PERCENT = 85
#: Sets that link share one of their first columns, and one more for each so many shingles.
SHARED_EACH = 32
#: Counters of the column counts, as a power of two, and how many of them a row carries.
COUNTER_BITS = 22
COUNTER_ROW = 4096
#: Rows that one task multiplies with one representative.
STAR = 4096
#: Rows on each side of a block, and columns that are multiplied at a time.
BLOCK = 512
COLUMNS = 2048
#: Rows fetched by a broadcast of their ids; more are fetched by a shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles that a task gathers before it counts them.
COUNT_AT = 2_000_000


def shingle_row(text: str | None) -> np.ndarray:
    """The columns of a text's row, ascending: its distinct shingle hashes."""
    return np.unique(shingle_hashes(word_hashes(text), SHINGLE))


def least_overlap(n, m, percent: int = PERCENT):
    """The smallest overlap that links sets of n and m shingles."""
    return -(-percent * (n + m) // (100 + percent))


def least_shared(n: int) -> int:
    """How many of their first columns sets link by: at least so many where the smaller has
    n shingles."""
    return 1 + n // SHARED_EACH


def first_columns(n: int, percent: int = PERCENT) -> int:
    """How many of the first columns of a set of n shingles are kept."""
    return min(n, n - (-(-percent * n // 100)) + least_shared(n))


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, k1, k2) of the texts' set sizes and keys, and rows (part, counts)
    of the tasks' column counts."""
    spark = docs.sparkSession
    schema = spark.createDataFrame([], "doc_id bigint, n bigint, k1 bigint, k2 bigint, part int, counts binary").schema
    columns = ["doc_id", "n", "k1", "k2", "part", "counts"]
    types = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
    bits, width = COUNTER_BITS, COUNTER_ROW

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = None, [], 0

        def add():
            nonlocal counts
            new = np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
            counts = new if counts is None else counts + new
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    row = shingle_row(text)
                    rows.append((i, len(row), *(set_keys(row) if len(row) and i is not None else (None, None)), None, None))
                    if len(row):
                        held.append((row >> np.uint64(64 - bits)).astype(np.int32))
                        size += len(row)
                    if size >= COUNT_AT:
                        add()
                        size = 0
                yield _batch(rows, columns, types)
        if held:
            add()
        if counts is not None:
            for at in range(0, len(counts), width * 64):
                rows = []
                for j in range(at, min(at + width * 64, len(counts)), width):
                    if counts[j:j + width].any():
                        rows.append((None, None, None, None, j // width, counts[j:j + width].tobytes()))
                if rows:
                    yield _batch(rows, columns, types)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def _batch(rows: list[tuple], columns: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=columns)


def column_classes(scanned: DataFrame) -> np.ndarray:
    """The place of each counter in the order of columns: the quarter powers of two of its
    count, one byte each.  4 MB reach the driver whatever the input's size."""
    spark = scanned.sparkSession

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(counts, np.uint32).astype(np.uint64)
                sums[part] = sums[part] + values if part in sums else values
        if sums:
            classes = [np.minimum(255, 4 * np.log2(v + 1.0)).astype(np.uint8).tobytes() for v in sums.values()]
            yield _batch(list(zip(sums, classes)), ["part", "classes"], [pa.int32(), pa.binary()])

    schema = spark.createDataFrame([], "part int, classes binary").schema
    tables = (scanned.where("part is not null").select("part", "counts")
              .repartition(shuffle_partitions(spark), "part").mapInArrow(run, schema))
    out = np.zeros(1 << COUNTER_BITS, np.uint8)
    for row in tables.toLocalIterator():
        out[row["part"] * COUNTER_ROW:(row["part"] + 1) * COUNTER_ROW] = np.frombuffer(row["classes"], np.uint8)
    return out


def entries(docs: DataFrame, classes: np.ndarray, percent: int) -> DataFrame:
    """The entries (col, k1) of the matrix that the size bound leaves: the first columns of
    each set in the common order."""
    shift = np.uint64(64 - COUNTER_BITS)

    def make():
        def work(ids, texts):
            cols, keys = [], []
            for i, text in zip(ids, texts):
                row = shingle_row(text)
                if not len(row) or i is None:
                    continue
                first = first_columns(len(row), percent)
                place = (classes[row >> shift].astype(np.uint64) << np.uint64(56)) | (row >> np.uint64(8))
                cols.append(row[np.argsort(place, kind="stable")[:first]])
                keys.append(np.full(first, set_keys(row)[0], np.int64))
            if not cols:
                return [[], []]
            return [pa.array(np.concatenate(cols).view(np.int64)), pa.array(np.concatenate(keys))]
        return work

    return map_rows(docs, ["doc_id", "text"], make, "col bigint, k1 bigint")


def shared_entries(matrix: DataFrame) -> DataFrame:
    """The distinct entries of the columns of two rows or more.  The entries go to their
    columns once, and are not written before: they are most of what the join moves."""
    column = Window.partitionBy("col")
    several = matrix.withColumns({"x": F.min("k1").over(column), "y": F.max("k1").over(column)}).where("x != y")
    return several.select("col", "k1").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray, percent: int) -> np.ndarray:
    """The product of two blocks of rows, as a boolean matrix: which of the ``wanted`` pairs
    link.  Columns go in ranges; after each, pairs whose overlap so far plus the smaller
    rest of their rows is below the bound of their sizes are given up."""
    sizes = [np.array([len(r) for r in side], np.int64) for side in (left, right)]
    need = least_overlap(sizes[0][:, None], sizes[1][None, :], percent)
    alive = wanted & (np.minimum(sizes[0][:, None], sizes[1][None, :]) >= need)
    count = np.zeros(alive.shape, np.float32)
    if not alive.any():
        return alive
    flat = [np.concatenate(side) for side in (left, right)]
    shared = np.intersect1d(flat[0], flat[1])
    place, owner = [], []
    for side, values in zip((left, right), flat):
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1) if len(shared) else np.zeros(0, np.int64)
        ok = shared[at] == values if len(shared) else np.zeros(0, bool)
        who = np.repeat(np.arange(len(side)), [len(r) for r in side])
        place.append(at[ok])
        owner.append(who[ok] if len(shared) else who[:0])
    rest = [np.bincount(o, minlength=len(side)) for o, side in zip(owner, (left, right))]
    for start in range(0, len(shared), COLUMNS):
        alive &= count + np.minimum(rest[0][:, None], rest[1][None, :]) >= need
        if not alive.any():
            return alive
        blocks = []
        for s in (0, 1):
            ok = (place[s] >= start) & (place[s] < start + COLUMNS)
            block = np.zeros((len(rest[s]), min(COLUMNS, len(shared) - start)), np.float32)
            block[owner[s][ok], place[s][ok] - start] = 1
            rest[s] = rest[s] - np.bincount(owner[s][ok], minlength=len(rest[s]))
            blocks.append(block)
        count += blocks[0] @ blocks[1].T
    return alive & (count >= need)


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Of the links between rows and columns of a matrix those that connect as much as all
    do: fewer than it has rows and columns."""
    out, rows, columns = [], np.ones(links.shape[0], bool), np.ones(links.shape[1], bool)
    for first in np.flatnonzero(links.any(axis=1)).tolist():
        if not rows[first]:
            continue
        rows[first], todo = False, [(True, first)]
        while todo:
            is_row, i = todo.pop()
            new = np.flatnonzero(links[i] & columns) if is_row else np.flatnonzero(links[:, i] & rows)
            (columns if is_row else rows)[new] = False
            out += [(i, j) if is_row else (j, i) for j in new.tolist()]
            todo += [(not is_row, j) for j in new.tolist()]
    return out


def linked_sets(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id (the smallest doc_id
    reachable over links of 100 * overlap >= percent * union, itself included).

    Null or empty texts and texts of white space only have no shingles and no links.  A row
    with a null doc_id has no links either and a null component_id.  Rows that repeat a
    doc_id are one document with the links of all of them.  Ties do not arise.  An empty
    table gives an empty result; other columns of ``docs`` are not read.  Shingles are
    compared by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scanned = kept(scan(docs), "scan")
    sizes = scanned.where("part is null").select("doc_id", "n", "k1", "k2")
    sets = kept(sizes.where("k1 is not null").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("cid"), F.first("n").alias("n")), "sets")

    members = kept(shared_entries(entries(docs, column_classes(scanned), percent)), "members")
    members = _different_columns(members, "k1")
    members = kept(members.join(sets.select("k1", "cid", "n"), "k1").select("col", "weight", "cid", "n"), "members")
    members = kept(_enough_shared(members, "cid", percent), "members")
    rows = _rows(docs, members.select("cid").distinct(), sizes)
    edges = [kept(_repeated_ids(sizes, sets), "links")]

    def labelled(*links: DataFrame) -> DataFrame:
        edges.extend(kept(more, "links") for more in links)
        out = edges[0]
        for more in edges[1:]:
            out = out.union(more)
        return kept(components(out), "labels")

    labels = labelled()
    large = members.groupBy("col").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("col")
    large = kept(members.join(large, "col", "left_semi"), "large")
    if not large.isEmpty():  # smaller columns are one block
        labels = labelled(_multiply(_representatives(large, percent), rows, percent))
        labels = labelled(_multiply(_pivots(_open(large, labels, percent), percent), rows, percent))
    labels = labelled(_blocks(_homes(_open(members, labels, percent)), rows, percent))

    named = sets.select("k1", "k2", "cid").join(labels, F.col("cid") == F.col("node"), "left").select(
        "k1", "k2", F.coalesce("label", "cid").alias("component_id"))
    linked = sizes.where("k1 is not null").join(named, ["k1", "k2"])
    alone = sizes.where("k1 is null").withColumn("component_id", F.col("doc_id"))
    out = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return linked.select(*out).union(alone.select(*out))


def _different_columns(members: DataFrame, of: str) -> DataFrame:
    """Of columns with the same members (``of``) the smallest one, with their number as its weight."""
    sets = members.groupBy("col").agg(F.count("*").alias("size"), F.sum(F.xxhash64(of) % (1 << 40)).alias("x"),
                                      F.bit_xor(F.xxhash64(F.lit(7), of)).alias("y"))
    one = sets.groupBy("size", "x", "y").agg(F.min("col").alias("col"), F.count("*").alias("weight"))
    return members.drop("weight").join(one.select("col", "weight"), "col")


def _enough_shared(members: DataFrame, of: str, percent: int) -> DataFrame:
    """The members that can link: those in as many columns that hold two values of ``of`` or
    more as the smallest set that they may link with needs."""
    smallest = F.ceil(F.min("n") * percent / 100)
    for _ in range(2):  # each round leaves fewer; any number of them loses no link
        several = members.groupBy("col").agg(F.min(of).alias("x"), F.max(of).alias("y")).where("x != y").select("col")
        members = members.join(several, "col", "left_semi")
        able = members.groupBy("cid").agg(F.sum("weight").alias("shared"), (1 + F.floor(smallest / SHARED_EACH)).alias("need"))
        members = kept(members.join(able.where("shared >= need").select("cid"), "cid", "left_semi"), "able")
    several = members.groupBy("col").agg(F.min(of).alias("x"), F.max(of).alias("y")).where("x != y").select("col")
    return members.join(several, "col", "left_semi")


def _sent(ids: DataFrame) -> DataFrame:
    """A written table of ids, broadcast if its size is small, else left to a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _rows(docs: DataFrame, wanted: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cid, row): the distinct matrix rows of the wanted documents that have columns.  Only
    ids that ``sizes`` has several times can repeat a row, so only their rows are shuffled."""
    def make():
        return lambda ids, again, texts: [ids, again, [shingle_row(t).tobytes() for t in texts]]

    wanted = wanted.withColumnRenamed("cid", "doc_id")
    wanted = kept(sizes.join(_sent(kept(wanted, "wanted")), "doc_id", "left_semi").groupBy("doc_id").agg(
        (F.count("*") > 1).alias("again")), "wanted")
    found = map_rows(docs.join(_sent(wanted), "doc_id"), ["doc_id", "again", "text"], make,
                     "cid bigint, again boolean, row binary")
    found = kept(found.where(F.octet_length("row") > 0), "rows")
    repeated = kept(found.where("again").select("cid", "row").distinct(), "rows")
    return found.where("not again").select("cid", "row").union(repeated)


def _repeated_ids(sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges between the sets of rows that have one doc_id and different texts."""
    several = sizes.where("k1 is not null").groupBy("doc_id").agg(
        F.min("k1").alias("x"), F.max("k1").alias("y")).where("x != y").select("doc_id")
    own = sizes.join(several, "doc_id", "left_semi").join(sets.select("k1", "k2", "cid"), ["k1", "k2"])
    return own.select(F.col("doc_id").alias("a"), F.col("cid").alias("b"))


def _multiply(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (a, b): the rows of one b, a column vector of the product, come
    to one place, in shares of bounded size that each have b's own row first."""
    pairs = kept(pairs, "pairs")
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).alias("shares"))
    own = shares.select("b", F.col("b").alias("cid"), F.explode(F.sequence(F.lit(0), F.col("shares").cast("int") - 1)).alias("share"),
                        F.lit(0).alias("leaf"))
    leaves = pairs.join(shares, "b").select("b", F.col("a").alias("cid"), F.pmod(F.xxhash64("a"), "shares").cast("int").alias("share"),
                                            F.lit(1).alias("leaf"))
    both = rows.join(_sent(kept(own.union(leaves), "stars")), "cid").select("b", "share", "leaf", "cid", "row")
    schema = rows.sparkSession.createDataFrame([], "a bigint, b bigint").schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, right = None, []
        for batch in batches:
            b, share, leaf, cid = (batch.column(i).to_pylist() for i in range(4))
            row = [np.frombuffer(r, np.uint64) for r in batch.column(4).to_pylist()]
            out, start = [], 0
            while start < len(b):
                end = start + 1
                while end < len(b) and (b[end], share[end]) == (b[start], share[start]):
                    end += 1
                if (b[start], share[start]) != now:
                    now, right = (b[start], share[start]), []
                while start < end and not leaf[start]:
                    right.append(row[start])
                    start += 1
                if start < end:
                    n = np.array([len(r) for r in row[start:end]])
                    flat, begin = np.concatenate(row[start:end]), np.cumsum(n) - n
                    for r in right:
                        at = np.minimum(np.searchsorted(r, flat), len(r) - 1)
                        count = np.add.reduceat((r[at] == flat).astype(np.int64), begin)
                        out += [(cid[start + i], b[start]) for i in np.flatnonzero(count >= least_overlap(n, len(r), percent)).tolist()]
                start = end
            if out:
                yield pa.RecordBatch.from_pydict({"a": [o[0] for o in out], "b": [o[1] for o in out]})

    return (both.repartition(shuffle_partitions(rows.sparkSession), "b", "share")
            .sortWithinPartitions("b", "share", "leaf").mapInArrow(run, schema))


def _representatives(members: DataFrame, percent: int) -> DataFrame:
    """Each member with the smallest member of its columns that it shares most columns with."""
    reps = members.groupBy("col").agg(F.min(F.struct("cid", "n")).alias("rep"))
    return _most_shared(members.join(reps, "col"), percent)


def _pivots(members: DataFrame, percent: int) -> DataFrame:
    """Each member outside the largest components of its columns with that pivot of one that
    it shares most columns with; a pivot is the member of the smallest hash."""
    sizes = members.groupBy("col", "label").agg(
        F.count("*").alias("size"), F.min_by(F.struct("cid", "n"), F.xxhash64("cid")).alias("rep"))
    top = sizes.groupBy("col").agg(F.max(F.struct("size", "label", "rep")).alias("top"))
    return _most_shared(members.join(top, "col").where("label != top.label").withColumn("rep", F.col("top.rep")), percent)


def _most_shared(members: DataFrame, percent: int) -> DataFrame:
    """One pair (a, b) for each member a: of the ``rep``s that sizes allow the one of most columns."""
    possible = 100 * F.least("n", "rep.n") >= percent * F.greatest("n", "rep.n")
    pairs = members.where((F.col("cid") != F.col("rep.cid")) & possible).groupBy("cid", F.col("rep.cid").alias("b")).agg(
        F.sum("weight").alias("shared"))
    best = pairs.groupBy("cid").agg(F.min(F.struct((-F.col("shared")).alias("most"), "b")).alias("best"))
    return best.select(F.col("cid").alias("a"), F.col("best.b").alias("b"))


def _open(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Members that may have links to another component, in the columns that still hold
    several components."""
    named = members.join(labels, F.col("cid") == F.col("node"), "left").select(
        "col", "weight", "cid", "n", F.coalesce("label", "cid").alias("label"))
    return kept(_enough_shared(kept(named, "named"), "label", percent), "open")


def _homes(members: DataFrame) -> DataFrame:
    """Members of the columns that differ, with the largest column of each as its home."""
    still = kept(_different_columns(members, "cid"), "columns")
    sizes = still.groupBy("col").agg(F.count("*").alias("members"))
    first = still.join(sizes, "col").groupBy("cid").agg(F.max(F.struct("members", "col")).alias("top"))
    return kept(still.join(first.select("cid", F.col("top.col").alias("home")), "cid"), "homes")


def _cheaper(members: DataFrame) -> DataFrame:
    """Members with the sides and blocks that they stand in: column by column, or, where this
    ships fewer rows, all members that are connected by columns as one column."""
    stars = members.groupBy("col").agg(F.min("cid").alias("b"))
    groups = kept(components(members.join(stars, "col").select(F.col("cid").alias("a"), "b")), "groups")
    groups = groups.select("node", F.col("label").alias("connected"))
    members = kept(members.join(groups, F.col("cid") == F.col("node"), "left").select(
        "col", "cid", "label", "home", F.coalesce("connected", "cid").alias("connected")), "connected")

    def blocks(count: str):
        return F.ceil(F.col(count) / BLOCK).cast("int")

    homes = members.groupBy("connected", "col", "home").agg(F.count("*").alias("size"))
    columns = homes.groupBy("connected", "col").agg(
        F.sum("size").alias("rights"), F.max(F.when(F.col("col") != F.col("home"), F.struct("size", "home"))).alias("most"))
    columns = columns.withColumn("lefts", F.col("rights") - F.coalesce("most.size", F.lit(0))).where("lefts > 0").withColumns({
        "right_blocks": blocks("rights"), "left_blocks": blocks("lefts")})
    shipped = columns.groupBy("connected").agg(F.sum(
        F.when(F.col("lefts") == F.col("rights"), F.col("rights") * F.col("right_blocks"))
        .otherwise(F.col("rights") * F.col("left_blocks") + F.col("lefts") * F.col("right_blocks"))).alias("by_column"))
    whole = members.select("connected", "cid", "label").distinct()
    sizes = whole.groupBy("connected").agg(F.count("*").alias("size")).withColumn("by_group", F.col("size") * blocks("size"))
    plan = kept(shipped.join(sizes, "connected").withColumn("one", F.col("by_group") <= F.col("by_column")), "plan")
    each = members.join(columns.join(plan.where("not one").select("connected"), "connected", "left_semi").drop("connected"), "col").select(
        "col", "cid", "label", "home", "lefts", "rights", "left_blocks", "right_blocks",
        (~F.coalesce(F.col("home") == F.col("most.home"), F.lit(False))).alias("both"))
    joined = whole.join(plan.where("one").select("connected", "size"), "connected").select(
        F.col("connected").alias("col"), "cid", "label", F.col("connected").alias("home"), F.col("size").alias("lefts"),
        F.col("size").alias("rights"), blocks("size").alias("left_blocks"), blocks("size").alias("right_blocks"),
        F.lit(True).alias("both"))
    return kept(each.union(joined), "sides")


def _blocks(members: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The product of what is open, block by block.  Two members of a column are multiplied
    in their common home column, or here if their homes differ.  So in a column the members
    of the most frequent other home need no product with each other: they stand on the right
    side only, and the others on both."""
    sides = _cheaper(members)

    def dealt(df: DataFrame, side: int, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("cid"), F.col(f"{own}_blocks")).cast("int")
        all_others = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        return df.withColumn(own, mine).withColumn(other, all_others).select(
            "col", "left", "right", F.lit(side).alias("side"), "cid", "label", "home")

    # where all members stand on both sides, blocks meet once and a block meets itself in one copy
    same = dealt(sides.where("lefts = rights"), 0, "left", "right").select(
        "col", F.least("left", "right").alias("l"), F.greatest("left", "right").alias("r"),
        F.when(F.col("left") < F.col("right"), 0).when(F.col("left") > F.col("right"), 1).otherwise(2).alias("side"),
        "cid", "label", "home")
    other = sides.where("lefts < rights")
    both = same.union(dealt(other.where("both"), 0, "left", "right")).union(dealt(other, 1, "right", "left"))
    both = both.withColumnsRenamed({"l": "left", "r": "right"})
    both = rows.join(_sent(kept(both, "blocks")), "cid").select("col", "left", "right", "side", "cid", "label", "home", "row")
    schema = members.sparkSession.createDataFrame([], "a bigint, b bigint").schema

    def multiply(group: pa.Table) -> list[tuple[int, int]]:
        side = group.column("side").to_numpy()
        cid, label, home = (group.column(c).to_numpy() for c in ("cid", "label", "home"))
        matrix = [np.frombuffer(r, np.uint64) for r in group.column("row").to_pylist()]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            return []
        here = home == group.column("col")[0].as_py()
        wanted = label[left][:, None] != label[right][None, :]
        wanted &= (home[left][:, None] != home[right][None, :]) | here[left][:, None]
        links = overlaps([matrix[i] for i in left], [matrix[i] for i in right], wanted, percent)
        return [(int(cid[left[i]]), int(cid[right[j]])) for i, j in spanning(links)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["col", "left", "right"]):
            found = multiply(group)
            if found:
                yield pa.RecordBatch.from_pydict({"a": [f[0] for f in found], "b": [f[1] for f in found]})

    parts = shuffle_partitions(members.sparkSession)
    return (both.repartition(parts, "col", "left", "right").sortWithinPartitions("col", "left", "right")
            .mapInArrow(run, schema))


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows of equal ``keys`` in sorted batches; a run ends with its keys, so
    only one is held, in the slices that came."""
    held, last = [], None
    for batch in batches:
        values = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if start == end:
                continue
            key = tuple(values[:, start].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_sets(read(spark, sf_dir, "documents"))


SQL = r"""
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then []
        when len(ws) < 4 then [array_to_string(ws, ' ')]
        else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
p as (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id
      group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(doc_id, root) as (select doc_id, doc_id from documents union select r.doc_id, p.b from r join p on r.root = p.a)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, c.component_id
from s join (select doc_id, min(root) as component_id from r group by doc_id) c using (doc_id)
"""
