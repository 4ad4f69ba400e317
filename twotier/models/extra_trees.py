"""Extremely randomised trees (CLF9): whole-sample trees with random cut points.

All trees grow level by level.  A level is two passes over the rows: the range of every
feature in each open node, then the class counts on both sides of each node's candidate cuts.
A task routes its rows through all trees in numpy and hands on one partial result per
node, which Spark groups.  A node's candidates are the features with the smallest hashes of
(seed, tree, node, feature), and each cut is drawn uniformly in the node's range by the same
hash, so a forest depends on neither partitioning nor retries.  There is no bootstrap.

Only nodes reach the driver (trees x 2^depth at most); rows never shuffle.  Nodes stand in
heap order: the children of i are 2i and 2i+1.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash, uniform_from_hash
from ..session import held

# the tasks' functions go to the executors by value: a cluster needs no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_NODES = 4_000_000


@dataclass
class ExtraTrees:
    features: list[str]
    #: Per tree and heap index: feature (-1 in a leaf), cut, share of the positive class, and whether it is to be cut.
    feature: np.ndarray
    cut: np.ndarray
    share: np.ndarray
    open: np.ndarray
    depth: int = 0
    seed: int = 42

    @classmethod
    def roots(cls, features: list[str], trees: int, depth: int, share: float, seed: int) -> ExtraTrees:
        shape = (trees, 2 ** (depth + 1))
        is_open = np.zeros(shape, bool)
        is_open[:, 1] = True
        return cls(features, np.full(shape, -1, np.int32), np.zeros(shape), np.full(shape, share), is_open, 0, seed)

    def nodes(self, tree: int, X: np.ndarray) -> np.ndarray:
        """The heap index of the node that each row of X reaches; a missing value goes right."""
        at, start, flat = np.ones(len(X), np.int64), np.arange(0, X.size, X.shape[1]), np.ascontiguousarray(X).ravel()
        inner, feature, cut = self.feature[tree] >= 0, np.maximum(self.feature[tree], 0).astype(np.int64), self.cut[tree]
        for _ in range(self.depth):
            right = ~(flat.take(start + feature.take(at)) <= cut.take(at))
            at = np.where(inner.take(at), 2 * at + right, at)
        return at

    def level(self, tree: int, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The place in the deepest level that each row comes to; ``flat`` holds the rows' values,
        ``start`` where each begins.  Rows of a leaf above go on to places without an open node."""
        at = np.zeros(len(start), np.int64)
        for l in range(self.depth):
            nodes = slice(2 ** l, 2 ** (l + 1))
            feature = np.maximum(self.feature[tree, nodes], 0).astype(np.int64)
            x = flat.take(feature.take(at) + start)
            at += at
            at += ~(x <= self.cut[tree, nodes].take(at >> 1))
        return at

    def probability(self, df: DataFrame, out: str = "p_extra") -> DataFrame:
        """Adds the mean positive share over the trees."""
        model = self

        def mean_share(*columns: pa.Array) -> pa.Array:
            X = _matrix(columns)
            total = np.zeros(len(X))
            for t in range(len(model.feature)):
                total += model.share[t][model.nodes(t, X)]
            return pa.array(total / len(model.feature))

        return df.withColumn(out, F.arrow_udf(mean_share, "double")(*[F.col(c).cast("double") for c in self.features]))


def _matrix(columns: Iterable[pa.Array]) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])


def training_rows(train: DataFrame, features: list[str], y: str) -> DataFrame:
    return train.where(F.col(y).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in features], F.col(y).cast("int").alias("_y"))


def node_ranges(rows: DataFrame, model: ExtraTrees) -> DataFrame:
    """(tree, node, feature, lo, hi) of every feature that varies in its open node."""
    schema = rows.sparkSession.createDataFrame([], "tree int, node int, feature int, lo double, hi double").schema
    d = len(model.features)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the open nodes are those of one level: a dense array of each bound
        trees, first = len(model.feature), 2 ** model.depth
        low, high = (np.full((d, trees, first), np.nan) for _ in range(2))
        for batch in batches:
            X = _matrix(batch.columns[:d])
            columns, start, flat = np.ascontiguousarray(X.T), np.arange(0, X.size, d), X.ravel()
            for t in range(trees):
                at = model.level(t, flat, start)
                use = np.flatnonzero(model.open[t, first:2 * first].take(at))
                if not len(use):
                    continue
                place = at[use].astype(np.int16 if first <= 2 ** 15 else np.int64)
                order = np.argsort(place, kind="stable")
                place, use = place[order].astype(np.int64), use[order]
                starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                ids = place[starts]
                for j in range(d):
                    x = columns[j].take(use)
                    low[j, t, ids] = np.fmin(low[j, t, ids], np.fmin.reduceat(x, starts))
                    high[j, t, ids] = np.fmax(high[j, t, ids], np.fmax.reduceat(x, starts))
        f, t, i = np.nonzero(~np.isnan(low))
        if len(f):
            yield pa.RecordBatch.from_arrays(
                [pa.array(t, pa.int32()), pa.array(first + i, pa.int32()), pa.array(f, pa.int32()),
                 pa.array(low[f, t, i]), pa.array(high[f, t, i])], names=schema.names)

    return (rows.mapInArrow(run, schema).groupBy("tree", "node", "feature")
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi"))


def candidates(ranges: DataFrame, names: list[str], per_node: int, seed: int) -> DataFrame:
    """(tree, node, cuts): the cuts (feature, cut) of the ``per_node`` features of smallest hash."""
    name = F.array(*[F.lit(n) for n in names])[F.col("feature")]
    hashed = ranges.withColumn("h", seeded_hash(F.concat_ws(":", "tree", "node", name), seed))
    cut = F.col("lo") + uniform_from_hash(F.col("h"), 8) * (F.col("hi") - F.col("lo"))
    cuts = F.array_sort(F.collect_list(F.struct("h", "feature", cut.alias("cut"))))  # one entry a feature
    return hashed.groupBy("tree", "node").agg(F.slice(cuts, 1, per_node).alias("cuts"))


def cut_counts(rows: DataFrame, model: ExtraTrees, cuts: DataFrame, per_node: int) -> DataFrame:
    """(tree, node, feature, cut, n, pos, left_n, left_pos) of every candidate cut."""
    shape = (per_node, *model.feature.shape)
    feature, cut, d = np.full(shape, -1, np.int32), np.zeros(shape), len(model.features)
    for r in cuts.toLocalIterator():  # the open nodes of one level
        for k, c in enumerate(r["cuts"]):
            feature[k, r["tree"], r["node"]], cut[k, r["tree"], r["node"]] = c["feature"], c["cut"]
    schema = rows.sparkSession.createDataFrame(
        [], "tree int, node int, feature int, cut double, n bigint, pos bigint, left_n bigint, left_pos bigint").schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, first = feature.shape[1], 2 ** model.depth
        own, cuts = (a[:, :, first:2 * first] for a in (feature, cut))  # the open nodes are those of one level
        used = np.maximum(own, 0).astype(np.int64)
        sums = np.zeros((trees, per_node, first, 2, 2), np.int64)  # by side (left: 1) and class
        for batch in batches:
            X, y = _matrix(batch.columns[:d]), batch.column(d).to_numpy().astype(np.int64)
            start, flat = np.arange(0, X.size, d), X.ravel()
            for t in range(trees):
                at = model.level(t, flat, start)
                code = 4 * at + y
                for k in range(per_node):
                    left = flat.take(start + used[k, t].take(at)) <= cuts[k, t].take(at)
                    sums[t, k] += np.bincount(code + 2 * left, minlength=4 * first).reshape(first, 2, 2)
        t, k, i = np.nonzero((own.transpose(1, 0, 2) >= 0) & (sums.sum(axis=(3, 4)) > 0))
        if len(t):
            v = sums[t, k, i]
            yield pa.RecordBatch.from_arrays(
                [pa.array(t, pa.int32()), pa.array(first + i, pa.int32()), pa.array(own[k, t, i], pa.int32()), pa.array(cuts[k, t, i]),
                 *[pa.array(n, pa.int64()) for n in (v.sum(axis=(1, 2)), v[:, :, 1].sum(axis=1), v[:, 1].sum(axis=1), v[:, 1, 1])]],
                names=schema.names)

    names = ["n", "pos", "left_n", "left_pos"]
    return rows.mapInArrow(run, schema).groupBy("tree", "node", "feature", "cut").agg(*[F.sum(c).alias(c) for c in names])


def impurity_drop() -> Column:
    """The fall of the Gini impurity, weighted by rows, that a cut brings."""
    def gini(n: Column, pos: Column) -> Column:
        return F.when(n > 0, 2.0 * pos * (n - pos) / n).otherwise(0.0)

    n, pos, ln, lp = (F.col(c).cast("double") for c in ("n", "pos", "left_n", "left_pos"))
    return gini(n, pos) - gini(ln, lp) - gini(n - ln, pos - lp)


def fit_extra_trees(train: DataFrame, features: list[str], y: str, trees: int = 100, depth: int = 8,
                    per_node: int | None = None, min_leaf: int = 1, seed: int = 42) -> ExtraTrees:
    """The forest of a training table; ``per_node`` candidate features (the root of their
    number by default).  Nodes end that are pure, that no cut improves, or at ``depth``."""
    if trees * 2 ** (depth + 1) > MAX_NODES:
        raise ValueError(f"{trees} trees of depth {depth} have more than {MAX_NODES} nodes")
    per_node = per_node or max(1, round(len(features) ** 0.5))
    with held(training_rows(train, features, y)) as rows:
        return _grown(rows, features, trees, depth, per_node, min_leaf, seed)


def _grown(rows: DataFrame, features: list[str], trees: int, depth: int, per_node: int, min_leaf: int, seed: int) -> ExtraTrees:
    model = ExtraTrees.roots(features, trees, depth, float(rows.agg(F.avg("_y")).first()[0] or 0.0), seed)
    for level in range(depth):
        cuts = candidates(node_ranges(rows, model), features, per_node, seed)
        counted = cut_counts(rows, model, cuts, per_node).withColumn("drop", impurity_drop())
        fits = (F.col("left_n") >= min_leaf) & (F.col("n") - F.col("left_n") >= min_leaf) & (F.col("drop") > 0)
        best = counted.where(fits).groupBy("tree", "node").agg(F.max(F.struct(
            "drop", (-F.col("feature")).alias("order"), "cut", "n", "pos", "left_n", "left_pos")).alias("b"))
        model.open[:] = False
        for r in best.toLocalIterator():  # the nodes of one level
            t, i, b = r["tree"], r["node"], r["b"]
            model.feature[t, i], model.cut[t, i] = -b["order"], b["cut"]
            right = b["n"] - b["left_n"], b["pos"] - b["left_pos"]
            for child, (n, pos) in ((2 * i, (b["left_n"], b["left_pos"])), (2 * i + 1, right)):
                model.share[t, child] = pos / n
                model.open[t, child] = 0 < pos < n
        model.depth = level + 1
        if not model.open.any():
            break
    return model
