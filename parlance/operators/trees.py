"""Boosted trees for labelled rows that a worker holds: every fit is one task, the fits run side by side.

The search over settings needs some ninety fits of hundreds of trees. Spark's own trees need a
job per level of every tree, so each fit here is a task of its own: the labelled rows, at most
``MAX_TRAINING_ROWS`` of them, go to the workers once, and a task grows the trees of one
setting on one fold from histograms. More rows are never cut to that number: ``spread_trees``
grows the same trees on all of them, where they lie. Draws that differ in the number of trees
alone are one fit, scored after each of the numbers asked for. Scoring is a column expression over
rows of any number.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows that a task and the driver hold at most; training on more goes to ``spread_trees``.
MAX_TRAINING_ROWS = 100_000
#: Bins of a feature; edges are quantiles where it has more values.
BINS = 32
#: Answers of cuts that scoring holds at a time.
CUT_CELLS = 1 << 22
#: Least sum of second derivatives in a leaf.
LEAST_HESSIAN = 1.0
DEFAULTS = {
    "n_estimators": 100, "max_depth": 6, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0,
    "gamma": 0.0, "reg_alpha": 0.0, "reg_lambda": 1.0,
}
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double"


def bin_edges(values: np.ndarray) -> np.ndarray:
    """Inner edges of a feature's bins; a value goes left of an edge if it is not above it."""
    known = np.unique(values)
    if len(known) > BINS:
        known = np.unique(np.quantile(values, np.arange(1, BINS) / BINS, method="lower"))
        return known
    return known[:-1]


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of every value; columns lie one after another, as the histograms read them."""
    return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]).astype(np.int64).T


def _shrunk(total: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(total) * np.maximum(np.abs(total) - alpha, 0.0)


def _quality(g: np.ndarray, h: np.ndarray, alpha: float, penalty: float) -> np.ndarray:
    return _shrunk(g, alpha) ** 2 / (h + penalty)


@dataclass
class Tree:
    """Nodes as arrays; a leaf has the feature -1 and its own number as both children."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


def histograms(
    codes: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, place: np.ndarray, n: int, columns: np.ndarray
) -> list[np.ndarray]:
    """Sums of both derivatives by node, column and bin; ``place`` is the node of each row."""
    out = np.empty((2, n, len(columns), BINS))
    first, parts = place * BINS, (g[rows], h[rows])
    for k, f in enumerate(columns.tolist()):
        cell = codes[:, f][rows] + first
        for sums, x in zip(out, parts):
            sums[:, k] = np.bincount(cell, x, n * BINS).reshape(n, BINS)
    return list(out)


class Growth:
    """A tree while it grows by levels, from the sums of both derivatives in its open nodes."""

    def __init__(self, columns: np.ndarray, setting: Mapping, totals: tuple[float, float]):
        self.columns, self.setting = columns, setting
        self.feature, self.bins, self.left, self.right, self.totals = [-1], [0], [0], [0], [totals]
        self.open = [0]

    def split(self, sums: Sequence[np.ndarray]) -> np.ndarray:
        """Split the open nodes where it gains; the places of those that were. Their children are open then."""
        alpha, penalty = self.setting["reg_alpha"], self.setting["reg_lambda"]
        gl, hl = (s.cumsum(axis=2)[:, :, :-1] for s in sums)
        gt, ht = (s[:, :1].sum(axis=2, keepdims=True) for s in sums)
        gain = _quality(gl, hl, alpha, penalty) + _quality(gt - gl, ht - hl, alpha, penalty) - _quality(gt, ht, alpha, penalty)
        gain = np.where((hl >= LEAST_HESSIAN) & (ht - hl >= LEAST_HESSIAN), gain / 2, -np.inf).reshape(len(self.open), -1)
        best = gain.argmax(axis=1)
        split = np.flatnonzero(gain[np.arange(len(self.open)), best] > self.setting["gamma"] + 1e-12)
        fresh = []
        for k in split.tolist():
            f, b = divmod(int(best[k]), BINS - 1)
            parent, low = self.open[k], (gl[k, f, b], hl[k, f, b])
            self.feature[parent], self.bins[parent] = int(self.columns[f]), b
            self.left[parent], self.right[parent] = len(self.feature), len(self.feature) + 1
            for child in (low, (gt[k, 0, 0] - low[0], ht[k, 0, 0] - low[1])):
                fresh.append(len(self.feature))
                self.feature.append(-1)
                self.bins.append(0)
                self.left.append(fresh[-1])
                self.right.append(fresh[-1])
                self.totals.append(child)
        self.open = fresh
        return split

    def places(self, split: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Per node its place among the children that are summed: of each pair the first, or the ``second``."""
        place = np.full(len(self.feature), -1)
        place[np.array(self.open).reshape(-1, 2)[np.arange(len(split)), second]] = np.arange(len(split))
        return place

    def tree(self) -> Tree:
        sums_g, sums_h = np.array(self.totals).T
        values = -_shrunk(sums_g, self.setting["reg_alpha"]) / (sums_h + self.setting["reg_lambda"]) * self.setting["learning_rate"]
        feature = np.array(self.feature)
        return Tree(feature, np.array(self.bins), np.array(self.left), np.array(self.right), np.where(feature < 0, values, 0.0))


def with_siblings(sums: Sequence[np.ndarray], parts: Sequence[np.ndarray], split: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """Sums of all children from those of one of each pair: the other is what is left of the parent."""
    both = []
    for whole, part in zip(sums, parts):
        pair = np.empty((len(split), 2, *part.shape[1:]))
        pair[np.arange(len(split)), second] = part
        pair[np.arange(len(split)), 1 - second] = whole[split] - part
        both.append(pair.reshape(-1, *part.shape[1:]))
    return both


def grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray, setting: Mapping) -> tuple[Tree, np.ndarray]:
    """One tree by levels from histograms of the derivatives; and the leaf of every row.

    Rows with no weight in ``g`` and ``h`` do not count but are led to their leaf.
    """
    counted = (g != 0) | (h != 0)
    growth = Growth(columns, setting, (g.sum(), h.sum()))
    node = np.zeros(len(codes), np.int64)
    rows = np.flatnonzero(counted)
    sums = histograms(codes, g, h, rows, np.zeros(len(rows), np.int64), 1, columns)
    for depth in range(setting["max_depth"]):
        split = growth.split(sums)
        if not len(split):
            break
        parents = np.array(growth.feature)[node]
        moved = np.flatnonzero(parents >= 0)
        at = node[moved]
        goes = codes[moved, parents[moved]] <= np.array(growth.bins)[at]
        node[moved] = np.where(goes, np.array(growth.left)[at], np.array(growth.right)[at])
        if depth + 1 < setting["max_depth"]:  # of two children the smaller one is summed
            rows_of = np.bincount(node, minlength=len(growth.feature))[growth.open].reshape(-1, 2)
            second = (rows_of[:, 1] < rows_of[:, 0]).astype(np.int64)
            place = growth.places(split, second)
            rows = np.flatnonzero((place[node] >= 0) & counted)
            sums = with_siblings(sums, histograms(codes, g, h, rows, place[node[rows]], len(split), columns), split, second)
    return growth.tree(), node


def boost(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, setting: Mapping, seed: Sequence[int]) -> Iterator[tuple[Tree, np.ndarray]]:
    """Trees one after another, each with the leaf of every row, on the logistic loss."""
    rng = np.random.default_rng(list(seed))
    margin = np.zeros(len(y))
    wanted = max(1, int(codes.shape[1] * setting["colsample_bytree"]))
    while True:
        p = 1.0 / (1.0 + np.exp(-margin))
        counted = weight * (rng.random(len(y)) < setting["subsample"]) if setting["subsample"] < 1 else weight
        columns = np.sort(rng.choice(codes.shape[1], wanted, replace=False))
        tree, leaf = grow(codes, (p - y) * counted, p * (1 - p) * counted, columns, setting)
        margin = margin + tree.value[leaf]
        yield tree, leaf


def leaves(tree: Tree, codes: np.ndarray) -> np.ndarray:
    """The leaf of every row of a table that the tree was not grown on."""
    node = np.zeros(len(codes), np.int64)
    rows = np.arange(len(codes))
    while (inner := tree.feature[node] >= 0).any():
        goes = codes[rows, np.maximum(tree.feature[node], 0)] <= tree.bin[node]
        node = np.where(inner, np.where(goes, tree.left[node], tree.right[node]), node)
    return node


def exact_auc(y: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve; equal scores count half. Not a number with one class only."""
    _, rank, count = np.unique(score, return_inverse=True, return_counts=True)
    middle = np.cumsum(count) - (count - 1) / 2
    n_pos = int(y.sum())
    n_neg = len(y) - n_pos
    return float((middle[rank][y == 1].sum() - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg)) if n_pos and n_neg else float("nan")


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model: nodes of all trees, numbered through, and the first of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    n_features: int

    @cached_property
    def _steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The nodes renumbered level by level, so that a right child follows its left one.

        Distinct cuts (feature and threshold), and per node its cut, left child and value; then
        root and depth of every tree. A leaf has the cut after the last one, which holds for no
        row, and itself as its child.
        """
        order, root, depth = [], [], []
        for first in self.roots.tolist():
            root.append(len(order))
            level, deep = np.array([first]), 0
            order.append(level[0])
            while len(level := level[self.feature[level] >= 0]):
                level, deep = np.stack([self.left[level], self.right[level]], axis=1).ravel(), deep + 1
                order.extend(level.tolist())
            depth.append(deep)
        order = np.array(order, np.int64)
        inner = self.feature[order] >= 0
        child = np.arange(len(order))
        # In this order the pairs of children come as their parents do, tree by tree.
        tree = np.repeat(np.arange(len(root)), np.diff([*root, len(order)]))
        child[inner] = 2 * np.arange(inner.sum()) + 1 + tree[inner]
        cuts = np.stack([self.feature[order[inner]].astype(float), self.threshold[order[inner]]])
        known, mine = np.unique(cuts, axis=1, return_inverse=True)
        cut = np.full(len(order), known.shape[1])
        cut[inner] = mine.ravel()
        return known[0].astype(np.int64), known[1], cut, child, self.value[order], np.array(root), np.array(depth)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sums of the leaves, tree after tree: every distinct cut is tried once, the trees look it up."""
        features, thresholds, cut, child, value, roots, depths = self._steps
        total = np.zeros(len(x))
        step = max(256, CUT_CELLS // (len(features) + 1))
        for start in range(0, len(x), step):
            some = np.ascontiguousarray(x[start : start + step].T)
            n = some.shape[1]
            above = np.zeros((len(features) + 1, n), bool)
            for row, f, threshold in zip(above, features.tolist(), thresholds.tolist()):
                np.less_equal(some[f], threshold, out=row)
            np.logical_not(above[:-1], out=above[:-1])
            above, offset, rows = above.ravel(), cut * n, np.arange(n)
            node, at, goes, gain = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, bool), np.empty(n)
            for root, depth in zip(roots.tolist(), depths.tolist()):
                node.fill(root)
                for _ in range(depth):  # all numbers are in range; "clip" spares a copy
                    np.add(offset.take(node, out=at, mode="clip"), rows, out=at)
                    above.take(at, out=goes, mode="clip")
                    np.add(child.take(node, out=at, mode="clip"), goes, out=node)
                total[start : start + n] += value.take(node, out=gain, mode="clip")
        return total

    def proba(self, spark: SparkSession, vector: Column) -> Column:
        """Probability of class 1 from an array of the features; null where there is none."""
        held, size = spark.sparkContext.broadcast(self), self.n_features

        @F.arrow_udf("double")
        def score(vectors: pa.Array) -> pa.Array:
            known = vectors.is_valid().to_numpy(zero_copy_only=False)
            x = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
            out = np.full(len(vectors), np.nan)
            out[known] = 1.0 / (1.0 + np.exp(-held.value.margins(x)))
            return pa.array(out, mask=~known)

        return score(vector)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per node, to be written out and read by :func:`from_rows`."""
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), "right") - 1
        columns = (tree, np.arange(len(tree)), self.feature, self.threshold, self.left, self.right, self.value)
        return spark.createDataFrame(list(zip(*(c.tolist() for c in columns))), NODES)


def from_rows(rows: Sequence, n_features: int) -> BoostedTrees:
    rows = sorted(rows, key=lambda r: r.node)
    column = lambda name, kind: np.array([getattr(r, name) for r in rows], kind)
    tree = column("tree", np.int64)
    roots = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
    return BoostedTrees(
        column("feature", np.int64), column("threshold", float), column("left", np.int64), column("right", np.int64),
        column("value", float), roots, n_features,
    )


@dataclass(frozen=True)
class Sample:
    """The labelled rows of a search as arrays."""

    x: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    fold: np.ndarray


def early(data: DataFrame, key: str) -> Column:
    """Holds for the first ``MAX_TRAINING_ROWS`` rows by the hash of their keys, and for few others.

    The rows are counted by the leading bits of the hash, so none of them moves.
    """
    bucket = F.shiftright(F.xxhash64(key), 48)
    total = 0
    for r in sorted(data.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()):
        total += r.n
        if total >= MAX_TRAINING_ROWS:
            return bucket <= r.bucket
    return F.lit(True)


def gathered(data: DataFrame, key: str, folds: DataFrame | None = None) -> Sample:
    """``(key, vector, y, weight, fold)`` on the driver: at most ``MAX_TRAINING_ROWS`` rows, in key order.

    The folds may come as a table of their own, ``(key, y, fold)``, with the same keys as the
    rows. Then both are put in the same order and no row with its vector is joined.
    """
    dealt = data if folds is None else folds
    wanted = early(dealt, key)

    def first(df: DataFrame, *then: str) -> DataFrame:
        return df.where(wanted).orderBy(F.xxhash64(key), F.col(key), *then).limit(MAX_TRAINING_ROWS)

    rows = first(data, "y", "vector").select("vector", "y", "weight", *([] if folds is not None else ["fold"])).toArrow()
    size = len(rows["vector"][0]) if len(rows) else 0
    x = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    if folds is not None:
        rows = rows.append_column("fold", first(folds, "y", "fold").select("fold").toArrow()["fold"])
    y, weight, fold = (rows[c].to_numpy() for c in ("y", "weight", "fold"))
    return Sample(x, y.astype(np.int64), weight.astype(float), fold.astype(np.int64))


def _cross_fit(held, n_folds: int, seed: int):
    """Task function: one setting on one fold, scored after every number of trees asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, groups = held.value
        for batch in batches:
            for number in batch.column("id").to_pylist():
                group, fold = divmod(number, n_folds)
                setting, counts = groups[group]
                seen = sample.fold != fold
                edges = [bin_edges(c) for c in sample.x[seen].T]
                codes, rest = (binned(sample.x[m], edges) for m in (seen, ~seen))
                margin, out = np.zeros(len(rest)), []
                fits = boost(codes, sample.y[seen], sample.weight[seen], setting, (seed, group, fold))
                for n in range(1, max(counts) + 1):
                    tree, _ = next(fits)
                    margin += tree.value[leaves(tree, rest)]
                    if n in counts:
                        out.append((group, n, exact_auc(sample.y[~seen], margin)))
                yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["part", "trees", "auc"])

    return run


def setting_groups(settings: Sequence[Mapping]) -> tuple[list[tuple[dict, list[int]]], list[list[int]]]:
    """Settings that differ in the number of trees alone, as one with its numbers; and which they are."""
    full = [{**DEFAULTS, **s} for s in settings]
    shared: dict[tuple, list[int]] = {}
    for i, s in enumerate(full):
        shared.setdefault(tuple(sorted((k, v) for k, v in s.items() if k != "n_estimators")), []).append(i)
    groups = [(full[mine[0]], sorted({full[i]["n_estimators"] for i in mine})) for mine in shared.values()]
    return groups, list(shared.values())


def of_settings(settings: Sequence[Mapping], members: Sequence[Sequence[int]], aucs: Mapping[tuple[int, int], float]) -> list[float]:
    """The AUC of every setting from those by group and number of trees."""
    out = [0.0] * len(settings)
    for g, mine in enumerate(members):
        for i in mine:
            out[i] = aucs[g, {**DEFAULTS, **settings[i]}["n_estimators"]]
    return out


def cross_validate(spark: SparkSession, sample: Sample, settings: Sequence[Mapping], n_folds: int, seed: int) -> list[float]:
    """Mean AUC over the folds of every setting, one task per fit."""
    groups, members = setting_groups(settings)
    held = spark.sparkContext.broadcast((sample, groups))
    # The longest fits start first, so that none of them is left to a few cores at the end.
    work = [max(counts) * s["max_depth"] * (1 + s["colsample_bytree"] * s["subsample"]) for s, counts in groups]
    fits = [g * n_folds + k for g in sorted(range(len(groups)), key=lambda g: -work[g]) for k in range(n_folds)]
    numbers = spark.sparkContext.parallelize([(i,) for i in fits], len(fits)).toDF("id long")
    done = numbers.mapInArrow(_cross_fit(held, n_folds, seed), "part long, trees long, auc double")
    aucs = {(r.part, r.trees): r.auc for r in done.groupBy("part", "trees").agg(F.avg("auc").alias("auc")).collect()}
    return of_settings(settings, members, aucs)


def _refit(held, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, setting = held.value
        for batch in batches:
            if not len(batch):
                continue
            edges = [bin_edges(c) for c in sample.x.T]
            fits = boost(binned(sample.x, edges), sample.y, sample.weight, setting, (seed,))
            first = 0
            for number in range(setting["n_estimators"]):
                tree, _ = next(fits)
                cuts = [edges[f][b] if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bin)]
                columns = (
                    np.full(len(cuts), number, np.int32), np.arange(first, first + len(cuts), dtype=np.int32), tree.feature.astype(np.int32),
                    np.array(cuts), (tree.left + first).astype(np.int32), (tree.right + first).astype(np.int32), tree.value,
                )
                yield pa.record_batch([pa.array(c) for c in columns], names=[c.split()[0] for c in NODES.split(", ")])
                first += len(cuts)

    return run


def refit(spark: SparkSession, sample: Sample, setting: Mapping, seed: int) -> BoostedTrees:
    """The model of one setting on the whole sample."""
    held = spark.sparkContext.broadcast((sample, {**DEFAULTS, **setting}))
    rows = spark.range(0, 1, 1, 1).mapInArrow(_refit(held, seed), NODES).collect()
    return from_rows(rows, sample.x.shape[1])
