"""Boosted trees on labelled rows of any number: every fit is spread over all of them.

The rows become blocks of bins, one byte a feature, which stay where they are with the sums of
the trees so far. A level of a tree is one job: tasks sum the derivatives of their blocks by
node, feature and bin, the driver adds the sums up and chooses the cuts. All fits that have room
grow side by side, a level of each in the same job, and the rows take up a finished tree with the
first level of the next one. Bin edges are exact order statistics of all rows, and areas under the
curve come from all rows that were held out. Trees, bins and scores are those of ``trees``; with
``subsample`` the rows of a tree are drawn by the hash of their keys, not by their order.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.prefix import _bucketed_prefix
from parlance.operators.stats import stratified_folds
from parlance.operators.trees import (
    BINS,
    DEFAULTS,
    BoostedTrees,
    Growth,
    Tree,
    histograms,
    leaves,
    of_settings,
    setting_groups,
    with_siblings,
)
from parlance.session import release, stored, tidied, with_checkpoints

#: Rows of a block; rows that are sorted together for the bin edges.
BLOCK_ROWS = 16_384
#: Bytes of sums of trees that blocks carry along, and of sums that the driver takes from one job.
MARGIN_BYTES, SUM_BYTES = 2 << 30, 128 << 20
#: Parts from which on tasks add their sums up before the driver does.
MANY_PARTS = 64
#: Trees after which the blocks are written out, so that a lost one costs few trees.
KEPT_TREES = 20
#: Places at which an interval of a bin edge is tried in one pass.
PROBES = 31
#: Buckets in which the rows that were held out are ordered by their score.
SCORE_BUCKETS = 1024


@dataclass(frozen=True)
class Block:
    """Rows as bins among the edges of all folds, features first; and the sums of trees of each fit."""

    codes: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    name: np.ndarray
    margins: np.ndarray


@dataclass
class Spread:
    """All labelled rows, stored; the fold of each, by the parts of the table; bin edges."""

    rows: DataFrame
    folds: object
    n_folds: int
    n: int
    size: int
    edges: list[list[np.ndarray]]  # by fold that is left out, and of all rows

    def tables(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Edges of all sets together by feature; and per set, feature and bin among these the own bin."""
        union = [np.unique(np.concatenate([s[f][~np.isnan(s[f])] for s in self.edges])) for f in range(self.size)]
        own = np.zeros((len(self.edges), self.size, 256), np.uint8)
        for s, edges in enumerate(self.edges):
            for f, all_ in enumerate(union):
                own[s, f, 1 : len(all_) + 1] = np.searchsorted(edges[f], all_, "right")
        return union, own


# --- rows ---------------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: folds of rows with numbers that follow one another, a byte each."""
    for batch in batches:
        rows, folds = (batch.column(c).to_numpy() for c in (0, 1))
        cuts = np.flatnonzero(np.diff(rows) != 1) + 1
        if len(rows):
            parts = [p.astype(np.uint8).tobytes() for p in np.split(folds, cuts)]
            yield pa.record_batch([pa.array(rows[[0, *cuts]]), pa.array(parts, pa.binary())], names=["first", "folds"])


def _fold_table(folds: DataFrame) -> dict[int, np.ndarray]:
    """Fold of every row by the part of the table and the place in it: one byte a row."""
    runs = folds.select("_row", F.col("fold").cast("int").alias("fold")).repartitionByRange("_row").sortWithinPartitions("_row")
    parts: dict[int, list[tuple[int, bytes]]] = {}
    for r in runs.mapInArrow(_runs, "first long, folds binary").collect():
        parts.setdefault(r.first >> 33, []).append((r.first, bytes(r.folds)))
    return {p: np.frombuffer(b"".join(b for _, b in sorted(found)), np.uint8) for p, found in parts.items()}


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    vectors = batch.column("vector")
    if vectors.null_count:
        raise ValueError("a labelled row has no vector")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)


def _pieces(batches: Iterable[pa.RecordBatch], folds) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Vectors and folds of up to about ``BLOCK_ROWS`` rows, with their other columns."""

    def joined(held: list[pa.RecordBatch]):
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        rows = batch.column("_row").to_numpy()
        fold = np.empty(len(rows), np.uint8)
        for part in np.unique(rows >> 33).tolist():
            mine = rows >> 33 == part
            fold[mine] = folds.value[part][rows[mine] & ((1 << 33) - 1)]
        return _vectors(batch), fold, batch

    held, n = [], 0
    for batch in batches:
        for start in range(0, len(batch), BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            held.append(part)
            n += len(part)
            if n >= BLOCK_ROWS:
                yield joined(held)
                held, n = [], 0
    if n:
        yield joined(held)


def _summed(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], object]) -> list:
    """What ``run`` makes of the batches of each part, one object a part."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([pickle.dumps(run(batches), 5)], pa.binary())], names=["found"])

    return [pickle.loads(bytes(r.found)) for r in rows.mapInArrow(task, "found binary").collect()]


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order; both zeros are one."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _doubles(keys: np.ndarray) -> np.ndarray:
    bits = np.where(keys >> np.uint64(63) == 1, keys & np.uint64((1 << 63) - 1), ~keys)
    return np.ascontiguousarray(bits).view(float)


def _few_values(rows: DataFrame, folds, n_folds: int) -> tuple[np.ndarray, list[list[np.ndarray]], np.ndarray]:
    """Rows by fold; per fold and feature its values, or some if they are too many; whether some are not numbers."""

    def run(batches):
        n, known, gaps = np.zeros(n_folds, np.int64), None, None
        for x, fold, _ in _pieces(batches, folds):
            if known is None:
                known = [[np.empty(0)] * x.shape[1] for _ in range(n_folds)]
                gaps = np.zeros((n_folds, x.shape[1]), bool)
            n += np.bincount(fold, minlength=n_folds)
            for k in range(n_folds):
                mine = x[fold == k]
                gaps[k] |= np.isnan(mine).any(axis=0)
                for f in range(x.shape[1]):
                    if len(known[k][f]) <= BINS:
                        known[k][f] = np.unique(np.concatenate([known[k][f], mine[:, f]]))[: BINS + 1]
        return n, known, gaps

    n, known, gaps = np.zeros(n_folds, np.int64), None, None
    for some, values, holes in _summed(rows, run):
        n += some
        if values is not None:
            gaps = holes if gaps is None else gaps | holes
            known = values if known is None else [
                [np.unique(np.concatenate(p))[: BINS + 1] for p in zip(*both)] for both in zip(known, values)
            ]
    return n, known, gaps


def exact_edges(spark: SparkSession, rows: DataFrame, folds, n_folds: int) -> tuple[list[list[np.ndarray]], int]:
    """``trees.bin_edges`` of the rows outside each fold, and of all rows; and the number of rows.

    Of features with many values the edges are order statistics. Each lies in an interval that is
    cut by the counts of rows up to ``PROBES`` places in it, until one value is left.
    """
    rows = rows.coalesce(MANY_PARTS)
    n, known, gaps = _few_values(rows, folds, n_folds)
    size = len(known[0])
    inside = [[k for k in range(n_folds) if k != s] for s in range(n_folds + 1)]
    edges: list[list] = [[None] * size for _ in inside]
    many = np.zeros((len(inside), size), bool)
    for s, mine in enumerate(inside):
        for f in range(size):
            values = np.unique(np.concatenate([known[k][f] for k in mine]))
            many[s, f] = len(values) > BINS and not gaps[mine, f].any()
            edges[s][f] = np.array([np.nan]) if len(values) > BINS else values[:-1]
    total = np.array([n[mine].sum() for mine in inside])
    steps = np.arange(1, BINS) / BINS
    wanted = np.floor(steps * np.maximum(total - 1, 0)[:, None]).astype(np.int64)[:, None, :] + 1
    low = np.zeros((*many.shape, BINS - 1), np.uint64)
    high = np.where(many[..., None], np.uint64(2**64 - 1), low)
    part = np.arange(1, PROBES + 1, dtype=np.uint64)
    while (low < high).any():
        width, left = np.divmod((high - low)[..., None], np.uint64(PROBES + 1))
        places = low[..., None] + width * part + left * part // np.uint64(PROBES + 1)
        held = spark.sparkContext.broadcast((places, many))

        def run(batches):
            places, many = held.value
            counts = np.zeros(places.shape, np.int64)
            for x, fold, _ in _pieces(batches, folds):
                for f in np.flatnonzero(many.any(axis=0)).tolist():
                    for k in range(n_folds):
                        values = np.sort(ordered(x[fold == k, f]))
                        for s in np.flatnonzero(many[:, f]).tolist():
                            if k != s:
                                counts[s, f] += np.searchsorted(values, places[s, f].ravel(), "right").reshape(places[s, f].shape)
            return counts

        counts = sum(_summed(rows, run))
        enough = counts >= wanted[..., None]
        high = np.minimum(high, np.where(enough, places, np.uint64(2**64 - 1)).min(axis=-1))
        above = np.where(enough, np.uint64(0), places + np.uint64(1)).max(axis=-1)
        low = np.where(low < high, np.maximum(low, above), high)
        held.destroy()
    for s, f in zip(*np.nonzero(many)):
        edges[s][f] = np.unique(_doubles(high[s, f]))
    return edges, int(n.sum())


def spread_rows(data: DataFrame, key: str, n_folds: int, seed: int) -> Spread:
    """``(key, vector, y, weight)`` stored once, in parts that hold their rows from here on."""
    spark = data.sparkSession
    placed = data.select(
        key, F.xxhash64(key).alias("_name"), "vector", "y", "weight", F.monotonically_increasing_id().alias("_row")
    )
    table = stored(placed, "training")
    with tidied(spark):
        found = _fold_table(stratified_folds(table.select(key, "y", "_row"), n_folds, seed, key))
    folds = spark.sparkContext.broadcast(found)
    rows = table.select("vector", "y", "weight", "_row", "_name").coalesce(spark.sparkContext.defaultParallelism)
    edges, n = exact_edges(spark, rows, folds, n_folds)
    return Spread(rows, folds, n_folds, n, len(edges[0]), edges)


# --- trees --------------------------------------------------------------------------


@dataclass
class Fit:
    """One setting with one fold left out (or none: the number of folds), on the driver."""

    group: int
    fold: int
    setting: Mapping
    counts: Sequence[int]
    rng: np.random.Generator
    columns: np.ndarray | None = None
    growth: Growth | None = None
    sums: list[np.ndarray] | None = None
    split: np.ndarray | None = None
    second: np.ndarray | None = None
    trees: list[Tree] = field(default_factory=list)

    def begin(self, n_columns: int) -> None:
        wanted = max(1, int(n_columns * self.setting["colsample_bytree"]))
        self.columns = np.sort(self.rng.choice(n_columns, wanted, replace=False))
        self.growth = self.sums = None

    def asks(self) -> tuple[Tree | None, np.ndarray, int]:
        """The tree so far, the place of each node among those that are summed, and how many these are."""
        if self.growth is None:
            return None, np.zeros(1, np.int64), 1
        return self.growth.tree(), self.growth.places(self.split, self.second), len(self.split)

    def takes(self, found: Sequence[np.ndarray], depth: int) -> bool:
        """Split by the sums; whether there is a level more to sum."""
        if self.growth is None:
            self.growth, self.sums = Growth(self.columns, self.setting, tuple(s[0, 0].sum() for s in found)), list(found)
        else:
            self.sums = with_siblings(self.sums, found, self.split, self.second)
        self.split = self.growth.split(self.sums)
        if not len(self.split) or depth + 1 >= self.setting["max_depth"]:
            return False
        # Of two children the one with the lesser second derivatives is summed.
        grown = np.array([self.growth.totals[c][1] for c in self.growth.open]).reshape(-1, 2)
        self.second = (grown[:, 1] < grown[:, 0]).astype(np.int64)
        return True


def drawn(name: np.ndarray, seed: Sequence[int], share: float) -> np.ndarray:
    """Whether rows are drawn for a tree, by the hashes of their keys."""
    start = np.random.SeedSequence(list(seed)).generate_state(1, np.uint64)[0]
    z = name.view(np.uint64) ^ start
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z >> np.uint64(11)) * 2.0**-53 < share


def _own_codes(block: Block, own: np.ndarray, fold: int) -> np.ndarray:
    """Bins of a block by the edges of one set; rows by features, as the trees read them."""
    return np.stack([own[fold, f][c] for f, c in enumerate(block.codes)]).T


def _level(tables, asked: Sequence[tuple], number: int, seed: int):
    """Task function: sums of both derivatives for what each fit asks, over the blocks of a part."""

    def run(blocks: Iterator[Block]) -> Iterator[bytes]:
        own = tables.value
        total: list = [None] * len(asked)
        for block in blocks:
            codes: dict[int, np.ndarray] = {}
            for i, (at, group, fold, setting, columns, tree, place, n) in enumerate(asked):
                if fold not in codes:
                    codes[fold] = _own_codes(block, own, fold)
                p = 1.0 / (1.0 + np.exp(-block.margins[at]))
                weight = np.where(block.fold == fold, 0.0, block.weight)
                if setting["subsample"] < 1:
                    weight = weight * drawn(block.name, (seed, group, fold, number), setting["subsample"])
                g, h = (p - block.y) * weight, p * (1 - p) * weight
                node = np.zeros(len(p), np.int64) if tree is None else leaves(tree, codes[fold])
                rows = np.flatnonzero((place[node] >= 0) & ((g != 0) | (h != 0)))
                found = np.stack(histograms(codes[fold], g, h, rows, place[node[rows]], n, columns))
                total[i] = found if total[i] is None else total[i] + found
        yield pickle.dumps(total, 5)

    return run


def _added(one: bytes, other: bytes) -> bytes:
    pairs = zip(pickle.loads(one), pickle.loads(other))
    return pickle.dumps([b if a is None else a if b is None else a + b for a, b in pairs], 5)


def _grown(tables, trees: Sequence[tuple[int, int, Tree]]):
    """Task function: blocks with the leaves of finished trees added to the sums of their fits."""

    def run(block: Block) -> Block:
        codes: dict[int, np.ndarray] = {}
        margins = block.margins.copy()
        for at, fold, tree in trees:
            if fold not in codes:
                codes[fold] = _own_codes(block, tables.value, fold)
            margins[at] += tree.value[leaves(tree, codes[fold])]
        return replace(block, margins=margins)

    return run


def _held_out(wanted: Sequence[tuple[int, int, int]]):
    """Task function: scores of the rows that the fits left out, with rows of either class."""

    def run(blocks: Iterator[Block]) -> Iterator[tuple[bytes]]:
        for block in blocks:
            for part, at, fold in wanted:
                mine = block.fold == fold
                score, rank = np.unique(block.margins[at][mine], return_inverse=True)
                n = np.bincount(rank, minlength=len(score))
                pos = np.bincount(rank, block.y[mine], len(score)).astype(np.int64)
                if len(score):
                    yield (pickle.dumps((part, score, pos, n - pos), 5),)

    return run


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for found in batch.column(0).to_pylist():
            part, *columns = pickle.loads(found)
            arrays = [pa.array(np.full(len(columns[0]), part, np.int32)), *(pa.array(c) for c in columns)]
            yield pa.record_batch(arrays, names=["part", "score", "pos", "neg"])


def _blocks(data: Spread, n_fits: int) -> RDD:
    """The rows as blocks with no trees yet."""
    folds, union = data.folds, data.tables()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, fold, batch in _pieces(batches, folds):
            codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(union)]).astype(np.uint8)
            y, weight, name = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "weight", "_name"))
            block = Block(codes, y.astype(np.int8), weight.astype(float), fold, name.astype(np.int64), np.zeros((n_fits, len(y))))
            yield pa.record_batch([pa.array([pickle.dumps(block, 5)], pa.binary())], names=["block"])

    return data.rows.mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(bytes(r.block)))


class Forest:
    """Fits that grow side by side on the same blocks."""

    def __init__(self, spark: SparkSession, data: Spread, fits: list[Fit], seed: int):
        self.spark, self.data, self.fits, self.seed = spark, data, fits, seed
        self.tables = spark.sparkContext.broadcast(data.tables()[1])
        self.blocks = _blocks(data, len(fits)).persist(StorageLevel.MEMORY_AND_DISK)
        self.old: list[RDD] = []
        self.written: list[RDD] = []
        with_checkpoints(spark)

    def _sums(self, growing: Sequence[int], number: int) -> dict[int, np.ndarray]:
        """The sums that each fit asks for, in as many jobs as the driver needs to hold them."""
        out: dict[int, np.ndarray] = {}
        asked, room = [], SUM_BYTES
        parts = self.blocks.getNumPartitions()

        def ask() -> None:
            found_by = self.blocks.mapPartitions(_level(self.tables, [a for _, a in asked], number, self.seed))
            for found in [found_by.treeReduce(_added)] if parts > MANY_PARTS else found_by.collect():
                for (i, _), sums in zip(asked, pickle.loads(found)):
                    if sums is not None:
                        out[i] = out[i] + sums if i in out else sums
            self._drop_old()

        for i in growing:
            fit = self.fits[i]
            tree, place, n = fit.asks()
            cost = 16 * n * len(fit.columns) * BINS * parts
            if asked and cost > room:
                ask()
                asked, room = [], SUM_BYTES
            asked.append((i, (i, fit.group, fit.fold, fit.setting, fit.columns, tree, place, n)))
            room -= cost
        ask()
        return out

    def _drop_old(self) -> None:
        """Blocks before the last tree, and older ones that were written out."""
        for rdd in self.old:
            rdd.unpersist()
        self.old = []
        done = [r for r in self.written if r.isCheckpointed()]
        for rdd in done[:-1]:
            release(self.spark, rdd.getCheckpointFile())
            self.written.remove(rdd)

    def grow(self, number: int) -> list[int]:
        """The next tree of every fit that wants one; these fits."""
        active = growing = [i for i, f in enumerate(self.fits) if max(f.counts) >= number]
        for i in active:
            self.fits[i].begin(self.data.size)
        depth = 0
        while growing:
            sums = self._sums(growing, number)
            growing = [i for i in growing if self.fits[i].takes(sums[i], depth)]
            depth += 1
        finished = [(i, self.fits[i].fold, self.fits[i].growth.tree()) for i in active]
        self.old.append(self.blocks)
        self.blocks = self.blocks.map(_grown(self.tables, finished)).persist(StorageLevel.MEMORY_AND_DISK)
        if number % KEPT_TREES == 0:
            self.blocks.checkpoint()
            self.written.append(self.blocks)
        for i, _, tree in finished:
            self.fits[i].growth = self.fits[i].sums = None
            if self.fits[i].fold == self.data.n_folds:
                self.fits[i].trees.append(tree)
        return active

    def aucs(self, fits: Sequence[int]) -> dict[int, float]:
        """Exact area under the curve of each fit over the rows that it left out; equal scores count half."""
        wanted = [(i, i, self.fits[i].fold) for i in fits]
        found = self.spark.createDataFrame(self.blocks.mapPartitions(_held_out(wanted)), "found binary")
        with tidied(self.spark):
            counts = found.mapInArrow(_scores, "part int, score double, pos long, neg long")
            counts = counts.groupBy("part", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            bucket = F.floor(F.lit(float(SCORE_BUCKETS)) / (F.exp(-F.col("score")) + 1.0))
            placed = _bucketed_prefix(counts, ["part"], ["score"], "neg", bucket)
            wins = F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2.0))
            rows = placed.groupBy("part").agg(wins.alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).collect()
        self._drop_old()
        return {r.part: r.wins / (r.p * r.n) if r.p and r.n else float("nan") for r in rows}

    def close(self) -> None:
        self.blocks.unpersist()
        for rdd in self.old:
            rdd.unpersist()
        for rdd in self.written:
            if rdd.isCheckpointed():
                release(self.spark, rdd.getCheckpointFile())
        self.tables.destroy()


def cross_validate(spark: SparkSession, data: Spread, settings: Sequence[Mapping], seed: int) -> list[float]:
    """Mean AUC over the folds of every setting, as ``trees.cross_validate``, on all rows."""
    groups, members = setting_groups(settings)
    # Fits with the same number of trees go together, as many as the sums of their trees have room.
    order = sorted(range(len(groups)), key=lambda g: -max(groups[g][1]))
    together = max(1, MARGIN_BYTES // (8 * data.n * data.n_folds))
    found: dict[tuple[int, int], list[float]] = {}
    for start in range(0, len(order), together):
        fits = [
            Fit(g, k, *groups[g], np.random.default_rng([seed, g, k]))
            for g in order[start : start + together] for k in range(data.n_folds)
        ]
        forest = Forest(spark, data, fits, seed)
        for number in range(1, max(max(f.counts) for f in fits) + 1):
            scored = [i for i in forest.grow(number) if number in fits[i].counts]
            if scored:
                for i, auc in forest.aucs(scored).items():
                    found.setdefault((fits[i].group, number), []).append(auc)
        forest.close()
    return of_settings(settings, members, {k: float(np.mean(v)) for k, v in found.items()})


def refit(spark: SparkSession, data: Spread, setting: Mapping, seed: int) -> BoostedTrees:
    """The model of one setting on all rows, as ``trees.refit``."""
    full = {**DEFAULTS, **setting}
    fit = Fit(0, data.n_folds, full, [full["n_estimators"]], np.random.default_rng([seed]))
    forest = Forest(spark, data, [fit], seed)
    for number in range(1, full["n_estimators"] + 1):
        forest.grow(number)
    forest.close()
    edges = data.edges[-1]
    first = np.cumsum([0, *(len(t.feature) for t in fit.trees)])[:-1]
    cuts = [[edges[f][b] if f >= 0 else 0.0 for f, b in zip(t.feature.tolist(), t.bin.tolist())] for t in fit.trees]
    join = lambda parts: np.concatenate(list(parts))
    return BoostedTrees(
        join(t.feature for t in fit.trees).astype(np.int64), np.array([c for tree in cuts for c in tree], float),
        join(t.left + n for t, n in zip(fit.trees, first)), join(t.right + n for t, n in zip(fit.trees, first)),
        join(t.value for t in fit.trees), first, data.size,
    )
