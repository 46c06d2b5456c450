"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation for balanced binary codes is learned on a bounded sample (documented parameter
``sample_rows``); any rotation keeps distances, so the sample shapes speed only. The code is
cut into ``m`` tables. Two unit vectors of cosine ``c`` lie ``2 - 2c`` apart (squared), and
every differing bit costs at least the squares of both rotated components. So one table has
differing bits whose squares sum to ``(1 - c) / m`` or less on one side: each vector is
stored under its own code in every table and probes the codes of all such bit sets. That
finds every link; nothing is left to chance, and recall is 1.

Keys that hold many vectors are worked off in blocks. A pair found in several tables counts
in the first only, which both vectors tell. Blocks return counts and one link per vector to
the least of its part, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import blocks
from parlance.llm.graph import components
from parlance.llm.store import NO_ID, discard, public_id, stored, with_id

SAMPLE_ROWS = 10_000
ITERATIONS = 40
BLOCK = 512
#: Room for rounding: sets this much beyond the limit are probed, and pairs count up to half of it.
SLACK = 1e-6


def learn_rotation(sample: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and orthogonal rotation for which signs quantise unit vectors best."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    rng = np.random.default_rng(7)
    turn, _ = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))
    flat = centred @ axes.T
    for _ in range(iterations):
        left, _, right = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
        turn = right.T @ left.T
    return mean, axes.T @ turn


class Index:
    """Rotations by dimension, and how codes fall into tables."""

    def __init__(self, rotations: dict, rows: int, cosine: float):
        self.rotations, self.cosine, self.width = rotations, cosine, max(8, int(max(rows, 2) - 1).bit_length())

    def cuts(self, dim: int) -> np.ndarray:
        """First component of every table."""
        m = max(1, dim // self.width)
        return np.linspace(0, dim, m + 1).astype(int)

    def limit(self, dim: int) -> float:
        return (1 - self.cosine) / (len(self.cuts(dim)) - 1)

    def rotate(self, vectors: np.ndarray) -> np.ndarray:
        vectors = scaled(vectors)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        if vectors.shape[1] not in self.rotations:
            return unit
        mean, turn = self.rotations[vectors.shape[1]]
        return (unit - mean) @ turn

    def codes(self, rotated: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """One 64-bit name per row and table."""
        bits = np.where(rotated >= 0, _weights(rotated.shape[1], cuts), np.uint64(0))
        return np.bitwise_xor.reduceat(bits, cuts[:-1], axis=1)


def _weights(dim: int, cuts: np.ndarray) -> np.ndarray:
    """A bit of its own for each component of a table; hashed ones beyond 64 per table."""
    place = np.arange(dim) - np.repeat(cuts[:-1], np.diff(cuts))
    return np.where(place < 64, np.uint64(1) << (place % 64).astype(np.uint64), blocks.mix(np.arange(dim, dtype=np.uint64)))


def flips(costs: np.ndarray, weights: np.ndarray, limit: float) -> list[int]:
    """XOR masks of all non-empty bit sets whose costs sum to ``limit`` at most."""
    order = np.argsort(costs, kind="stable")
    cost, weight = costs[order].tolist(), weights[order].tolist()
    out, stack = [], [(0, 0.0, 0)]
    while stack:
        begin, spent, mask = stack.pop()
        for i in range(begin, len(cost)):
            total = spent + cost[i]
            if total > limit:
                break
            out.append(mask ^ weight[i])
            stack.append((i + 1, total, mask ^ weight[i]))
    return out


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near one.

    Exact, so directions stay; norms of very large or small vectors neither overflow nor vanish.
    """
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


KEYS = "key long, tab int, node long, holds boolean"


def _keys(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("dim").to_numpy()
            for dim in np.unique(size):
                rows = batch.filter(pa.array(size == dim))
                node, group = rows.column("node").to_numpy(), rows.column("grp").to_numpy()
                cuts = index.value.cuts(dim)
                z = index.value.rotate(matrix(rows.column("vector"), dim))
                codes, costs, weights = index.value.codes(z, cuts), z * z, _weights(dim, cuts)
                limit = index.value.limit(dim) * (1 + SLACK)
                for t, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    base = blocks.mix(group.astype(np.uint64) + np.uint64(dim * 64 + t))
                    yield _key_rows(blocks.mix(base ^ codes[:, t]), t, node, True)
                    masks, owner, held = [], [], 0
                    for i in range(len(node)):
                        found = flips(costs[i, a:b], weights[a:b], limit)
                        masks.append(np.array(found, np.uint64))
                        owner.append(i)
                        held += len(found)
                        if held > 1 << 17 or i == len(node) - 1:
                            who = np.repeat(owner, [len(x) for x in masks])
                            yield _key_rows(blocks.mix(base[who] ^ codes[who, t] ^ np.concatenate(masks)), t, node[who], False)
                            masks, owner, held = [], [], 0

    return run


def _key_rows(keys: np.ndarray, tab: int, node: np.ndarray, holds: bool) -> pa.RecordBatch:
    n = len(keys)
    return pa.record_batch({
        "key": pa.array(keys.view(np.int64)), "tab": pa.array(np.full(n, tab, np.int32)),
        "node": pa.array(node), "holds": pa.array(np.full(n, holds)),
    })


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each member's connected part."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, low)
        np.minimum.at(fresh, b, low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _first_found(index: Index, z: np.ndarray, codes: np.ndarray, cuts: np.ndarray, x: np.ndarray, y: np.ndarray, tab: int) -> np.ndarray:
    """Whether pairs, found in table ``tab`` under the code of ``y``, are counted there."""
    limit = index.limit(z.shape[1]) * (1 + SLACK / 2)
    out = np.empty(len(x), bool)
    for lo in range(0, len(x), 1 << 14):
        i, j = x[lo : lo + (1 << 14)], y[lo : lo + (1 << 14)]
        differ = (z[i] >= 0) != (z[j] >= 0)
        from_x = np.add.reduceat(differ * z[i] ** 2, cuts[:-1], axis=1) <= limit
        from_y = np.add.reduceat(differ * z[j] ** 2, cuts[:-1], axis=1) <= limit
        earlier = (from_x | from_y)[:, :tab].any(axis=1)
        same = ~np.logical_or.reduceat(differ, cuts[:-1], axis=1)[:, tab]
        mine = same | (from_x[:, tab] & (~from_y[:, tab] | (codes[j, tab] < codes[i, tab])))
        out[lo : lo + len(i)] = mine & ~earlier
    return out


def _link(index):
    """Group function on a block of a key: counts of links and least linked nodes."""

    def run(table: pa.Table) -> pa.Table:
        dim, tab = table["dim"][0].as_py(), table["tab"][0].as_py()
        node, n = table["node"].to_numpy(), table["n"].to_numpy()
        holds = table["holds"].to_numpy(zero_copy_only=False).astype(bool)
        query = table["query"].to_numpy(zero_copy_only=False).astype(bool)
        vectors = scaled(matrix(table["vector"], dim))
        norm = np.linalg.norm(vectors, axis=1)
        cuts, z = index.value.cuts(dim), index.value.rotate(vectors)
        codes = index.value.codes(z, cuts)
        q, s = np.flatnonzero(query), np.flatnonzero(~query)
        i, j = np.nonzero(vectors[q] @ vectors[s].T / (norm[q][:, None] * norm[s]) >= index.value.cosine)
        i, j = q[i], s[j]
        once = np.where(holds[i], node[i] < node[j], node[i] != node[j])
        i, j = i[once], j[once]
        mine = _first_found(index.value, z, codes, cuts, i, j, tab)
        i, j = i[mine], j[mine]
        links = np.bincount(i, weights=n[j], minlength=len(node)) + np.bincount(j, weights=n[i], minlength=len(node))
        part = _parts(len(node), i, j) if len(i) else np.arange(len(node))
        hit = np.flatnonzero(links)
        return pa.table({"node": node[hit], "links": links[hit].astype(np.int64), "to": node[part[hit]]})

    return run


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Links of a cosine of ``cosine`` or more between vectors with equal labels.

    Returns one row per input row: ``id_col``, ``n_links`` (other vectors linked directly),
    ``component_id`` (least id reachable by links, itself included), ``kept`` (it is that id).

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do rows without a label or an id; they have no links and are kept (without
    an id, the component is null). Vectors of different dimensions do not link. Rows with
    equal vectors and labels are one class and link each other; every row counts, repeated
    ones included. Other columns are ignored.
    """
    rows = with_id(df, id_col, vector=vector_col, label=label_col)
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = finite & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & (F.col("id") != NO_ID)
    name = F.when(good, F.xxhash64(F.lit(1), "label", "vector"))
    named = stored(rows.select("id", "label", "vector", name.alias("node")), "vectors")
    classes = named.where("node is not null").groupBy("node", "label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes.withColumn("grp", F.xxhash64("label")).withColumn("dim", F.size("vector")), "vector-classes")

    sample = classes.orderBy(F.xxhash64("node"), "node").limit(sample_rows).select("dim", "vector").toPandas()
    rotations = {}
    for dim, part in sample.groupby("dim"):
        known = scaled(np.stack(part["vector"].to_numpy()))
        if len(known) > 2 * dim:
            rotations[int(dim)] = learn_rotation(known / np.linalg.norm(known, axis=1, keepdims=True))
    context = df.sparkSession.sparkContext
    index = context.broadcast(Index(rotations, classes.count(), cosine))

    keys = stored(classes.select("node", "grp", "dim", "vector").mapInArrow(_keys(index), KEYS), "vector-keys")
    held = keys.where("holds").groupBy("key").agg(F.count(F.lit(1)).alias("stored"))
    asked = keys.where("not holds").groupBy("key").agg(F.count(F.lit(1)).alias("asked"))
    open_keys = held.join(asked, "key", "left").select("key", "stored", (F.col("stored") + F.coalesce("asked", F.lit(0))).alias("all"))
    open_keys = stored(open_keys.where("all > 1"), "vector-open-keys")
    split = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    facts = classes.select("node", "n", "dim", "vector")
    found = keys.join(open_keys, "key").withColumn("_w", split("stored")).withColumn("_h", split("all")).join(facts, "node")
    deal = lambda n: F.pmod(F.xxhash64("node", "key"), n).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    pool = found.where("holds").withColumn("wide", deal(F.col("_w"))).withColumn("high", span(F.col("_h"))).withColumn("query", F.lit(False))
    asks = found.withColumn("high", deal(F.col("_h"))).withColumn("wide", span(F.col("_w"))).withColumn("query", F.lit(True))
    columns = ["key", "wide", "high", "tab", "node", "n", "dim", "holds", "query", "vector"]
    work = pool.select(*columns).unionByName(asks.select(*columns))
    links = work.groupBy("key", "wide", "high").applyInArrow(_link(index), "node long, links long, to long")
    links = stored(links, "vector-links")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(links.select(F.col("node").alias("a"), F.col("to").alias("b")))
    ends = classes.select("node", "rep", "n").join(counted, "node", "left").join(parts.withColumnRenamed("id", "node"), "node", "left")
    ends = ends.select("node", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("part"))
    ends = stored(ends, "vector-ends")
    least = stored(ends.groupBy("part").agg(F.min("rep").alias("component")), "vector-components")
    known = stored(ends.join(least, "part").select("node", "n_links", "component"), "vector-result")
    discard(keys, open_keys, links, ends, least)
    done = named.select("id", "node").join(known, "node", "left")
    alone = F.when(F.col("id") != NO_ID, F.col("id"))
    component = F.coalesce("component", alone)
    return done.select(
        public_id(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
