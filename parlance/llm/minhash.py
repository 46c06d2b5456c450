"""Near-duplicate documents by min-max hashing of word shingles.

Every permutation gives a document two values, the least and the greatest hash of its
shingle set, so ``PERMUTATIONS`` evaluations make twice as many unbiased values. ``ROWS``
values in a row form a band key; documents with a band key in common are candidates, and a
pair of similarity 0.75 has none with a probability of about ``(1 - 0.75**4)**32``, 5 in a
million. All links are confirmed on full sets.

Documents with equal sets are one class from the start. Within a band key

1. every class is compared with the least one,
2. keys that still hold several components compare members across components only: first
   each with its likeliest partners, then all pairs that remain possible,

in blocks of bounded size. A pair is possible if its sizes, its signatures and an upper bound
of what its sets have in common, from shingle counts in ``SLOTS`` slots, allow it. No pair inside a component is ever listed.
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

SHINGLE = 5
PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Share of equal signature bytes below which a pair is ruled out: 4.5 standard deviations
#: under the expected share of a pair at the limit, 4 in a million.
RULED_OUT = 0.58
#: Shingles are counted in so many slots: two sets have at most the sum of the slots' lesser
#: counts in common. A slot holds 255 at most; a set with a full one is never ruled out by it.
SLOTS = 1024
#: Members of a band key that are compared at once.
BLOCK = 512

SKETCH = "id long, n_shingles long, low long, high long, signature binary, bands array<long>"


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, by row, and where each row begins."""
    starts, ends, first = blocks.words(blocks.lower_ascii(data), offsets)
    hashes = blocks.word_hashes(blocks.lower_ascii(data), starts, ends)
    at, row = blocks.window_starts(first, SHINGLE), blocks.rows_of(first, SHINGLE)
    grams = blocks.run_hashes(hashes, SHINGLE)[at] if len(at) else np.empty(0, np.uint64)
    count = np.diff(first)
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(few):
        prefix = blocks.prefix_hash(hashes)
        whole = blocks.span_hash(prefix, first[few], first[few + 1]) + blocks.mix(count[few].astype(np.uint64))
        grams, row = np.concatenate((grams, whole)), np.concatenate((row, few))
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])))) if len(grams) else []
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(offsets)))


def sketch(grams: np.ndarray, first: np.ndarray) -> tuple:
    """Size, 128-bit name of the set, signature bytes and band keys of every non-empty row."""
    rows = np.flatnonzero(np.diff(first))
    begin = first[rows]
    values = np.empty((2 * PERMUTATIONS, len(rows)), np.uint64)
    seeds = blocks.mix(np.arange(2 * PERMUTATIONS, dtype=np.uint64), 7)
    for k in range(PERMUTATIONS):
        turned = grams * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1]
        values[k] = np.minimum.reduceat(turned, begin)
        values[PERMUTATIONS + k] = np.maximum.reduceat(turned, begin)
    low = np.add.reduceat(blocks.mix(grams, 1), begin)
    high = np.add.reduceat(blocks.mix(grams, 2), begin)
    signature = np.ascontiguousarray(((values >> np.uint64(24)) & np.uint64(255)).astype(np.uint8).T)
    bands = np.empty((len(rows), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(rows), b, np.uint64)
        for v in values[b * ROWS : (b + 1) * ROWS]:
            key = blocks.mix(key + v)
        bands[:, b] = key
    return rows, low, high, signature, bands


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id")
        for lo, hi, data, offsets in blocks.slices(*blocks.column(batch.column("text"))):
            grams, first = shingles(data, offsets)
            n = hi - lo
            if not len(grams):
                empty = [pa.array(np.zeros(n, np.int64))] + [pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))]
                yield pa.record_batch([ids.slice(lo, n), *empty], names=[c.split()[0] for c in SKETCH.split(", ")])
                continue
            rows, low, high, signature, bands = sketch(grams, first)
            place = np.full(n, -1)
            place[rows] = np.arange(len(rows))
            take = pa.array(place, pa.int64(), mask=place < 0)
            cells = pa.array([s.tobytes() for s in signature], pa.binary())
            keys = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.record_batch([
                ids.slice(lo, n), pa.array(np.diff(first)), pa.array(low.view(np.int64)).take(take),
                pa.array(high.view(np.int64)).take(take), cells.take(take), keys.take(take),
            ], names=[c.split()[0] for c in SKETCH.split(", ")])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks.slices(*blocks.column(batch.column("text"))):
            grams, first = shingles(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(grams.view(np.int64)))
            size = np.diff(first)
            counts = np.bincount(
                np.repeat(np.arange(hi - lo), size) * SLOTS + (grams >> np.uint64(40)).astype(np.int64) % SLOTS, minlength=(hi - lo) * SLOTS
            ).reshape(-1, SLOTS)
            cells = pa.array([c.tobytes() for c in np.minimum(counts, 255).astype(np.uint8)], pa.binary())
            yield pa.record_batch([batch.column("id").slice(lo, hi - lo), pa.array(size), cells, lists], names=["id", "size", "slots", "grams"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their signatures do not rule out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (
            np.frombuffer(np.ascontiguousarray(blocks.column(batch.column(c))[0]).tobytes(), np.uint8).reshape(batch.num_rows, -1)
            for c in ("sa", "sb")
        )
        alike = (left == right).mean(axis=1) >= RULED_OUT
        yield batch.select(["a", "b"]).filter(pa.array(alike))


def set_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, size, slots, grams)``: the full sets of the given documents, and shingles per slot."""
    wanted = docs.join(ids, "id", "left_semi").select("id", "text")
    return stored(wanted.mapInArrow(_sets, "id long, size long, slots binary, grams array<long>"), "minhash-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets have ``100 * common >= percent * union``."""
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("_ga"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("_gb"))
    common = F.size(F.array_intersect("_ga", "_gb"))
    near = 100 * common >= percent * (F.size("_ga") + F.size("_gb") - common)
    return stored(pairs.join(left, "a").join(right, "b").where(near).select("a", "b"), "minhash-links")


def _across(top: int | None, percent: int):
    """Group function on a block of a band key: pairs of different components that may link."""

    def run(table: pa.Table) -> pa.Table:
        ids, labels, size = (table[c].to_numpy() for c in ("id", "label", "size"))
        query = table["query"].to_numpy(zero_copy_only=False).astype(bool)
        marks = np.frombuffer(np.ascontiguousarray(blocks.column(table["signature"])[0]).tobytes(), np.uint8).reshape(len(ids), -1)
        slots = np.frombuffer(np.ascontiguousarray(blocks.column(table["slots"])[0]).tobytes(), np.uint8).reshape(len(ids), -1)
        full = (slots == 255).any(axis=1)
        others = np.flatnonzero(~query)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in np.flatnonzero(query):
            pool = others[(labels[others] != labels[i]) & (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))]
            pool = pool[(marks[pool] == marks[i]).mean(axis=1) >= RULED_OUT]
            most = np.minimum(slots[pool], slots[i]).sum(axis=1, dtype=np.int64)
            share = np.where(full[pool] | full[i], 1.0, most / np.maximum(size[pool] + size[i] - most, 1))
            good = np.flatnonzero(share >= percent / 100 - 1e-9)
            if top is not None and len(good) > top:
                good = good[np.argsort(-share[good], kind="stable")[:top]]
            a.append(np.full(len(good), ids[i]))
            b.append(ids[pool[good]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, id, label, main)`` of the keys that hold several components.

    ``main`` is the most frequent component of the key.
    """
    named = members.join(labels.withColumnRenamed("component", "_c"), "id", "left").select(
        "key", "id", F.coalesce("_c", "id").alias("label")
    )
    named = stored(named, "minhash-members")
    sizes = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    keys = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("n"))
    keys = stored(keys.where("n > 1").drop("n"), "minhash-keys")
    rows = stored(named.join(keys, "key"), "minhash-open")
    discard(named, keys)
    return rows


def cross_pairs(rows: DataFrame, known: DataFrame, signatures: DataFrame, top: int | None, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` across components that sizes, signatures and slots do not rule out.

    The members outside a key's main component are its queries; they are compared with all
    its members, block by block.
    """
    rows = stored(rows.join(known, "id").join(signatures, "id"), "minhash-compare")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("label") != F.col("main")).alias("asks"))
    counts = stored(counts.where("asks > 0"), "minhash-counts")
    split = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK))).cast("int")
    rows_ = rows.join(counts, "key").withColumn("_w", split(F.col("all"))).withColumn("_h", split(F.col("asks")))
    deal = lambda n: F.pmod(F.xxhash64("id", "key"), n).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    pool = rows_.withColumn("wide", deal(F.col("_w"))).withColumn("high", span(F.col("_h"))).withColumn("query", F.lit(False))
    queries = rows_.where("label <> main").withColumn("high", deal(F.col("_h"))).withColumn("wide", span(F.col("_w"))).withColumn("query", F.lit(True))
    columns = ["key", "wide", "high", "id", "label", "size", "query", "slots", "signature"]
    blocks_ = pool.select(*columns).unionByName(queries.select(*columns))
    found = blocks_.groupBy("key", "wide", "high").applyInArrow(_across(top, percent), "a long, b long")
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "minhash-pairs")
    discard(rows, counts)
    return pairs


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Components of documents linked at a similarity of ``percent`` or more.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` in the text with A-Z lower-cased. Returns one row
    per input row: ``id_col``, ``n_shingles`` (size of its set), ``component_id`` (least id
    reachable by links, itself included), ``kept`` (it is that id).

    Documents with fewer than five words have their whole sequence as one shingle. Documents
    without words, null texts included, have an empty set, link with nothing and are kept.
    Rows without an id link with nothing, have no component and are kept. Equal texts share a
    component whatever their number; rows with equal ids are one document for the links of
    others. Other columns are ignored.
    """
    docs = with_id(df, id_col, text=text_col)
    sketches = stored(docs.select("id", "text").mapInArrow(_sketches, SKETCH), "minhash-sketches")
    usable = sketches.where((F.col("n_shingles") > 0) & (F.col("id") != NO_ID))
    classes = stored(usable.groupBy("low", "high", "n_shingles").agg(F.min("id").alias("rep")), "minhash-classes")
    reps = usable.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")

    exploded = reps.select("id", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("_last")).where("pivot < _last")
    shared = stored(shared.drop("_last"), "minhash-shared")
    members = stored(exploded.join(shared, "key"), "minhash-bands")
    signatures = reps.select("id", "signature")

    pairs = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    left = signatures.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    right = signatures.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    likely = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    likely = stored(likely.mapInArrow(_alike, "a long, b long"), "minhash-pairs")
    sets = set_table(docs, members.select("id").distinct())  # the texts move once
    links = confirmed(likely, sets, percent)
    labels = components(links)
    rows = open_members(members, labels)
    known = sets.select("id", "size", "slots")
    for top in (2, None):
        more = cross_pairs(rows, known, signatures, top, percent)
        if more.isEmpty():
            break
        fresh = confirmed(more, sets, percent)
        before = labels.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a <> b")
        labels = components(before.unionByName(fresh))
        rows = open_members(members, labels)
    discard(sets)
    ends = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "low", "high", F.coalesce("component", "rep").alias("component")
    )
    ends = stored(ends, "minhash-ends")
    discard(members, shared, likely, links)
    rows = sketches.select("id", "n_shingles", *[
        F.when((F.col("n_shingles") > 0) & (F.col("id") != NO_ID), F.col(c)).alias(c) for c in ("low", "high")
    ])
    done = rows.join(ends, ["low", "high"], "left")
    alone = F.when(F.col("id") != NO_ID, F.col("id"))
    component = F.coalesce("component", alone)
    return done.select(public_id(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
