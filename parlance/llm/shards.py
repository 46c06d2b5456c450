"""Documents in shards of bounded size, and the exchange that finds what repeats across them.

A shard is a group of whole documents with about the same number of bytes. Each shard sends
the sorted distinct hashes of its anchors (see :func:`blocks.anchors`) to key buckets; a
bucket sees one array per shard, never one row per document, so that a passage held by a
third of all documents costs a bucket one entry per shard. What comes back to a shard are
those of its own anchors that some other document has too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import blocks
from parlance.llm.store import NO_ID, groups_for

#: Bytes of text in a shard, and anchors in a bucket.
SHARD_BYTES = 4 << 20
BUCKET_KEYS = 1 << 21

KEYS = "bucket int, shard int, keys binary, many binary"
BACK = "shard int, keys binary"


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def sharded(docs: DataFrame, total: int, each: int = SHARD_BYTES, extra: Iterable[str] = ()) -> DataFrame:
    """``(shard, id, text)`` and what else is asked for; rows without an id are dealt by their text."""
    count = groups_for(total, each)
    apart = F.when(F.col("id") == NO_ID, F.col("text"))
    return docs.select(F.pmod(F.xxhash64("id", apart), F.lit(count)).cast("int").alias("shard"), "id", "text", *extra)


def ids_of(table: pa.Table) -> np.ndarray:
    return table["id"].to_numpy().astype(np.int64)


def array_of(cell, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(cell.as_py(), kind)


def joined(column: pa.ChunkedArray, kind=np.uint64) -> np.ndarray:
    """All the arrays in a binary column, one after another."""
    data, _ = blocks.column(column)
    return np.frombuffer(np.ascontiguousarray(data).tobytes(), kind)


def by_bucket(shard: int, buckets: int, keys: np.ndarray, *others: np.ndarray) -> Iterable[tuple]:
    """``(bucket, arrays)`` of sorted keys and what belongs to them, for buckets that have any."""
    of = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    cut = np.flatnonzero(np.diff(of[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(of[part[0]]), [keys[part], *(o[part] for o in others)]


def send_anchors(units: Callable, buckets: int) -> Callable:
    """Group function: the distinct anchors of a shard, and whether two of its documents have them."""

    def run(table: pa.Table) -> pa.Table:
        shard, ids = table["shard"][0].as_py(), ids_of(table)
        keys, docs = [], []
        for lo, _, data, offsets in blocks.slices(*blocks.column(table["text"])):
            anchor, row = units(data, offsets)
            step = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))) if len(anchor) else []
            keys.append(anchor[step])
            docs.append(ids[lo + row[step]])
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        distinct, least = blocks.group_min(keys, docs)
        most = -blocks.group_min(keys, -docs)[1]
        out = list(by_bucket(shard, buckets, distinct, (least < most).astype(np.uint8)))
        return pa.table({
            "bucket": pa.array([b for b, _ in out], pa.int32()),
            "shard": pa.array([shard] * len(out), pa.int32()),
            "keys": blocks.binary([a[0] for _, a in out]),
            "many": blocks.binary([a[1] for _, a in out]),
        })

    return run


def meet_anchors(table: pa.Table) -> pa.Table:
    """Group function on a bucket: to each shard those of its anchors that repeat."""
    keys, many = joined(table["keys"]), joined(table["many"], np.uint8)
    size = np.array([len(c.as_py()) // 8 for c in table["keys"]])
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    again = np.empty(len(keys), bool)
    again[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    again |= many > 0
    parts = [k[a] for k, a in zip(np.split(keys, np.cumsum(size)[:-1]), np.split(again, np.cumsum(size)[:-1]))]
    full = [i for i, p in enumerate(parts) if len(p)]
    return pa.table({"shard": table["shard"].combine_chunks().take(pa.array(full, pa.int64())), "keys": blocks.binary([parts[i] for i in full])})


def repeated_anchors(shards: DataFrame, units: Callable, total: int, density: float) -> tuple[DataFrame, int]:
    """``(shard, keys)``: anchors of each shard that another document has; and the bucket count.

    ``units(bytes, offsets)`` gives the anchor and the row of every window of a slice;
    ``density`` is about how many anchors a byte has.
    """
    buckets = groups_for(int(total * density), BUCKET_KEYS)
    sent = shards.groupBy("shard").applyInArrow(send_anchors(units, buckets), KEYS)
    return sent.groupBy("bucket").applyInArrow(meet_anchors, BACK), buckets
