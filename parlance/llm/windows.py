"""Substring dedup on words: Rabin-Karp hashes of every fixed-length window.

1. Every window of ``window`` words is hashed by rolling prefix sums. A window whose anchor
   (its least gram of ``GRAM`` words) no other document has cannot repeat and is left at a
   count of one where it is; this test is exact, so nothing is lost by it.
2. The hashes of all other windows meet in key buckets, one array per shard of documents,
   where the least document of each is found.
3. Each shard gets back the windows that start in a smaller document and merges them into
   maximal removal intervals.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import blocks
from parlance.llm.shards import by_bucket, ids_of, joined, repeated_anchors, sharded, text_bytes
from parlance.llm.store import discard, public_id, stored, with_id

#: Words in an anchor gram.
GRAM = 8
#: Anchors a byte of text has, about.
DENSITY = 0.01

SENT = "bucket int, shard int, keys binary, docs binary, many binary"
BACK = "shard int, keys binary, docs binary"
RESULT = "id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"


def _windows(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple:
    """Word limits, first words, and for each window its first word, row and anchor."""
    starts, ends, first = blocks.words(data, offsets)
    hashes = blocks.word_hashes(data, starts, ends)
    at = blocks.window_starts(first, window)
    gram = blocks.run_hashes(hashes, min(GRAM, window))
    return hashes, first, at, blocks.rows_of(first, window), blocks.anchors(gram, window, min(GRAM, window), at)[1]


def _units(window: int):
    def units(data, offsets):
        _, _, _, row, anchor = _windows(data, offsets, window)
        return anchor, row

    return units


def _send(window: int, buckets: int):
    """Cogroup function: hashes of the windows of a shard that may repeat, with the least document."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        shard, ids = docs["shard"][0].as_py() if len(docs) else 0, ids_of(docs)
        flagged = np.sort(joined(back["keys"]))
        keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for lo, _, data, offsets in blocks.slices(*blocks.column(docs["text"])):
            hashes, _, at, row, anchor = _windows(data, offsets, window)
            mine = blocks.found(anchor, flagged) >= 0
            keys.append(blocks.run_hashes(hashes, window)[at[mine]])
            owners.append(ids[lo + row[mine]])
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        distinct, least = blocks.group_min(keys, owners)
        most = -blocks.group_min(keys, -owners)[1]
        out = list(by_bucket(shard, buckets, distinct, least, (least < most).astype(np.uint8)))
        return pa.table({
            "bucket": pa.array([b for b, _ in out], pa.int32()),
            "shard": pa.array([shard] * len(out), pa.int32()),
            "keys": blocks.binary([a[0] for _, a in out]),
            "docs": blocks.binary([a[1] for _, a in out]),
            "many": blocks.binary([a[2] for _, a in out]),
        })

    return run


def _count(table: pa.Table) -> pa.Table:
    """Group function on a bucket: the least document of every window that repeats."""
    keys, docs, many = joined(table["keys"]), joined(table["docs"], np.int64), joined(table["many"], np.uint8) > 0
    distinct, least = blocks.group_min(keys, docs)
    least = least[np.searchsorted(distinct, keys)]
    tell = many | (least < docs)
    cut = np.cumsum([len(c.as_py()) // 8 for c in table["keys"]])[:-1]
    parts = [(k[t], m[t]) for k, m, t in zip(np.split(keys, cut), np.split(least, cut), np.split(tell, cut))]
    full = [i for i, p in enumerate(parts) if len(p[0])]
    return pa.table({
        "shard": table["shard"].combine_chunks().take(pa.array(full, pa.int64())),
        "keys": blocks.binary([parts[i][0] for i in full]),
        "docs": blocks.binary([parts[i][1] for i in full]),
    })


def intervals(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Limits of the maximal runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _remove(window: int):
    """Cogroup function: removal intervals and what is left of each document of a shard."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        ids = ids_of(docs)
        keys, least = joined(back["keys"]), joined(back["docs"], np.int64)
        order = np.argsort(keys, kind="stable")
        keys, least = keys[order], least[order]
        n_words, n_removed, removed, kept = [], [], [], []
        for lo, hi, data, offsets in blocks.slices(*blocks.column(docs["text"])):
            starts, ends, first = blocks.words(data, offsets)
            gone = np.zeros(len(starts), bool)
            if len(keys) and len(starts) >= window:
                at, row = blocks.window_starts(first, window), blocks.rows_of(first, window)
                place = blocks.found(blocks.run_hashes(blocks.word_hashes(data, starts, ends), window)[at], keys)
                gone = blocks.covered(len(starts), at[(place >= 0) & (least[place] < ids[lo + row])], window)
            raw = data.tobytes()
            for k in range(hi - lo):
                mine = gone[first[k] : first[k + 1]]
                tokens = raw[offsets[k] : offsets[k + 1]].split()
                n_words.append(len(mine))
                n_removed.append(int(mine.sum()))
                if n_removed[-1]:
                    a, b = intervals(mine)
                    removed.append([{"start": s, "end": e} for s, e in zip(a.tolist(), b.tolist())])
                    tokens = compress(tokens, ~mine)
                else:
                    removed.append([])
                kept.append(b" ".join(tokens))
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({
            "id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()), "removed": pa.array(removed, spans),
            "kept_text": pa.array(kept, pa.string()),
        })

    return run


def dedup_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Remove every word in a window of ``window`` words that also starts in a smaller document.

    Windows are judged on the input, not on what is left. Returns one row per input row:
    ``id_col``, ``n_words``, ``n_removed``, ``removed`` (word intervals, end exclusive),
    ``kept_text`` (kept words joined by one space).

    Null or blank texts have no words and keep nothing. Rows with the same id are one document
    for the comparison: none of them removes from another. A null id counts as larger than any
    other. Texts shorter than a window stay whole. Other columns are ignored.
    """
    docs = with_id(df, id_col, text=text_col)
    total = text_bytes(docs)
    shards = sharded(docs, total)
    flags, _ = repeated_anchors(shards, _units(window), total, DENSITY)
    flags = stored(flags, "window-anchors")
    buckets = max(64, -(-total // (64 << 20)))
    sent = shards.groupBy("shard").cogroup(flags.groupBy("shard")).applyInArrow(_send(window, buckets), SENT)
    decided = stored(sent.groupBy("bucket").applyInArrow(_count, BACK), "window-repeats")
    discard(flags)
    done = shards.groupBy("shard").cogroup(decided.groupBy("shard")).applyInArrow(_remove(window), RESULT)
    return done.select(public_id(id_col), "n_words", "n_removed", "removed", "kept_text")


def digest(df: DataFrame) -> DataFrame:
    """The kept text as a SHA-256 in lower-case hex."""
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
