"""Suffix-array dedup on bytes.

A byte is removed when a string of ``length`` bytes over it also starts in a document with a
smaller id. The strings come together by their anchor (least gram of ``GRAM`` bytes, see
:func:`blocks.anchors`): equal strings have equal anchors, so each key bucket can decide
alone on the strings of its anchors.

1. Anchors that only one document has are put aside (exactly, by counting them).
2. Each shard of documents sends the distinct segments of its other anchors: the text under
   the neighbouring strings that share one anchor, with the least document that holds it.
3. A bucket lays its segments end to end in shards of ``SUFFIX_BYTES``, builds a suffix array
   of each by Larsson-Sadakane refinement, finds common prefixes by Kasai's walk, and merges
   several shards by binary search for the strings of one in those of the others.
4. Each shard of documents looks its own segments up in what came back by binary search.

Hot passages reach a bucket once per shard of documents, not once per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import blocks
from parlance.llm.blocks import ragged
from parlance.llm.shards import ids_of, joined, repeated_anchors, sharded, text_bytes
from parlance.llm.store import NO_ID, discard, groups_for, public_id, stored, with_id

GRAM = 16
DENSITY = 0.06
#: Bytes of segments in one suffix array.
SUFFIX_BYTES = 2 << 20

SENT = "bucket int, shard int, keys binary, docs binary, sizes binary, text binary"
BACK = "shard int, keys binary, masks binary"
RESULT = "id long, n_bytes long, n_removed long, removed array<struct<start:int,end:int>>, kept binary"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order.

    Ranks by eight bytes come first; then only groups of equal rank are sorted again, by the
    rank of the suffix ``h`` bytes on, and ``h`` doubles (Larsson and Sadakane).
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key |= padded[j : j + n] << np.uint64(56 - 8 * j)
    order = np.argsort(key)
    ranked = key[order]
    slots = np.arange(n)
    head = np.maximum.accumulate(np.where(np.concatenate(([True], ranked[1:] != ranked[:-1])), slots, 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = head
    h = 8
    while True:
        tied = np.concatenate((head[1:] == head[:-1], [False]))
        tied[1:] |= tied[:-1].copy()
        open_slots = np.flatnonzero(tied)
        if not len(open_slots):
            break
        suffix = order[open_slots]
        over = suffix + h - n  # a suffix that ends within h bytes comes before longer ones
        second = np.where(over < 0, rank[np.minimum(suffix + h, n)], -1 - over) + h + 1
        pair = (head[open_slots].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        turn = np.argsort(pair)
        order[open_slots], pair = suffix[turn], pair[turn]
        begins = np.concatenate(([True], pair[1:] != pair[:-1]))
        fresh = open_slots[np.maximum.accumulate(np.where(begins, np.arange(len(pair)), 0))]
        head[open_slots] = fresh
        rank[order[open_slots]] = fresh
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Kasai: bytes that each suffix shares with the one before it in order, ``depth`` at most.

    One walk for each of the given stretches of the text; all walks go side by side, and each
    step either extends a walk's prefix or moves it to the next suffix with one byte less.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate((text.astype(np.uint16), np.full(depth + 1, 256, np.uint16)))  # 256: no byte
    shared = np.zeros(n, np.int16)
    at, end, h = starts.astype(np.int64), ends.astype(np.int64), np.zeros(len(starts), np.int64)
    live = at < end
    while live.any():
        if not live.all():
            at, end, h = at[live], end[live], h[live]
        other = before[at]
        more = (other >= 0) & (h < depth) & (padded[at + h] == padded[np.maximum(other, 0) + h])
        rest = ~more
        shared[at[rest]] = h[rest]
        h += more
        at += rest
        np.subtract(h, rest & (h > 0), out=h)
        live = at < end
    return shared


def _segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple:
    """First and last string start, row and anchor of every run of strings with one anchor."""
    at, row = blocks.window_starts(offsets, length), blocks.rows_of(offsets, length)
    gram = blocks.byte_runs(data, GRAM)
    place, anchor = blocks.anchors(gram, length, GRAM, at)
    if not len(at):
        return at, at, row, anchor
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    return at[new], at[last], row[new], anchor[new]


def _units(length: int):
    def units(data, offsets):
        _, _, row, anchor = _segments(data, offsets, length)
        return anchor, row

    return units


def _named(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    ends = last + length
    return blocks.span_hash(blocks.byte_prefix(data), first, ends) ^ blocks.mix((ends - first).astype(np.uint64))


def _send(length: int, buckets: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        shard, ids = docs["shard"][0].as_py() if len(docs) else 0, ids_of(docs)
        flagged = np.sort(joined(back["keys"]))
        whole, all_offsets = blocks.column(docs["text"])
        parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
        for lo, _, data, offsets in blocks.slices(whole, all_offsets):
            first, last, row, anchor = _segments(data, offsets, length)
            mine = np.flatnonzero(blocks.found(anchor, flagged) >= 0)
            first, last = first[mine], last[mine]
            names = _named(data, first, last, length) if len(mine) else np.empty(0, np.uint64)
            parts.append((names, ids[lo + row[mine]], first + all_offsets[lo], last - first + length, anchor[mine]))
        names, owner, start, size, anchor = (np.concatenate(p) for p in zip(*parts))
        distinct, least = blocks.group_min(names, owner)
        one = np.empty(len(distinct), np.int64)
        one[np.searchsorted(distinct, names)] = np.arange(len(names))
        start, size, anchor = start[one], size[one], anchor[one]
        of = (anchor % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(of, kind="stable")
        out = [p for p in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(p)]
        return pa.table({
            "bucket": pa.array([int(of[p[0]]) for p in out], pa.int32()),
            "shard": pa.array([shard] * len(out), pa.int32()),
            "keys": blocks.binary([distinct[p] for p in out]),
            "docs": blocks.binary([least[p] for p in out]),
            "sizes": blocks.binary([size[p].astype(np.uint16) for p in out]),
            "text": blocks.binary([whole[ragged(start[p], size[p])] for p in out]),
        })

    return run


def _least_in_shard(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> tuple:
    """The least document of every string of a suffix shard.

    Returns it per string in segment order, and the sorted distinct strings with their least
    document as functions to call when shards have to be merged.
    """
    order = suffix_array(text)
    shared = common_prefixes(text, order, starts, starts + sizes, length)
    counts = sizes - length + 1
    places = ragged(starts, counts)
    least = np.full(len(text), NO_ID, np.int64)
    least[places] = np.repeat(docs, counts)
    owned = np.zeros(len(text), bool)
    owned[places] = True
    begins = np.concatenate(([True], shared[order][1:] < length))
    first = np.flatnonzero(begins)
    group = np.cumsum(begins) - 1
    lowest = np.minimum.reduceat(least[order], first)
    number = np.empty(len(text), np.int64)
    number[order] = group
    return places, number[places], lowest, order[first], np.maximum.reduceat(owned[order].astype(np.int8), first) > 0


def least_documents(text: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int, limit: int = SUFFIX_BYTES) -> np.ndarray:
    """For each string of each segment, in order, the least document that has it.

    Segments are laid in suffix shards of ``limit`` bytes; the sorted strings of a later shard
    are searched for in those merged before it.
    """
    starts = np.cumsum(sizes) - sizes
    cut = np.searchsorted(starts, np.arange(limit, int(sizes.sum()) + limit, limit))
    cuts = np.unique(np.concatenate(([0], cut, [len(sizes)])))
    shards = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        base = starts[a]
        part = text[base : starts[b - 1] + sizes[b - 1]]
        shards.append((part, *_least_in_shard(part, starts[a:b] - base, sizes[a:b], docs[a:b], length)))
    if len(shards) == 1:
        _, _, number, lowest, _, _ = shards[0]
        return lowest[number]
    kind = f"S{length}"
    merged, merged_least, own = np.empty(0, kind), np.empty(0, np.int64), []
    for part, _, _, lowest, first, owned in shards:
        groups = np.flatnonzero(owned)
        strings = part[first[groups][:, None] + np.arange(length)].reshape(-1).view(kind)
        own.append((groups, strings))
        at = blocks.found(strings, merged)
        hit = at >= 0
        merged_least[at[hit]] = np.minimum(merged_least[at[hit]], lowest[groups[hit]])
        fresh = np.concatenate((merged, strings[~hit]))
        turn = np.argsort(fresh, kind="stable")
        merged, merged_least = fresh[turn], np.concatenate((merged_least, lowest[groups[~hit]]))[turn]
    out = []
    for (_, _, number, lowest, _, _), (groups, strings) in zip(shards, own):
        final = lowest.copy()
        final[groups] = merged_least[blocks.found(strings, merged)]
        out.append(final[number])
    return np.concatenate(out)


def _decide(length: int):
    """Group function on a bucket: which strings of a shard's segments start in a smaller document."""

    def run(table: pa.Table) -> pa.Table:
        keys, docs, sizes = joined(table["keys"]), joined(table["docs"], np.int64), joined(table["sizes"], np.uint16).astype(np.int64)
        whole, _ = blocks.column(table["text"])
        distinct, least = blocks.group_min(keys, docs)
        which = np.searchsorted(distinct, keys)
        one = np.empty(len(distinct), np.int64)
        one[which] = np.arange(len(keys))
        begin = np.cumsum(sizes) - sizes
        lowest = least_documents(whole[ragged(begin[one], sizes[one])], sizes[one], least, length)
        counts = sizes[one] - length + 1
        from_ = np.cumsum(counts) - counts
        each = counts[which]
        smaller = lowest[ragged(from_[which], each)] < np.repeat(docs, each)
        bit = ragged(np.zeros(len(each), np.int64), each).astype(np.uint64)
        masks = np.bitwise_or.reduceat(smaller.astype(np.uint64) << bit, np.cumsum(each) - each)
        cut = np.cumsum([len(c.as_py()) // 8 for c in table["keys"]])[:-1]
        parts = [(k[m > 0], m[m > 0]) for k, m in zip(np.split(keys, cut), np.split(masks, cut))]
        full = [i for i, p in enumerate(parts) if len(p[0])]
        return pa.table({
            "shard": table["shard"].combine_chunks().take(pa.array(full, pa.int64())),
            "keys": blocks.binary([parts[i][0] for i in full]),
            "masks": blocks.binary([parts[i][1] for i in full]),
        })

    return run


def _remove(length: int, carried: list[str]):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        ids = ids_of(docs)
        keys, masks = joined(back["keys"]), joined(back["masks"])
        order = np.argsort(keys, kind="stable")
        keys, masks = keys[order], masks[order]
        whole, all_offsets = blocks.column(docs["text"])
        gone = np.zeros(len(whole), bool)
        parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        for lo, _, data, offsets in blocks.slices(whole, all_offsets):
            first, last, row, _ = _segments(data, offsets, length)
            if len(first):
                parts.append((_named(data, first, last, length), ids[lo + row], first + all_offsets[lo], last - first + 1))
        names, owner, start, count = (np.concatenate(p) for p in zip(*parts))
        distinct, least = blocks.group_min(names, owner)
        place = blocks.found(names, keys)
        mask = np.where(place >= 0, masks[place], np.uint64(0)) if len(keys) else np.zeros(len(names), np.uint64)
        later = owner > least[np.searchsorted(distinct, names)] if len(names) else np.empty(0, bool)
        mask = np.where(later, np.uint64(2**64 - 1), mask)
        hit = np.flatnonzero(mask)
        at = ragged(start[hit], count[hit])
        bit = (at - np.repeat(start[hit], count[hit])).astype(np.uint64)
        at = at[(np.repeat(mask[hit], count[hit]) >> bit) & np.uint64(1) > 0]
        gone = blocks.covered(len(whole), at, length) if len(at) else gone
        edge = np.zeros(len(whole) + 1, bool)
        edge[all_offsets] = True
        begins = np.flatnonzero(gone & (edge[:-1] | np.concatenate(([True], ~gone[:-1]))[: len(gone)]))
        ends = np.flatnonzero(gone & (edge[1:] | np.concatenate((~gone[1:], [True]))[: len(gone)])) + 1
        span_at = np.searchsorted(begins, all_offsets)
        base = np.repeat(all_offsets[:-1], np.diff(span_at))
        left = np.concatenate(([0], np.cumsum(~gone)))[all_offsets]
        spans = pa.StructArray.from_arrays([pa.array((begins - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["start", "end"])
        kept = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(left.astype(np.int32).tobytes()), pa.py_buffer(whole[~gone].tobytes())])
        n = np.diff(all_offsets)
        return pa.table({
            "id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n), "n_removed": pa.array(n - np.diff(left)),
            "removed": pa.ListArray.from_arrays(pa.array(span_at.astype(np.int32)), spans), "kept": kept,
            **{c: docs[c] for c in carried},
        })

    return run


def dedup_suffixes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Remove each byte under a ``length``-byte string that also starts in a smaller document.

    Strings are judged on the input and never cross documents. Returns one row per input row:
    ``id_col``, ``n_bytes``, ``n_removed``, ``removed`` (maximal runs as byte offsets, end
    exclusive) and ``kept`` (remaining bytes; they may cut a character in two).

    Null texts count as empty; texts shorter than ``length`` stay whole. Rows with the same id
    are one document for the comparison: none of them removes from another. A null id counts
    as larger than any other. Columns named in ``carry`` come along; others are ignored. ``length`` is 24 to 64.
    """
    if not 24 <= length <= 64:
        raise ValueError("length must be 24 to 64")
    own = [f"_k{i}" for i in range(len(carry))]
    docs = with_id(df, id_col, text=text_col, **dict(zip(own, carry)))
    total = text_bytes(docs)
    shards = sharded(docs, total)
    flags = stored(repeated_anchors(shards, _units(length), total, DENSITY)[0], "suffix-anchors")
    buckets = groups_for(total, SUFFIX_BYTES)
    sent = shards.groupBy("shard").cogroup(flags.groupBy("shard")).applyInArrow(_send(length, buckets), SENT)
    decided = stored(sent.groupBy("bucket").applyInArrow(_decide(length), BACK), "suffix-repeats")
    discard(flags)
    whole = sharded(docs, total, extra=own)
    schema = ", ".join([RESULT, *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in own)])
    done = whole.groupBy("shard").cogroup(decided.groupBy("shard")).applyInArrow(_remove(length, own), schema)
    brought = [F.col(c).alias(name) for c, name in zip(own, carry)]
    return done.select(public_id(id_col), "n_bytes", "n_removed", "removed", "kept", *brought)


def whole_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column ``kept`` as text; characters that a cut went through are dropped."""
    for batch in batches:
        cells = [c.as_py().decode("utf-8", "ignore") for c in batch.column("kept")]
        yield batch.set_column(batch.schema.get_field_index("kept"), "kept", pa.array(cells, pa.string()))


def digest(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )
