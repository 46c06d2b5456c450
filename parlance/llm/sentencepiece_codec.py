"""Byte-pair encoding with seeded merge-dropout, and lossless decoding.

Neighbouring symbols of a chunk merge by the score of the merged piece, best first and
leftmost among equals. With dropout each candidate merge is skipped when a keyed hash of the
seed, the chunk, its document, copy and place there, the place in it and the piece falls under
the rate. So every occurrence of a word draws for itself, and the same document always gets
the same pieces. Occurrences share work only if none of the merges they make is skipped.

All distinct chunks of half a megabyte of text are worked on side by side: a step takes the
best candidate of each. Chunks of more than ``LONG`` symbols use a priority queue one by one;
both give the same pieces. Characters that are no piece become byte pieces, as does a mark
that was in the text itself, so decoding restores every text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import blocks
from parlance.llm.blocks import ragged
from parlance.llm.pieces import LITERAL, PIECE_MODEL, SPACE, Vocabulary, chunks, distinct, groups, lists, load_vocabulary
from parlance.llm.store import public_id, with_id

LONG = 64
#: Chunks with a skipped merge that are worked on side by side.
SIDE_ROWS = 1 << 14
RESULT = "id long, n_tokens long, token_ids array<int>, lossless boolean"
_NEVER = np.iinfo(np.int32).max


def skipped(keys: np.ndarray, places: np.ndarray, pieces: np.ndarray, rate: float) -> np.ndarray:
    """Whether a candidate merge is skipped: a hash of chunk key, place and piece under the rate."""
    if rate <= 0:
        return np.zeros(len(keys), bool)
    drawn = blocks.mix(keys ^ blocks.mix(places.astype(np.uint64) << np.uint64(32) | pieces.astype(np.uint64)))
    return (drawn >> np.uint64(11)).astype(np.float64) / 2.0**53 < rate


def merge_side_by_side(
    vocab: Vocabulary, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, rate: float, met: list | None = None, pairs: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of padded rows, and how many each has.

    ``met`` gets row, place and piece of every merge that is made; ``pairs`` has the pieces that
    neighbours of the rows as given make, if they are known.
    """
    symbols, sizes = symbols.astype(np.int32), sizes.copy()
    rows, width = symbols.shape
    places = np.tile(np.arange(width, dtype=np.int32), (rows, 1))
    best = np.full((rows, max(width - 1, 1)), _NEVER, np.int32)

    def offer(r: np.ndarray, c: np.ndarray, piece: np.ndarray | None = None) -> None:
        if piece is None:
            piece = vocab.merged(symbols[r, c].astype(np.int64), symbols[r, c + 1].astype(np.int64))
        piece[c + 1 >= sizes[r]] = -1
        good = piece >= 0
        good[good] = ~skipped(keys[r[good]], places[r[good], c[good]], piece[good], rate)
        best[r, c] = np.where(good, vocab.priority[piece], _NEVER)

    r, c = np.nonzero(np.arange(max(width - 1, 0)) + 1 < sizes[:, None])
    offer(r, c, None if pairs is None else pairs[r, c])
    live = np.arange(rows)
    columns = np.arange(width)
    while len(live):
        at = best[live].argmin(axis=1)
        score = best[live, at]
        go = score < _NEVER
        live, at, score = live[go], at[go], score[go]
        if not len(live):
            break
        symbols[live, at] = vocab.by_priority[score]
        if met is not None:
            met.append((live, places[live, at], vocab.by_priority[score]))
        shift = np.minimum(columns + (columns > at[:, None]), width - 1)
        symbols[live] = np.take_along_axis(symbols[live], shift, 1)
        places[live] = np.take_along_axis(places[live], shift, 1)
        gaps = shift[:, : width - 1]
        best[live] = np.where(gaps < width - 1, np.take_along_axis(best[live], np.minimum(gaps, width - 2), 1), _NEVER)
        sizes[live] -= 1
        left = at > 0
        offer(live[left], at[left] - 1)
        right = at + 1 < sizes[live]
        offer(live[right], at[right])
        best[live[~right], at[~right]] = _NEVER
    return symbols, sizes


def merge_by_queue(vocab: Vocabulary, symbols: list[int], key: np.uint64, rate: float) -> list[int]:
    """The same for one chunk, by a priority queue over linked symbols."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols = list(symbols)
    queue: list[tuple] = []

    def offer(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and after[i] < n]
        if not lefts:
            return
        a, b = np.array([symbols[i] for i in lefts]), np.array([symbols[after[i]] for i in lefts])
        piece = vocab.merged(a, b)
        good = piece >= 0
        good[good] = ~skipped(np.full(good.sum(), key), np.array(lefts)[good], piece[good], rate)
        for i, p, ok in zip(lefts, piece.tolist(), good.tolist()):
            if ok:
                heapq.heappush(queue, (int(vocab.priority[p]), i, symbols[i], symbols[after[i]], p))

    offer(list(range(n - 1)))
    while queue:
        _, i, a, b, piece = heapq.heappop(queue)
        if symbols[i] != a or after[i] >= n or symbols[after[i]] != b:
            continue
        gone = after[i]
        symbols[i], symbols[gone] = piece, None
        after[i] = after[gone]
        if after[gone] < n:
            before[after[gone]] = i
        offer([before[i], i])
    return [s for s in symbols if s is not None]


def _merge_all(
    vocab: Vocabulary, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: np.ndarray, rate: float, pairs: np.ndarray, met: list | None = None
):
    """Merged symbols of chunks in order, where each chunk's begin, and how many each has.

    ``begin`` may be that of an equal chunk; ``pairs`` has the piece that each symbol makes
    with the next one.
    """
    parts, counts, owners = [np.empty(0, np.int64)], np.zeros(len(size), np.int64), [np.empty(0, np.int64)]
    edges = [1, 2, 4, 6, 8, 10, 12, 16, 24, 40, LONG]
    for low, high in zip([0, *edges[:-1]], edges):
        group = np.flatnonzero((size > low) & (size <= high))
        for at in range(0, len(group), SIDE_ROWS):
            mine = group[at : at + SIDE_ROWS]
            grid = begin[mine][:, None] + np.minimum(np.arange(high), size[mine][:, None] - 1)
            seen: list | None = None if met is None else []
            merged, left = merge_side_by_side(vocab, symbols[grid], size[mine], keys[mine], rate, seen, pairs[grid[:, :-1]])
            if met is not None:
                met += [(mine[r], place, piece) for r, place, piece in seen]
            parts.append(merged[np.arange(high) < left[:, None]])
            owners.append(mine)
            counts[mine] = left
    for i in np.flatnonzero(size > LONG).tolist():
        merged = merge_by_queue(vocab, symbols[begin[i] : begin[i] + size[i]].tolist(), keys[i], rate)
        parts.append(np.array(merged, np.int64))
        owners.append(np.array([i]))
        counts[i] = len(merged)
    flat, owner = np.concatenate(parts), np.concatenate(owners)
    first = np.zeros(len(size), np.int64)
    first[owner] = np.cumsum(counts[owner]) - counts[owner]
    return flat, first, counts


def _with_skips(met: list, which: np.ndarray, n: int, keys: np.ndarray, rate: float) -> np.ndarray:
    """Whether a chunk skips one of the merges that its distinct chunk makes."""
    owner, place, piece = (np.concatenate([np.empty(0, np.int64), *[m[i] for m in met]]) for i in range(3))
    order = np.argsort(owner, kind="stable")
    place, piece = place[order], piece[order]
    each = np.bincount(owner, minlength=n)
    start = np.cumsum(each) - each
    hit = np.zeros(len(which), bool)
    for lo in range(0, len(which), SIDE_ROWS):
        mine = which[lo : lo + SIDE_ROWS]
        at = ragged(start[mine], each[mine])
        row = np.repeat(np.arange(lo, lo + len(mine)), each[mine])
        hit[row[skipped(keys[row], place[at], piece[at], rate)]] = True
    return hit


def encode(vocab: Vocabulary, text: np.ndarray, starts: np.ndarray, salt: np.ndarray, seed: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all chunks in order, and where each chunk's begin.

    Distinct chunks are merged once without dropout; chunks that skip a merge of that are
    merged again one by one, with their own draws. Skips of candidates that others overtake
    change nothing: the best of all candidates is also the best of those not skipped.
    """
    names, place, which = distinct(text, starts)
    begin, size = starts[:-1], np.diff(starts)
    ids = vocab.char_ids[text].astype(np.int64)
    symbols = np.where(ids >= 0, ids, -1 - text)
    met: list | None = [] if rate > 0 else None
    short = np.flatnonzero(size[place] <= LONG) if rate > 0 else np.arange(len(place))
    one = begin[place]  # every occurrence of a chunk is worked on where its first one stands
    inside = ragged(one, np.maximum(size[place] - 1, 0))
    pairs = np.full(len(symbols), -1, np.int64)
    pairs[inside] = vocab.merged(symbols[inside], symbols[inside + 1])
    flat, first_short, counts_short = _merge_all(vocab, symbols, one[short], size[place[short]], names[short], 0.0, pairs, met)
    first, counts = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    first[short], counts[short] = first_short, counts_short
    first, counts = first[which], counts[which]
    if rate > 0:
        keys = blocks.mix(names[which] ^ salt, seed)
        own = size > LONG
        own |= _with_skips([(short[r], p, m) for r, p, m in met], which, len(place), keys, rate)
        again = np.flatnonzero(own)
        other, first_own, counts_own = _merge_all(vocab, symbols, one[which[again]], size[again], keys[again], rate, pairs)
        first[again], counts[again] = first_own + len(flat), counts_own
        flat = np.concatenate((flat, other))
    return _with_bytes(vocab, flat[ragged(first, counts)], np.concatenate(([0], np.cumsum(counts))))


def _with_bytes(vocab: Vocabulary, tokens: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte pieces in place of characters that are no piece."""
    odd = np.flatnonzero(tokens < 0)
    if not len(odd):
        return tokens, limits
    codes, back = np.unique(-1 - tokens[odd], return_inverse=True)
    spelled = [vocab.byte_ids[list(chr(SPACE if c == LITERAL else c).encode())] for c in codes.tolist()]
    each = np.ones(len(tokens), np.int64)
    each[odd] = np.array([len(s) for s in spelled])[back]
    at = np.concatenate(([0], np.cumsum(each)))
    out = np.empty(at[-1], np.int64)
    plain = tokens >= 0
    out[at[:-1][plain]] = tokens[plain]
    sizes = each[odd]
    table = np.concatenate(spelled)
    start = np.cumsum([len(s) for s in spelled]) - np.array([len(s) for s in spelled])
    out[ragged(at[odd], sizes)] = table[ragged(start[back], sizes)]
    return out, at[limits]


def decode(vocab: Vocabulary, tokens: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows of tokens, without the mark before each, and where the rows begin."""
    sizes = vocab.sizes[tokens]
    data = vocab.bytes[ragged(vocab.starts[tokens], sizes)]
    at = np.concatenate(([0], np.cumsum(sizes)))[limits]
    full = np.flatnonzero(np.diff(at))
    keep = np.ones(len(data), bool)
    keep[at[full]] = False
    before = np.concatenate(([0], np.cumsum(np.diff(at) > 0)))
    return data[keep], at - before


def _run(held, seed: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = held.value
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("id").to_numpy().astype(np.int64)
            ids = blocks.mix(ids.astype(np.uint64), seed) + blocks.mix(batch.column("copy").to_numpy().astype(np.uint64), seed + 1)
            for lo, hi, codes, limits in groups(texts):
                text, starts, rows = chunks(codes, limits)
                row = np.repeat(np.arange(hi - lo), np.diff(rows))
                turn = np.arange(len(row)) - rows[row]
                salt = blocks.mix(blocks.mix(ids[lo + row]) + blocks.mix(turn.astype(np.uint64)))
                tokens, at = encode(vocab, text, starts, salt, seed, rate)
                ends = at[rows]
                data, back = decode(vocab, tokens, ends)
                raw, offsets = blocks.column(texts.slice(lo, hi - lo))
                differs = np.concatenate(([0], np.cumsum(data != raw))) if len(data) == len(raw) else None
                same = np.diff(differs[offsets]) == 0 if differs is not None else np.zeros(hi - lo, bool)
                same &= np.diff(back) == np.diff(offsets)
                yield pa.record_batch([
                    batch.column("id").slice(lo, hi - lo), pa.array(np.diff(ends)), lists(tokens, ends, np.int32), pa.array(same),
                ], names=["id", "n_tokens", "token_ids", "lossless"])

    return run


def _decode_run(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("token_ids").fill_null([])
            sizes = np.array(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            limits = np.concatenate(([0], np.cumsum(sizes)))
            data, at = decode(held.value, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), limits)
            text = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.record_batch([batch.column("id"), text], names=["id", "text"])

    return run


def encode_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1, seed: int = 11, model: str = PIECE_MODEL,
    copy_col: str | None = None,
) -> DataFrame:
    """``id_col``, ``n_tokens``, ``token_ids`` and ``lossless`` of every row.

    ``lossless`` says whether decoding gave back the text. At a rate of zero the pieces are
    those of the vocabulary's own encoder (a literal mark aside, which that one reads as a
    blank). Null and empty texts have no tokens and are lossless. Equal ids with equal texts
    get equal tokens, unless ``copy_col`` tells the copies apart by number; all rows without an
    id count as one id. Other columns are ignored.
    """
    docs = with_id(df, id_col, text=text_col, **({"copy": copy_col} if copy_col else {}))
    docs = docs.withColumn("copy", F.coalesce(F.col("copy").cast("long"), F.lit(0)) if copy_col else F.lit(0).cast("long"))
    held = df.sparkSession.sparkContext.broadcast(load_vocabulary(model))
    done = docs.select("id", "text", "copy").mapInArrow(_run(held, seed, rate), RESULT)
    return done.select(public_id(id_col), "n_tokens", "token_ids", "lossless")


def decode_tokens(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "token_ids", model: str = PIECE_MODEL) -> DataFrame:
    """``id_col`` and ``text`` of rows of token ids; null tokens give an empty text."""
    rows = with_id(df, id_col, token_ids=tokens_col)
    held = df.sparkSession.sparkContext.broadcast(load_vocabulary(model))
    return rows.select("id", "token_ids").mapInArrow(_decode_run(held), "id long, text string").select(public_id(id_col), "text")
