"""A public SentencePiece vocabulary as plain arrays, and texts as chunks of code points."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from parlance.llm import blocks
from parlance.llm.blocks import ragged

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581  # the mark that stands for a blank
LITERAL = 0x110000  # a mark that was in the text itself; no vocabulary has it
NEWLINE = 10
_FREE = -1 << 62
#: Code points of text that are worked on together.
GROUP_BYTES = 1 << 19


@dataclass
class Vocabulary:
    """Pieces with scores; ids of characters, pairs that merge, and bytes of every id."""

    pieces: list[str]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray

    def __post_init__(self) -> None:
        ids = [i for i in np.flatnonzero(self.normal).tolist()]
        known = {self.pieces[i]: i for i in ids}
        order = np.lexsort((np.arange(len(self.scores)), -self.scores))
        self.priority = np.empty(len(order), np.int64)
        self.priority[order] = np.arange(len(order))
        self.by_priority = order
        self.char_ids = np.full(LITERAL + 1, -1, np.int32)
        for piece, i in known.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
        pairs = {}
        for piece, i in known.items():
            for cut in range(1, len(piece)):
                left, right = known.get(piece[:cut]), known.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * len(self.pieces) + right] = i
        self._hash_pairs(pairs)
        table = [b""] * len(self.pieces)
        for i in ids:
            table[i] = self.pieces[i].replace(chr(SPACE), " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            table[i] = bytes([b])
        self.sizes = np.array([len(t) for t in table], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.known = known
        self.longest = max(map(len, known), default=0)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that two neighbouring symbols merge to, or -1; negative symbols never merge."""
        keys = left * len(self.pieces) + right
        slots = self._slots(keys)
        held = self.pair_keys[slots]
        out = np.where(held == keys, self.pair_ids[slots], -1)
        more = np.flatnonzero((held != keys) & (held != _FREE))
        while len(more):  # another pair is there: look in the next slot
            slots[more] = (slots[more] + 1) & (len(self.pair_keys) - 1)
            held = self.pair_keys[slots[more]]
            out[more] = np.where(held == keys[more], self.pair_ids[slots[more]], -1)
            more = more[(held != keys[more]) & (held != _FREE)]
        out[(left < 0) | (right < 0)] = -1
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        bits = len(self.pair_keys).bit_length() - 1
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _hash_pairs(self, pairs: dict[int, int]) -> None:
        """Pairs in an open table, a quarter full at most."""
        self.pair_keys = np.full(1 << max(4, (4 * len(pairs)).bit_length()), _FREE, np.int64)
        self.pair_ids = np.full(len(self.pair_keys), -1, np.int32)
        keys = np.array(list(pairs), np.int64)
        for key, slot in zip(keys.tolist(), self._slots(keys).tolist()):
            while self.pair_keys[slot] != _FREE:
                slot = (slot + 1) % len(self.pair_keys)
            self.pair_keys[slot], self.pair_ids[slot] = key, pairs[key]


def load_vocabulary(path: str = PIECE_MODEL) -> Vocabulary:
    """Read on the driver; executors get it as a broadcast of a few megabytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    normal = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)])
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    return Vocabulary([model.id_to_piece(i) for i in range(n)], np.array([model.get_score(i) for i in range(n)]), normal, byte_ids)


def groups(values, limit: int = GROUP_BYTES):
    """``(first row, row after the last, code points, row limits)`` of a text column."""
    data, offsets = blocks.column(values)
    for lo, hi, part, at in blocks.slices(data, offsets, limit):
        lead = (part & 0xC0) != 0x80
        limits = np.concatenate(([0], np.cumsum(lead)))[at]
        yield lo, hi, np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64), limits


def chunks(codes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked code points, chunk starts (with the end) and the first chunk of every row.

    A mark stands before every non-empty row and for every blank. A chunk is a run of marks
    with what follows up to the next mark or line end; a line end is a chunk of its own. No
    piece of the vocabulary reaches over a chunk's limits.
    """
    full = np.flatnonzero(np.diff(limits))
    text = codes.copy()
    text[codes == SPACE] = LITERAL
    text[codes == 32] = SPACE
    text = np.insert(text, limits[full], SPACE)
    before = np.zeros(len(limits), np.int64)
    before[1:] = np.cumsum(np.diff(limits) > 0)
    rows = limits + before
    begin = np.zeros(len(text), bool)
    if len(text):
        mark, line = text == SPACE, text == NEWLINE
        begin[1:] = (mark[1:] & ~mark[:-1]) | line[1:] | line[:-1]
        begin[rows[full]] = True
    starts = np.flatnonzero(begin)
    return text, np.append(starts, len(text)), np.searchsorted(starts, rows)


def distinct(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name of every distinct chunk, one place of each, and which one each chunk is."""
    if len(starts) < 2:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    names = blocks.quick_names(text.astype(np.uint64) + np.uint64(1), starts[:-1], starts[1:])
    size = np.diff(starts)
    names ^= blocks.mix(size.astype(np.uint64))
    every, (names, place, which) = names, np.unique(names, return_index=True, return_inverse=True)
    shared = np.flatnonzero(place[which] != np.arange(len(which)))  # code points decide, not the names
    twin = place[which[shared]]
    same = size[shared] == size[twin]
    at, other = ragged(starts[shared[same]], size[shared[same]]), ragged(starts[twin[same]], size[shared[same]])
    if not same.all() or (text[at] != text[other]).any():
        whole = [text[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
        number = {c: i for i, c in enumerate(dict.fromkeys(whole))}
        which = np.array([number[c] for c in whole])
        place = np.unique(which, return_index=True)[1]
        names = every[place]
    return names, place, which


def lists(values: np.ndarray, offsets: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(kind)))
