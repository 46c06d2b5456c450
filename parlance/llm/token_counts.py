"""Token counts by a unigram segmentation, computed once per shared prefix.

The distinct pre-tokens of half a megabyte of text form a trie, held level by level: a node is
a distinct prefix, named by a rolling hash. The best forward score of a node comes from its
ancestors and the vocabulary pieces that end there, so a prefix shared by many pre-tokens is
scored once. The number of tokens on the best path is kept with every node; the node where a
pre-token ends gives its count. The scores are not those of a trained unigram model.

Piece scores are Zipf log probabilities of the piece's place in the public vocabulary,
``-log(place + 1)``: nothing is trained. A character that is no piece costs its byte pieces.
Ties go to fewer tokens, then to the longer last piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm import blocks
from parlance.llm.pieces import LITERAL, PIECE_MODEL, Vocabulary, chunks, distinct, groups, load_vocabulary
from parlance.llm.store import public_id, with_id

RESULT = "id long, n_pretokens long, n_tokens long"
#: Log probability of a byte piece, under that of any other piece.
BYTE_SCORE = -20.0
#: Letters of a pre-token up to which it takes part in the trie.
LONG = 256


class Scores:
    """Hashed pieces with scores, to be looked up by length."""

    def __init__(self, vocab: Vocabulary):
        ids = np.array(sorted(vocab.known.values()), np.int64)
        place = np.argsort(np.argsort(vocab.priority[ids]))
        words = [np.array([ord(c) for c in vocab.pieces[i]], np.uint64) for i in ids]
        names = np.array([blocks.span_hash(blocks.prefix_hash(w + np.uint64(1)), np.array([0]), np.array([len(w)]))[0] for w in words])
        order = np.argsort(names)
        self.names, self.scores = names[order], -np.log(place[order] + 1.0)
        self.sizes = np.unique([len(w) for w in words])

    def of(self, names: np.ndarray) -> np.ndarray:
        at = blocks.found(names, self.names)
        return np.where(at >= 0, self.scores[at], -np.inf)


def _walked(scores: Scores, prefix: tuple, begin: int, size: int, bytes_of: np.ndarray) -> int:
    """Tokens of the best path of one pre-token, position by position.

    All pieces of it are looked up at once, by length; the rules are those of the level walk.
    """
    ends, lengths, found = [], [], []
    for length in scores.sizes[scores.sizes <= size].tolist()[::-1]:
        stop = np.arange(length, size + 1)
        value = scores.of(blocks.span_hash(prefix, begin + stop - length, begin + stop))
        good = np.flatnonzero(np.isfinite(value))
        ends.append(stop[good])
        lengths.append(np.full(len(good), length))
        found.append(value[good])
    ends, lengths, found = (np.concatenate([np.empty(0), *x]) for x in (ends, lengths, found))
    order = np.argsort(ends, kind="stable")  # the longest piece first at every end
    first = np.searchsorted(ends[order], np.arange(1, size + 2)).tolist()
    lengths, found = lengths[order].astype(int).tolist(), found[order].tolist()
    spelled = bytes_of[begin : begin + size].tolist()
    best, tokens = [0.0], [0]
    for end in range(1, size + 1):
        high, least = -np.inf, 0
        for k in range(first[end - 1], first[end]):
            at = end - lengths[k]
            total, count = best[at] + found[k], tokens[at] + 1
            if total > high or (total == high and count < least):
                high, least = total, count
        total = best[-1] + BYTE_SCORE * spelled[end - 1]
        if total > high:
            high, least = total, tokens[-1] + spelled[end - 1]
        best.append(high)
        tokens.append(least)
    return tokens[-1]


def terminal_counts(scores: Scores, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Tokens of the best path of every distinct pre-token.

    Those of more than ``LONG`` letters, which share little, are walked one by one.
    """
    prefix = blocks.prefix_hash(text.astype(np.uint64) + np.uint64(1))
    bytes_of = np.select([text < 0x80, text < 0x800, text == LITERAL, text < 0x10000], [1, 2, 3, 3], 4)
    counts = np.zeros(len(size), np.int64)
    short = np.flatnonzero(size <= LONG)
    counts[short] = _level_counts(scores, prefix, begin[short], size[short], bytes_of)
    for i in np.flatnonzero(size > LONG).tolist():
        counts[i] = _walked(scores, prefix, int(begin[i]), int(size[i]), bytes_of)
    return counts


def _level_counts(scores: Scores, prefix: tuple, begin: np.ndarray, size: np.ndarray, bytes_of: np.ndarray) -> np.ndarray:
    """The same through the trie, level by level."""
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    reach = int(scores.sizes.max()) if len(scores.sizes) else 1
    levels = [(np.zeros(1), np.zeros(1, np.int64), np.zeros(len(begin), np.int64))]
    counts = np.zeros(len(begin), np.int64)
    for depth in range(1, int(size[0]) + 1 if len(size) else 0):
        n = int(np.searchsorted(-size, -depth, "right"))
        names = blocks.span_hash(prefix, begin[:n], begin[:n] + depth)
        _, one, node = np.unique(names, return_index=True, return_inverse=True)
        end = begin[one] + depth
        best, tokens = np.full(len(one), -np.inf), np.zeros(len(one), np.int64)
        for length in scores.sizes[scores.sizes <= depth].tolist()[::-1]:
            before_score, before_tokens, before_node = levels[-length]
            parent = before_node[one]
            total = before_score[parent] + scores.of(blocks.span_hash(prefix, end - length, end))
            count = before_tokens[parent] + 1
            better = (total > best) | ((total == best) & (count < tokens) & np.isfinite(total))
            best, tokens = np.where(better, total, best), np.where(better, count, tokens)
        before_score, before_tokens, before_node = levels[-1]
        parent, spelled = before_node[one], bytes_of[end - 1]
        total = before_score[parent] + BYTE_SCORE * spelled
        better = total > best
        best, tokens = np.where(better, total, best), np.where(better, before_tokens[parent] + spelled, tokens)
        levels = [*levels[-(reach - 1) :], (best, tokens, node)] if reach > 1 else [(best, tokens, node)]
        last = np.flatnonzero(size[:n] == depth)
        counts[last] = tokens[node[last]]
    out = np.empty(len(counts), np.int64)
    out[order] = counts
    return out


def _run(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, codes, limits in groups(batch.column("text")):
                text, starts, rows = chunks(codes, limits)
                _, place, which = distinct(text, starts)
                count = terminal_counts(held.value, text, starts[place], starts[place + 1] - starts[place])
                total = np.concatenate(([0], np.cumsum(count[which])))[rows]
                yield pa.record_batch([
                    batch.column("id").slice(lo, hi - lo), pa.array(np.diff(rows)), pa.array(np.diff(total)),
                ], names=["id", "n_pretokens", "n_tokens"])

    return run


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = PIECE_MODEL) -> DataFrame:
    """``id_col``, ``n_pretokens`` and ``n_tokens`` of every row.

    Null and empty texts have none of either. Equal texts have equal counts, a null id stays
    null, and other columns are ignored.
    """
    docs = with_id(df, id_col, text=text_col)
    held = df.sparkSession.sparkContext.broadcast(Scores(load_vocabulary(model)))
    done = docs.select("id", "text").mapInArrow(_run(held), RESULT)
    return done.select(public_id(id_col), "n_pretokens", "n_tokens")


