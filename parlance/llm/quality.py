"""Quality rules, and an n-gram likelihood ratio of a trusted sample to the whole corpus.

Two kinds of n-grams are counted in all documents and in the trusted ones (quality 1, not
toxic): runs of ``GRAM`` bytes, hashed to ``BUCKETS`` counters, and the distinct words of a
document, in ASCII lower case, by hash. The log ratio of an n-gram is::

    log((trusted - own + smooth) / (share * (corpus - own) + smooth))

``share`` is the trusted part of all n-grams and ``own`` what the document itself holds, so no
document speaks for itself and scores of trusted and other documents mean the same. An n-gram
that the sample is too small to judge has a ratio near zero: the rule is one at every size.

A document's ``llr`` is the mean over its byte n-grams; ``low_llr`` is the mean of its
``LOWEST`` lowest word ratios, those above ``-TELLING`` counting as zero, which tells a few
telling words in a long clean text. Each has a cut: the 1 % quantile of the trusted documents
that pass the base rules, less the inverse root of their number.

The byte model has a fixed size. Words are counted by Spark, over all documents, and grow with
the corpus; only those that can fall to ``-TELLING`` reach the workers. Each of them is
expected at least ``(e ** TELLING - 1) * smooth`` times in the trusted sample, which
``TRUSTED_ROWS`` bounds, so their number is under a third of the sample's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import blocks
from parlance.llm.store import NO_ID, discard, pick, place, public_id, stored, with_id

BUCKETS = 1 << 16
#: Bytes in an n-gram.
GRAM = 3
#: Smoothing of the ratios, in counts, of bytes and of words.
SMOOTH_BYTES, SMOOTH_WORDS = 2.0, 0.5
#: Word ratios count from ``-TELLING`` down, and so many of a document.
TELLING, LOWEST = 2.0, 3
#: Trusted documents at most, those with the smallest hashes of their ids; bounds a broadcast.
TRUSTED_ROWS = 100_000
#: The cuts lie at this quantile of the trusted documents' scores.
CUT_QUANTILE = 0.01
#: Words that a task gathers before it sums them up.
GATHERED_WORDS = 1 << 20
#: Counters travel in so many parts, to be summed by different tasks.
PARTS = 64

#: Fixed values of the base rules: symbols, least words, largest percentage of repeated words.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5

RESULT = (
    "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, llr double, low_llr double, kept boolean"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _per_row(hits: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(hits)))[offsets])


def _salted(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a row."""
    return blocks.mix(hashes + blocks.mix(rows.astype(np.uint64)))


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple:
    """Words of each row and its four base counts."""
    rows = len(offsets) - 1
    starts, ends, first = blocks.words(data, offsets)
    n_words = np.diff(first)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1]) > 0
    word_chars = _per_row(inside & ((data & 0xC0) != 0x80), offsets)
    n_symbols = _per_row(_SYMBOL[data], offsets)

    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:] |= data == 10
    line_start = np.flatnonzero(edge[:-1])
    line_end = np.append(line_start[1:], len(data))
    line_end -= (data[np.maximum(line_end - 1, 0)] == 10) & (line_end > line_start)
    with_word = np.concatenate(([0], np.cumsum(inside)))
    full = with_word[line_end] > with_word[line_start]
    line_start, line_end = line_start[full], line_end[full]
    prefix = blocks.byte_prefix(data)
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    lines = _salted(blocks.span_hash(prefix, line_start, line_end) ^ blocks.mix((line_end - line_start).astype(np.uint64)), line_row)
    _, once = np.unique(lines, return_index=True)
    n_dup = np.bincount(line_row, minlength=rows) - np.bincount(line_row[once], minlength=rows)

    hashes = blocks.span_hash(prefix, starts, ends) if len(starts) else np.empty(0, np.uint64)
    at, row = blocks.window_starts(first, REPEAT_WINDOW), blocks.rows_of(first, REPEAT_WINDOW)
    runs = _salted(blocks.run_hashes(hashes, REPEAT_WINDOW)[at], row) if len(at) else np.empty(0, np.uint64)
    _, which, count = np.unique(runs, return_inverse=True, return_counts=True)
    again = blocks.covered(len(starts), at[count[which] > 1], REPEAT_WINDOW) if len(at) else np.zeros(len(starts), bool)
    return n_words, word_chars, n_symbols, n_dup, _per_row(again, first)


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram that lies in one row."""
    at, row = blocks.window_starts(offsets, GRAM), blocks.rows_of(offsets, GRAM)
    grams = blocks.byte_runs(data, GRAM)[at] if len(at) else np.empty(0, np.uint64)
    return (grams >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), row


def word_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and count of the distinct words of every row, in ASCII lower case."""
    starts, ends, first = blocks.words(data, offsets)
    hashes = blocks.word_hashes(blocks.lower_ascii(data), starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])))[: len(row)])
    return hashes[new], row[new], np.diff(np.append(new, len(row)))


def trusted_ids(labels: DataFrame, limit: int, id_col: str, quality_col: str, toxic_col: str) -> np.ndarray:
    """Sorted ids that every label calls good and none toxic, ``limit`` at most, by hash order."""
    marks = pick(labels, id=id_col, quality=quality_col, toxic=toxic_col).where("id is not null")
    rows = marks.groupBy(F.col("id").cast("long").alias("id")).agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")
    )
    ids = rows.where("q = 1 and t = 0").orderBy(F.xxhash64("id"), "id").limit(limit).select("id")
    return np.sort(np.array([r[0] for r in ids.collect()], np.int64))


def _count(trusted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            ids = batch.column("id").to_numpy().astype(np.int64)
            for lo, hi, data, offsets in blocks.slices(*blocks.column(batch.column("text"))):
                bucket, row = ngram_buckets(data, offsets)
                counts[0] += np.bincount(bucket, minlength=BUCKETS)
                good = blocks.found(ids[lo:hi], trusted.value) >= 0
                counts[1] += np.bincount(bucket[good[row]], minlength=BUCKETS)
        if counts[0].any():
            parts = [np.ascontiguousarray(p) for p in np.split(counts, PARTS, axis=1)]
            yield pa.record_batch({"part": pa.array(range(PARTS), pa.int32()), "counts": blocks.binary(parts)})

    return run


def _sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), np.int64) for c in table["counts"])
    return pa.table({"part": table["part"][:1], "counts": blocks.binary([total])})


@dataclass
class Model:
    """Trusted ids, counts of bytes and of telling words (corpus, then trusted), and the cuts."""

    trusted: np.ndarray
    bytes_: np.ndarray
    words: np.ndarray
    word_counts: np.ndarray
    word_share: float
    cut: float = -np.inf
    low_cut: float = -np.inf

    def byte_ratios(self, data: np.ndarray, offsets: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Mean log ratio of every row; ``good`` rows are trusted ones."""
        bucket, row = ngram_buckets(data, offsets)
        size = np.bincount(row, minlength=len(good))
        corpus, trusted = self.bytes_
        share = trusted.sum() / max(corpus.sum(), 1)
        out = np.zeros(len(good))
        for i, mine in enumerate(np.split(bucket, np.cumsum(size)[:-1])):
            if len(mine):
                own = np.bincount(mine, minlength=BUCKETS)[mine]
                left = trusted[mine] - own * good[i] + SMOOTH_BYTES
                out[i] = np.log(left / (share * (corpus[mine] - own) + SMOOTH_BYTES)).mean()
        return out

    def word_ratios(self, data: np.ndarray, offsets: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Mean of the lowest log ratios of the words of every row."""
        hashes, row, own = word_counts(data, offsets)
        at = blocks.found(hashes, self.words)
        known = at >= 0
        at, row, own = at[known], row[known], own[known]
        corpus, trusted = self.word_counts
        logs = np.log((trusted[at] - own * good[row] + SMOOTH_WORDS) / (self.word_share * (corpus[at] - own) + SMOOTH_WORDS))
        low = np.flatnonzero(logs <= -TELLING)
        low = low[np.lexsort((logs[low], row[low]))]
        begin = np.searchsorted(row[low], row[low])
        low = low[np.arange(len(low)) - begin < LOWEST]
        return np.bincount(row[low], logs[low], len(good)) / LOWEST

    def ratios(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = blocks.found(ids, self.trusted) >= 0
        return self.byte_ratios(data, offsets, good), self.word_ratios(data, offsets, good)


def byte_counts(docs: DataFrame, trusted: np.ndarray) -> np.ndarray:
    """N-grams of the corpus and of its trusted documents in every bucket."""
    held = docs.sparkSession.sparkContext.broadcast(trusted)
    parts = docs.select("id", "text").mapInArrow(_count(held), "part int, counts binary")
    counts = np.zeros((2, BUCKETS), np.int64)
    width = BUCKETS // PARTS
    for part, cell in parts.groupBy("part").applyInArrow(_sum, "part int, counts binary").collect():  # PARTS rows
        counts[:, part * width : (part + 1) * width] = np.frombuffer(bytes(cell), np.int64).reshape(2, width)
    return counts


def _count_words(trusted):
    """Corpus and trusted counts of a task's words, and the most that one trusted document has."""

    def summed(parts: list) -> list[np.ndarray]:
        words, corpus, good, most = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(words, kind="stable")
        words = words[order]
        first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        sums = [np.add.reduceat(c[order], first) for c in (corpus, good)]
        return [words[first], *sums, np.maximum.reduceat(most[order], first)]

    def batch(parts: list) -> pa.RecordBatch:
        words, *counts = summed(parts)
        return pa.record_batch([pa.array(words.view(np.int64)), *map(pa.array, counts)], names=["word", "corpus", "good", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for rows in batches:
            ids = rows.column("id").to_numpy().astype(np.int64)
            for lo, hi, data, offsets in blocks.slices(*blocks.column(rows.column("text"))):
                hashes, row, own = word_counts(data, offsets)
                if len(hashes):
                    mine = np.where(blocks.found(ids[lo:hi], trusted.value)[row] >= 0, own, 0)
                    parts.append(summed([(hashes, own, mine, mine)]))
                    size += len(parts[-1][0])
                if size >= GATHERED_WORDS:
                    yield batch(parts)
                    parts, size = [], 0
        if parts:
            yield batch(parts)

    return run


def telling_words(docs: DataFrame, trusted: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted hashes and counts of the words whose ratio can fall to ``-TELLING`` for some document.

    And the trusted share of all words.
    """
    held = docs.sparkSession.sparkContext.broadcast(trusted)
    parts = docs.select("id", "text").mapInArrow(_count_words(held), "word long, corpus long, good long, most long")
    sums = parts.groupBy("word").agg(F.sum("corpus").alias("corpus"), F.sum("good").alias("good"), F.max("most").alias("most"))
    sums = stored(sums, "quality-words")
    corpus, good = sums.agg(F.sum("corpus"), F.sum("good")).first()
    share = (good or 0) / (corpus or 1)
    least = F.col("good") - F.col("most") + SMOOTH_WORDS
    rows = sums.where(least <= float(np.exp(-TELLING)) * (share * F.col("corpus") + SMOOTH_WORDS) * (1 + 1e-9)).toArrow()
    words = rows["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    counts = np.stack([rows[c].to_numpy().astype(np.int64)[order] for c in ("corpus", "good")])
    discard(sums)
    return words[order], counts, share


def base_failures(n_words: np.ndarray, again: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n_words)


def _trusted_scores(model):
    """Both scores of the trusted documents that pass the base rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy().astype(np.int64)
            mine = np.flatnonzero(blocks.found(ids, model.value.trusted) >= 0)
            ids, texts = ids[mine], batch.column("text").take(pa.array(mine))
            for lo, hi, data, offsets in blocks.slices(*blocks.column(texts)):
                n_words, _, _, _, again = base_counts(data, offsets)
                passed = ~base_failures(n_words, again)
                scores = [x[passed] for x in model.value.ratios(ids[lo:hi], data, offsets)]
                yield pa.record_batch([pa.array(x) for x in scores], names=["llr", "low_llr"])

    return run


def _columns(ids: np.ndarray, texts: pa.Array, model: Model) -> list[np.ndarray]:
    """The result columns after the id, for a batch of at least one text."""
    out = []
    for lo, hi, data, offsets in blocks.slices(*blocks.column(texts)):
        n_words, chars, symbols, dup, again = base_counts(data, offsets)
        failed = base_failures(n_words, again)
        llr, low = model.ratios(ids[lo:hi], data, offsets)
        out.append((n_words, chars, symbols, dup, again, failed, llr, low, ~failed & (llr >= model.cut) & (low >= model.low_cut)))
    return [np.concatenate(c) for c in zip(*out)]


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RESULT.split(", ")[1:]]
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").to_numpy().astype(np.int64)
                columns = _columns(ids, batch.column("text"), model.value)
                yield pa.record_batch({"id": batch.column("id"), **{n: pa.array(c) for n, c in zip(names, columns)}})

    return run


def _keep(model, id_at: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(id_at).cast(pa.int64()).fill_null(NO_ID).to_numpy().astype(np.int64)
                yield batch.filter(pa.array(_columns(ids, batch.column(text_at), model.value)[-1]))

    return run


def fitted(docs: DataFrame, labels: DataFrame | None, trusted_rows: int, threshold: float | None, label_cols: tuple):
    """The broadcast model of documents ``(id, text)``."""
    send = docs.sparkSession.sparkContext.broadcast
    trusted = np.empty(0, np.int64) if labels is None else trusted_ids(labels, trusted_rows, *label_cols)
    if len(trusted):
        model = Model(trusted, byte_counts(docs, trusted), *telling_words(docs, trusted))
    else:  # nothing to compare with: every ratio is zero
        model = Model(trusted, np.zeros((2, BUCKETS), np.int64), np.empty(0, np.uint64), np.zeros((2, 0), np.int64), 0.0)
    scores = docs.select("id", "text").mapInArrow(_trusted_scores(send(model)), "llr double, low_llr double")
    low = [F.percentile(c, F.lit(CUT_QUANTILE)) for c in ("llr", "low_llr")]
    n, *cuts = scores.agg(F.count(F.lit(1)), *low).first() if len(trusted) else (0, None, None)
    margin = max(n, 1) ** -0.5
    model.cut, model.low_cut = ((x or 0.0) - margin for x in cuts)
    if threshold is not None:
        model.cut = threshold
    return send(model)


def keep_documents(
    df: DataFrame,
    labels: DataFrame | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float | None = None,
    trusted_rows: int = TRUSTED_ROWS,
    label_cols: tuple[str, str, str] = ("doc_id", "quality", "toxic"),
) -> DataFrame:
    """The rows of ``df``, whole and unchanged, that :func:`score_documents` keeps.

    Columns may repeat a name; the first one counts. Rows are judged one by one, so nothing is shuffled.
    """
    held = fitted(with_id(df, id_col, text=text_col), labels, trusted_rows, threshold, label_cols)
    return df.mapInArrow(_keep(held, place(df.columns, id_col), place(df.columns, text_col)), df.schema)


def score_documents(
    df: DataFrame,
    labels: DataFrame | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float | None = None,
    trusted_rows: int = TRUSTED_ROWS,
    label_cols: tuple[str, str, str] = ("doc_id", "quality", "toxic"),
) -> DataFrame:
    """Base counts, mean log ratio and verdict of every document, one row per input row.

    ``labels`` names the trusted sample: ids that every label calls good and none toxic. A given
    ``threshold`` replaces the fitted cut of ``llr``. Without a trusted document all ratios are
    zero and only the base rules decide. Null or blank texts have no words and fail the base
    rules; without bytes their ratio is zero. Equal rows get equal results, all rows of a
    trusted id are trusted, and a null id, which none is, stays null. Other columns are ignored.
    """
    docs = with_id(df, id_col, text=text_col)
    held = fitted(docs, labels, trusted_rows, threshold, label_cols)
    done = docs.select("id", "text").mapInArrow(_score(held), RESULT)
    return done.select(public_id(id_col), *[c.split()[0] for c in RESULT.split(", ")[1:]])
