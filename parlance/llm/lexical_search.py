"""Ranked lexical search: the highest-scoring documents of every query, exactly.

One scan counts the terms of each document and keeps those that some query has. Totals and
document frequencies are aggregates of that table. Each task then takes its documents in
blocks, builds a ball tree over the impacts of a block and searches it for every query, best
node first, against the scores that the task has found so far; see :mod:`ball_tree`. What the
tasks found, at most ``top`` rows a query, is merged in two rounds. All queries come to a task
at once as long as their terms are small, in several passes beyond that.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.ball_tree import BallTree, Best, Queries
from parlance.llm.store import pick, public_id, stored, with_id

TOP = 50
#: Bytes of query terms in one pass over the documents.
PASS_BYTES = 16 << 20
#: Documents, and terms of them that a query has, in one tree.
TREE_ROWS = 8192
TREE_TERMS = 1 << 20
#: Bytes of text whose terms are listed at once.
PART_BYTES = 1 << 20
LANES = 64

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

COUNTED = "id long, n long, terms binary, counts binary"
FOUND = "query int, lane int, id long, score long"


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a whole text in order, a megabyte or so at a time."""
    raw = (text or "").encode().translate(_LOWER)
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + PART_BYTES)
        end = gap.start() if gap else len(raw)
        yield _TERM.findall(raw, at, end)
        at = end


def weight(documents: int, holding: int) -> int:
    """Integer weight of a term that ``holding`` of ``documents`` documents have."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impact(count: np.ndarray, size: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Saturated term count of documents of ``size`` terms, in integers."""
    sizes, back = np.unique(size, return_inverse=True)
    norm = np.array([50 + 50 * n * documents // total for n in sizes.tolist()], np.int64)[back]
    return 1_000_000_000 * count // (1000 * count + 20 * norm)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted({t for part in terms_of(x) for t in part}) for x in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("item"), pa.array(terms, pa.list_(pa.binary()))], names=["item", "terms"])


def _count(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                size, found = 0, Counter()
                for part in terms_of(text):
                    size += len(part)
                    found.update(map(vocabulary.get, part))
                found.pop(None, None)
                sizes.append(size)
                terms.append(np.fromiter(found.keys(), np.int32, len(found)).tobytes())
                counts.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
            yield pa.record_batch(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                names=["id", "n", "terms", "counts"],
            )

    return run


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task hold each term."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        found = np.bincount(_joined(batch.column("terms")))
        if len(found) > len(total):
            found, total = total, found
        total[: len(found)] += found
    held = np.flatnonzero(total)
    for at in range(0, len(held), 1 << 16):
        some = held[at : at + (1 << 16)]
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])


def _joined(column) -> np.ndarray:
    """All 32-bit numbers of a binary column, one row after another."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32)


def _search(held, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, documents, total = held.value
        queries = Queries(terms, len(weights))
        best = [Best(top) for _ in terms]
        mask = np.zeros(len(weights), np.int64)
        waiting, rows, size = [], 0, 0

        def searched() -> None:
            ids, n, term, count, each = (np.concatenate(x) for x in zip(*waiting))
            value = weights[term] * impact(count.astype(np.int64), np.repeat(n, each), documents, total)
            tree = BallTree(np.concatenate(([0], np.cumsum(each))), term, value, queries, len(weights))
            for i, mine in enumerate(terms):
                mask[mine] = 1
                best[i].names = ids
                tree.search(i, mask, best[i])
                mask[mine] = 0

        for batch in batches:
            each = np.array([len(t) // 4 for t in batch.column("terms").to_pylist()], np.int64)
            term, count = _joined(batch.column("terms")), _joined(batch.column("counts"))
            ids, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("id", "n"))
            at = np.concatenate(([0], np.cumsum(each)))
            lo = 0
            while lo < len(each):  # as many rows as fit into the tree, one at least
                hi = min(len(each), lo + TREE_ROWS - rows, int(np.searchsorted(at, at[lo] + TREE_TERMS - size, "right")) - 1)
                hi = max(hi, lo + (not rows))
                waiting.append((ids[lo:hi], n[lo:hi], term[at[lo] : at[hi]], count[at[lo] : at[hi]], each[lo:hi]))
                rows, size = rows + hi - lo, size + int(at[hi] - at[lo])
                if hi < len(each) or rows >= TREE_ROWS or size >= TREE_TERMS:
                    searched()
                    waiting, rows, size = [], 0, 0
                lo = hi
        if rows:
            searched()
        lane = TaskContext.get().partitionId() % LANES
        for i, one in enumerate(best):
            if len(one.ids):
                k = len(one.ids)
                columns = [np.full(k, i, np.int32), np.full(k, lane, np.int32), one.ids, one.scores]
                yield pa.record_batch([pa.array(c) for c in columns], names=["query", "lane", "id", "score"])

    return run


def _ranked(found: DataFrame, group: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", top: int = TOP,
) -> DataFrame:
    """``item_col``, ``rank``, ``id_col`` and ``score`` of each item's ``top`` documents.

    Equal scores go by ascending id, rows without an id last; every document row counts for
    itself, equal rows too. Null and empty texts have no terms: as documents they are left out
    of all counts, as items they find nothing. Rows of ``items`` that are equal in id and text
    are one item; other rows that share an id are ranked each for itself, under that id. No
    documents or no items give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = with_id(docs, id_col, text=text_col).select("id", "text")
    asked = pick(items, item=item_col, text=item_text_col).distinct()
    asked = stored(asked.select(F.col("item").cast("long").alias("item"), "text").mapInArrow(_query_terms, "item long, terms array<binary>"), "search-items")
    size = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t)))).first()[0] or 0
    passes = 1 + size // PASS_BYTES
    result = None
    for p in range(passes):
        some = [r for r in asked.where(F.pmod(F.xxhash64("item", "terms"), F.lit(passes)) == p).collect() if r.terms]
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in some for t in r.terms}))}
        words = spark.sparkContext.broadcast(vocabulary)
        counted = stored(texts.mapInArrow(_count(words), COUNTED).where("n > 0"), "search-terms")
        documents, total = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        rows = counted.where("octet_length(terms) > 0")
        holding = {r.term: r.n for r in rows.select("terms").mapInArrow(_holding, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        weights = np.array([weight(documents, holding.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        terms = [np.array([vocabulary[bytes(t)] for t in r.terms], np.int64) for r in some]
        held = spark.sparkContext.broadcast((terms, weights, documents, total or 1))
        found = _ranked(rows.mapInArrow(_search(held, top), FOUND), ["query", "lane"], top).drop("rank", "lane")
        names = spark.createDataFrame([(i, r.item) for i, r in enumerate(some)], f"query int, {item_col} long")
        named = _ranked(found, ["query"], top).join(F.broadcast(names), "query")
        here = named.select(item_col, "rank", public_id(id_col), "score")
        result = here if result is None else result.unionByName(here)
    return result
