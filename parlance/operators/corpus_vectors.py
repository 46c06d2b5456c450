"""Word and sentence vectors learnt from the corpus itself, by Spark jobs alone.

Words that stand close together are counted; the positive pointwise mutual information of
those counts is a sparse symmetric matrix, kept as a table of its cells. Its leading basis
comes from orthogonal iteration: a round is one join of the cells with the current vectors and
one sum per word, after which the columns are made orthonormal through their small matrix of
inner products. A sentence is the mean of its known words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import tokens
from parlance.session import cut_lineage, stored

# Words of a vocabulary that every worker holds; those of a larger one meet by joins.
MAX_HELD_WORDS = 2_000_000
# Words of text whose pairs are added up before they go on.
_PAIRED_WORDS = 1 << 20


def neighbour_pairs(words: Column, window: int) -> Column:
    """``(a, b)`` of all words at most ``window`` places apart, in order."""
    size = F.size(words)
    apart = [
        F.arrays_zip(
            F.slice(words, F.lit(1), F.greatest(size - o, F.lit(0))).alias("a"),
            F.slice(words, F.lit(o + 1), F.greatest(size - o, F.lit(0))).alias("b"),
        )
        for o in range(1, window + 1)
    ]
    return F.flatten(F.array(*apart))


def cooccurrences(words: DataFrame, window: int, min_count: int) -> DataFrame:
    """``(w, c, n)``: how often two words that occur ``min_count`` times are neighbours.

    ``words`` has the column ``words``. Both orders count, so the table is symmetric. Pairs
    are summed before they are shuffled and only then looked up in the vocabulary.
    """
    counts = words.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    vocabulary = cut_lineage(counts.where(F.col("n") >= min_count).select("w"))
    pairs = words.select(F.explode(neighbour_pairs(F.col("words"), window)).alias("p"))
    pairs = pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
    known = pairs.join(vocabulary.select(F.col("w").alias("a")), "a", "left_semi")
    known = known.join(vocabulary.select(F.col("w").alias("b")), "b", "left_semi")
    there, back = known.select(F.col("a").alias("w"), F.col("b").alias("c"), "n"), known.select(F.col("b").alias("w"), F.col("a").alias("c"), "n")
    return there.unionByName(back).groupBy("w", "c").agg(F.sum("n").alias("n"))


def _pair_counts(held, size: int, window: int):
    """Task function: neighbours among the held words, as ``low * size + high`` with a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {w: i for i, w in enumerate(held.value)}
        gap = [-1] * window  # no pair reaches over the end of a sentence

        def counted(ids: list[int]) -> pa.RecordBatch:
            row = np.array(ids, np.int64)
            codes = []
            for apart in range(1, window + 1):
                a, b = row[:-apart], row[apart:]
                known = (a >= 0) & (b >= 0)
                codes.append(np.minimum(a, b)[known] * size + np.maximum(a, b)[known])
            pairs, n = np.unique(np.concatenate(codes), return_counts=True)
            return pa.record_batch([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

        ids: list[int] = []
        for batch in batches:
            for text in batch.column(0):
                ids.extend(places.get(w, -1) for w in (text.as_py() or "").split(" "))
                ids.extend(gap)
                if len(ids) >= _PAIRED_WORDS:
                    yield counted(ids)
                    ids = []
        if ids:
            yield counted(ids)

    return run


def held_cooccurrences(words: DataFrame, vocabulary: Sequence[str], window: int) -> DataFrame:
    """:func:`cooccurrences` for a vocabulary that workers can hold; ``w`` and ``c`` are places in it.

    Pairs with a word outside it are never made. Stored once, from the sums of unordered pairs.
    """
    size = len(vocabulary)
    held = words.sparkSession.sparkContext.broadcast(list(vocabulary))
    texts = words.select(F.array_join("words", " ").alias("text"))
    pairs = texts.mapInArrow(_pair_counts(held, size, window), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    low, high = F.expr(f"pair div {size}").cast("int"), F.expr(f"pair % {size}").cast("int")
    # A word beside itself counts in both orders too.
    both = F.when(low == high, F.array(F.struct(low.alias("w"), high.alias("c"), (F.col("n") * 2).alias("n")))).otherwise(
        F.array(F.struct(low.alias("w"), high.alias("c"), "n"), F.struct(high.alias("w"), low.alias("c"), "n"))
    )
    return pairs.select(F.inline(both))


def positive_information(cells: DataFrame, held: bool = False) -> DataFrame:
    """``(w, c, value)``: positive pointwise mutual information, cells without it left out.

    ``held`` says that a row per word can go to every executor, so that no cell moves.
    """
    cells = stored(cells, "cells")
    totals = stored(cells.groupBy("w").agg(F.sum("n").alias("total")), "totals")
    whole = totals.agg(F.sum("total")).scalar()
    totals = F.broadcast(totals) if held else totals
    joined = cells.join(totals, "w").join(totals.select(F.col("w").alias("c"), F.col("total").alias("other")), "c")
    value = F.log(F.col("n") * whole.cast("double") / (F.col("total").cast("double") * F.col("other")))
    return joined.select("w", "c", value.alias("value")).where("value > 0")


def _start(seed: int, column: int) -> Column:
    """A number in [-1, 1) from a word; any engine with md5 can repeat it."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:{column}:"), F.col("w")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 31) - 1.0


def _orthonormal(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns turned orthonormal through the Cholesky factor of their inner products.

    The matrix has a cell per pair of columns, whatever the number of words.
    """
    size = len(names)
    sums = [F.sum(F.col(names[i]) * F.col(names[j])) for i in range(size) for j in range(i + 1)]
    row = table.agg(*sums).first()
    gram = np.zeros((size, size))
    for k, (i, j) in enumerate((i, j) for i in range(size) for j in range(i + 1)):
        gram[i, j] = gram[j, i] = row[k] or 0.0
    if not gram.any():
        return table
    turn = np.linalg.inv(np.linalg.cholesky(gram + np.eye(size) * 1e-12 * np.trace(gram))).T
    columns = []
    for j in range(size):
        terms = [F.col(names[i]) * float(turn[i, j]) for i in range(j + 1)]
        columns.append(sum(terms[1:], terms[0]).alias(names[j]))
    return table.select("w", *columns)


def leading_basis(
    matrix: DataFrame, dimensions: int, rounds: int = 3, seed: int = 42, spelt: DataFrame | None = None
) -> DataFrame:
    """``(w, v0 … )``: orthonormal columns that span the leading space of a symmetric table.

    Each round is written out, so a lost executor costs at most one. ``spelt`` is ``(place, w)``
    for a matrix over places in a vocabulary that can be held; its cells stay where they are.
    """
    names = [f"v{i}" for i in range(dimensions)]
    matrix = stored(matrix, "matrix")
    words = matrix.select("w").distinct()
    begun = [_start(seed, i).alias(n) for i, n in enumerate(names)]
    if spelt is None:
        basis = words.select("w", *begun)
    else:
        basis = spelt.join(words.withColumnRenamed("w", "place"), "place", "left_semi").select(F.col("place").alias("w"), *begun)
    for _ in range(rounds):
        over = basis.withColumnRenamed("w", "c")
        over = over if spelt is None else F.broadcast(over)
        sums = [F.sum(F.col("value") * F.col(n)).alias(n) for n in names]
        basis = _orthonormal(cut_lineage(matrix.join(over, "c").groupBy("w").agg(*sums)), names)
    return cut_lineage(basis)


@dataclass(frozen=True)
class CorpusVectorEncoder:
    """Vectors learnt on the sentences to be encoded, or on others."""

    dimensions: int = 16
    window: int = 2
    min_count: int = 5
    rounds: int = 3
    seed: int = 42
    max_held: int = MAX_HELD_WORDS

    def fit(self, sentences: DataFrame) -> DataFrame:
        """Vectors ``(w, v0 …)`` of the words of a corpus."""
        words = sentences.select(tokens(F.lower("sentence")).alias("words"))
        counts = words.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        frequent = stored(counts.where(F.col("n") >= self.min_count).select("w"), "vocabulary")
        if frequent.count() > self.max_held:
            matrix = positive_information(cooccurrences(words, self.window, self.min_count))
            return leading_basis(matrix, self.dimensions, self.rounds, self.seed)
        vocabulary = sorted(frequent.toArrow().column("w").to_pylist())
        spelt = frequent.sparkSession.createDataFrame(pa.table({"place": pa.array(range(len(vocabulary)), pa.int32()), "w": pa.array(vocabulary, pa.string())}))
        matrix = positive_information(held_cooccurrences(words, vocabulary, self.window), held=True)
        basis = leading_basis(matrix, self.dimensions, self.rounds, self.seed, spelt)
        return spelt.join(F.broadcast(basis.withColumnRenamed("w", "place")), "place").drop("place")

    def apply(self, sentences: DataFrame, vectors: DataFrame) -> DataFrame:
        """Add ``embedding``, the mean of the words that have a vector, zeros without one.

        The rows are stored with a number; a sentence is summed where it is, if the vectors
        can be held, and only its sums move.
        """
        rows = stored(sentences.withColumn("_row", F.monotonically_increasing_id()), "sentences")
        return self._applied(rows, vectors).select(*[c for c in sentences.columns if c != "embedding"], "embedding")

    def _applied(self, rows: DataFrame, vectors: DataFrame) -> DataFrame:
        names = [f"v{i}" for i in range(self.dimensions)]
        if vectors.limit(self.max_held + 1).count() <= self.max_held:
            vectors = F.broadcast(vectors)
        words = rows.select("_row", F.explode(tokens(F.lower("sentence"))).alias("w"))
        means = words.join(vectors, "w").groupBy("_row").agg(*[F.avg(n).alias(n) for n in names])
        row = F.array(*[F.coalesce(F.col(n), F.lit(0.0)).cast("float") for n in names])
        return rows.join(means, "_row", "left").withColumn("embedding", row)

    def encode(self, sentences: DataFrame) -> DataFrame:
        rows = stored(sentences.withColumn("_row", F.monotonically_increasing_id()), "sentences")
        return self._applied(rows, self.fit(rows)).select(*[c for c in sentences.columns if c != "embedding"], "embedding")
