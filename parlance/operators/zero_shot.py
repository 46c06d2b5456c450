"""Labels of sentences without any training rows, from descriptions of the labels.

Sentences and descriptions are vectors of word counts times inverse document frequencies that
the corpus itself gives; a label's score is the cosine of the two. Only words of a description
meet a label. Frequent words, a bounded number, are summed where the sentence is, rare ones
through a sparse join and a sum per sentence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import tokens
from parlance.session import stored

# Words that every worker holds with their frequencies; the others are joined.
MAX_HELD_WORDS = 100_000


def inverse_frequencies(sentences: DataFrame) -> DataFrame:
    """``(w, idf)`` of every word: ``ln((1 + n) / (1 + df)) + 1`` over the rows."""
    words = sentences.select(F.array_distinct(tokens(F.lower("sentence"))).alias("words"))
    n = words.agg(F.count("*")).scalar()
    df = words.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    return df.select("w", (F.log((n + 1).cast("double") / (F.col("df") + 1)) + 1.0).alias("idf"))


def label_weights(like: DataFrame, labels: Mapping[str, str], idf: DataFrame) -> DataFrame:
    """``(w, weights)``: the unit vectors of the descriptions, one weight per label and word.

    A word that the corpus lacks has no part in them. One row per word of a description.
    """
    names = list(labels)
    rows = [(label, word) for label, text in labels.items() for word in text.lower().split()]
    words = like.sparkSession.createDataFrame(rows, "label string, w string")
    weighted = words.groupBy("label", "w").agg(F.count("*").alias("tf")).join(idf, "w")
    weighted = weighted.select("label", "w", (F.col("tf") * F.col("idf")).alias("x"))
    norms = weighted.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    unit = weighted.join(norms, "label").select("label", "w", (F.col("x") / F.col("norm")).alias("x"))
    each = [F.coalesce(F.max(F.when(F.col("label") == name, F.col("x"))), F.lit(0.0)) for name in names]
    return unit.groupBy("w").agg(F.array(*each).alias("weights"))


def _sums(held, n_labels: int):
    """Column function: what the held words of a sentence add up to, and the words not held.

    Per sentence: the squares, a product per label, and every other word with its count.
    """
    kind = "struct<squares:double,dots:array<double>,others:array<struct<w:string,tf:long>>>"

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        known = held.value
        squares, dots, words, counts, ends = [], [], [], [], [0]
        for text in texts:
            text = text.as_py()
            square, dot = 0.0, [0.0] * n_labels
            for word, tf in Counter(text.split(" ")).items() if text else ():
                found = known.get(word)
                if found is None:
                    words.append(word)
                    counts.append(tf)
                    continue
                idf, weights = found
                x = tf * idf
                square += x * x
                if weights is not None:
                    dot = [d + x * weight for d, weight in zip(dot, weights)]
            squares.append(square)
            dots.append(dot)
            ends.append(len(words))
        pairs = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["w", "tf"])
        others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        columns = [pa.array(squares, pa.float64()), pa.array(dots, pa.list_(pa.float64())), others]
        return pa.StructArray.from_arrays(columns, names=["squares", "dots", "others"])

    return run


def zero_shot_scores(
    sentences: DataFrame, labels: Mapping[str, str], output: str = "scores", max_held: int = MAX_HELD_WORDS
) -> DataFrame:
    """Add the cosine with every label's description, in the order of ``labels``.

    A sentence that shares no word with a description, or has none, scores zero. The rows are
    stored with a number. The ``max_held`` most frequent words and those of the descriptions
    are held by the workers and counted where the sentence is; only the other words, rare
    ones, are shuffled to their frequencies, and come back as one sum per sentence.
    """
    rows = stored(sentences.withColumn("_row", F.monotonically_increasing_id()), "sentences")
    idf = stored(inverse_frequencies(rows), "idf")
    described = {r.w: r.weights for r in label_weights(sentences, labels, idf).collect()}
    frequent = idf.orderBy("idf", "w").limit(max_held).collect()
    meant = idf.where(F.col("w").isin(sorted(described))).collect() if described else []
    held = sentences.sparkSession.sparkContext.broadcast({r.w: (r.idf, described.get(r.w)) for r in (*frequent, *meant)})
    words = F.array_join(tokens(F.lower("sentence")), " ")
    summed = rows.withColumn("_sums", _sums(held, len(labels))(words))
    rest = summed.select("_row", F.explode("_sums.others").alias("o")).select("_row", "o.w", "o.tf")
    x = F.col("tf") * F.col("idf")
    rest = rest.join(idf, "w").groupBy("_row").agg(F.sum(x * x).alias("_rest"))
    norm = F.sqrt(F.col("_squares") + F.coalesce("_rest", F.lit(0.0)))
    scores = F.transform("_dots", lambda d: F.when(F.col("_norm") > 0, d / F.col("_norm")).otherwise(0.0))
    kept = summed.withColumns({"_squares": F.col("_sums.squares"), "_dots": F.col("_sums.dots")}).drop("_sums")
    joined = kept.join(rest, "_row", "left").withColumn("_norm", norm)
    return joined.withColumn(output, scores).select(*[c for c in sentences.columns if c != output], output)
