"""Abbreviations learnt from a corpus, for sentence segmentation.

After Kiss and Strunk (2006): an abbreviation is a word that nearly always has a period, so the
likelihood ratio of that hypothesis against a period by chance is high. It is scaled up for
periods inside the word and down for length and for every occurrence without the period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import WORD
from parlance.session import cut_lineage

# Fixed values of the published method: least score, and the share of periods it supposes.
LEAST_SCORE = 0.3
PERIOD_SHARE = 0.99
# A candidate: letters, with periods between them.
_CANDIDATE = r"^\p{L}+(\.\p{L}+)*$"


def period_counts(documents: DataFrame) -> DataFrame:
    """``(word, with_period, without)`` of the lower-cased words of all texts."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    bare = documents.select(F.explode(words).alias("t")).select(F.regexp_replace("t", r"^[\"'«»()\[\],;:]+|[\"'«»()\[\],;:!?]+$", "").alias("t"))
    ends = F.col("t").endswith(".")
    rows = bare.select(F.when(ends, F.expr("left(t, length(t) - 1)")).otherwise(F.col("t")).alias("word"), ends.alias("ends"))
    return rows.where("word <> ''").groupBy("word").agg(F.count_if("ends").alias("with_period"), F.count_if(~F.col("ends")).alias("without"))


def learn_abbreviations(documents: DataFrame, least: float = LEAST_SCORE, least_count: int = 2) -> DataFrame:
    """``(word, with_period, without, score)`` of the words that count as abbreviations.

    Two aggregations: the counts of every word, and their totals. A word needs ``least_count``
    occurrences with a period.
    """
    counts = cut_lineage(period_counts(documents))
    totals = counts.agg(F.sum("with_period").cast("double").alias("p"), F.sum(F.col("with_period") + F.col("without")).cast("double").alias("n"))
    chance = totals.select(F.col("p") / F.col("n")).scalar()
    k, rest = F.col("with_period").cast("double"), F.col("without").cast("double")
    by_chance = k * F.log(chance) + rest * F.log(1.0 - chance)
    by_rule = k * F.log(F.lit(PERIOD_SHARE)) + rest * F.log(F.lit(1 - PERIOD_SHARE))
    ratio = -2.0 * (by_chance - by_rule)
    inner = F.regexp_count("word", F.lit(r"\.")).cast("double")
    letters = F.length("word").cast("double") - inner
    penalty = F.pow(letters, -rest)
    score = ratio * F.exp(-letters) * (inner + 1.0) * penalty
    able = F.col("word").rlike(_CANDIDATE) & (F.col("with_period") >= least_count)
    return counts.where(able).withColumn("score", score).where(F.col("score") >= least).select("word", "with_period", "without", "score")


def abbreviation_list(learnt: DataFrame, limit: int = 1_000) -> list[str]:
    """The words for :func:`split_sentences`, also with a capital; the best ``limit`` by score.

    They become one pattern of the plan, so their number is bounded.
    """
    rows = learnt.orderBy(F.desc("score"), "word").limit(limit).collect()
    return sorted({w for r in rows for w in (r.word, r.word[:1].upper() + r.word[1:])})
