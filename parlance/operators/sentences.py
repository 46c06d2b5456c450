"""Documents to sentences, noise statistics and the whole-document cap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import fixed_values as fv
from parlance.functions.text import admin_share, clean_text, is_administrative, lines, split_sentences
from parlance.operators.prefix import range_prefix
from parlance.schema import KEY, validate_schema
from parlance.session import cut_lineage
from parlance.sources.corpus import named_files

STRATUM = ("date", "classe")


def administrative_lines(documents: DataFrame) -> DataFrame:
    """Every non-blank line with its position and the administrative flag."""
    return documents.select(
        "doc_id", F.posexplode(lines(F.col("text"))).alias("line_no", "line")
    ).select(
        "doc_id",
        F.col("line_no").cast("long").alias("line_no"),
        "line",
        is_administrative(F.col("line")).alias("is_admin"),
    )


def clean_documents(documents: DataFrame) -> DataFrame:
    """Replace ``text`` by the cleaned text and add ``filter_ratio``."""
    others = [c for c in documents.columns if c != "text"]
    # The lines get a column of their own, or both counts would split the text again.
    return documents.withColumn("_lines", lines(F.col("text"))).select(
        *others,
        clean_text(F.col("text")).alias("text"),
        admin_share(F.col("_lines")).alias("filter_ratio"),
    )


def sentence_table(
    documents: DataFrame,
    abbreviations: Sequence[str] = fv.ABBREVIATIONS,
    min_words: int = fv.MIN_SENTENCE_WORDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per kept sentence: key ``{doc_id}_{sent_idx}``, index from 0.

    ``keep`` names further document columns to carry along.
    """
    cleaned = clean_documents(documents)
    pieces = split_sentences(F.col("text"), abbreviations, min_words)
    return cleaned.select(
        "doc_id", "date", "classe", "filter_ratio", *keep,
        F.posexplode(pieces).alias("sent_idx", "sentence"),
    ).select(
        "doc_id",
        F.concat_ws("_", "doc_id", "sent_idx").alias(KEY),
        "date",
        "classe",
        F.col("sent_idx").cast("long").alias("sent_idx"),
        "sentence",
        "filter_ratio",
        *keep,
    )


def document_sizes(sentences: DataFrame, *extra: str) -> DataFrame:
    """Sentence count per document; combines map-side before its one shuffle."""
    return sentences.groupBy("doc_id", *STRATUM, *extra).agg(F.count("*").alias("n_sentences"))


def cap_sentences(
    sentences: DataFrame, max_sentences: int, order: Sequence[str] = STRATUM
) -> DataFrame:
    """Keep whole documents, in order, until the first that would pass the cap.

    The running total never falls, so "stop at the first overflow" keeps exactly the
    documents whose running total, themselves included, is at most the cap. 0 = no cap.
    Equal order values go by ``doc_id``.
    """
    if max_sentences <= 0:
        return sentences
    validate_schema(sentences, order, "sentences")
    keys = list(dict.fromkeys([*order, "doc_id"]))
    sizes = cut_lineage(sentences.groupBy(*keys).agg(F.count("*").alias("n_sentences")))
    kept = range_prefix(sizes, [], keys, "n_sentences").where(
        F.col("before") + F.col("n_sentences") <= max_sentences
    )
    return sentences.join(kept.select(*keys), keys, "left_semi")


def _mean_ratio(ratio: str) -> Column:
    """Mean of four-decimal ratios, summed as whole numbers: the same in any row order."""
    return F.sum(F.round(F.col(ratio) * 10_000).cast("long")) / F.lit(10_000.0) / F.count(ratio)


def stratum_noise(documents: DataFrame) -> DataFrame:
    """Documents and filter ratio statistics per stratum; empty documents count too."""
    ratio = clean_documents(documents).select(*STRATUM, F.col("filter_ratio").alias("r"))
    return ratio.groupBy(*STRATUM).agg(
        F.count("*").alias("n_files"),
        _mean_ratio("r").alias("mean_ratio"),
        F.min("r").alias("min_ratio"),
        F.max("r").alias("max_ratio"),
    )


def noise_rollup(files: DataFrame) -> DataFrame:
    """Noise of every stratum, date and the whole corpus, in one aggregation.

    ``files`` is ``(path, content)``. Unreadable files count among the files of their stratum
    but have no ratio. ``level`` is 0 for a stratum, 1 for a date and 3 for the corpus; the
    columns that a level sums over are null.
    """
    named = named_files(files).withColumn("_lines", lines(F.coalesce("text", F.lit(""))))
    rated = named.select(*STRATUM, F.when(F.col("readable"), admin_share(F.col("_lines"))).alias("r"))
    return rated.rollup(*STRATUM).agg(
        F.grouping_id().cast("long").alias("level"),
        F.count("*").alias("n_files"),
        F.count_if(F.col("r").isNull()).alias("n_unreadable"),
        _mean_ratio("r").alias("mean_ratio"),
        F.min("r").alias("min_ratio"),
        F.max("r").alias("max_ratio"),
    )


def corpus_noise(sentences: DataFrame, noisy: float = 0.5) -> DataFrame:
    """Sentences, documents, mean ratio over documents, documents above ``noisy``."""
    per_document = sentences.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max("filter_ratio").alias("r")
    )
    return per_document.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_sentences"),
        F.count("*").alias("n_documents"),
        _mean_ratio("r").alias("mean_ratio"),
        F.count_if(F.col("r") > noisy).alias("n_noisy"),
    )


def key_collisions(documents: DataFrame) -> DataFrame:
    """Document ids that occur more than once; their sentence keys would collide."""
    return (
        documents.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    )
