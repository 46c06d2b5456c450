"""The feature table: rule, entity and sentiment columns beside the sentence columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import features as fx
from parlance.functions import fixed_values as fv
from parlance.functions.text import tokens
from parlance.operators.entities import entity_counts
from parlance.operators.lexicon import (
    MAX_INLINE_ENTRIES,
    lexicon_entries,
    lexicon_table,
)
from parlance.schema import MODAL_FEATURES, VAGUE_FEATURES
from parlance.session import stored

# Largest lexicon that is sent to all tokens; a larger one is met by a shuffle of them.
MAX_HELD_ENTRIES = 1_000_000

Lexicon = Iterable[str] | DataFrame


def _with(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(name) for name, c in columns.items()])


def with_tokens(df: DataFrame) -> DataFrame:
    """Add the lower-cased tokens as ``_tokens``; the steps below share them."""
    if "_tokens" in df.columns:
        return df
    sentence = F.coalesce("sentence", F.lit(""))  # a null sentence has no tokens
    return df.withColumn("_tokens", tokens(F.lower(sentence)))


def _on_tokens(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    out = _with(with_tokens(df), columns)
    return out if "_tokens" in df.columns else out.drop("_tokens")


def add_concreteness(df: DataFrame, **flags: bool) -> DataFrame:
    return _on_tokens(df, fx.concreteness(F.col("sentence"), F.size("_tokens"), **flags))


def add_lexicon_hits(
    df: DataFrame, lexicon: Lexicon, count: str, ratio: str, max_inline: int = MAX_INLINE_ENTRIES
) -> DataFrame:
    """Token hits against one lexicon; one of more than ``max_inline`` entries is joined."""
    entries = lexicon_entries(lexicon, max_inline)
    if entries is not None:
        return _on_tokens(df, fx.lexicon_features(F.col("_tokens"), entries, count, ratio))
    return _joined_lexicon_hits(df, lexicon, count, ratio)


def _joined_lexicon_hits(df: DataFrame, lexicon: Lexicon, count: str, ratio: str) -> DataFrame:
    """The same by a join: only tokens of the lexicon are counted, and rows move once.

    The rows are stored with a number, so that their text is worked out once. A lexicon of up
    to ``MAX_HELD_ENTRIES`` goes to the tokens, and their hits add up where they are.
    """
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    tokenised = with_tokens(rows)
    table = lexicon_table(df, lexicon)
    if table.limit(MAX_HELD_ENTRIES + 1).count() <= MAX_HELD_ENTRIES:
        table = F.broadcast(table)
    size = F.greatest(F.size("_tokens"), F.lit(1)).alias("_size")
    hits = (
        tokenised.select("_row", size, F.explode("_tokens").alias("entry"))
        .join(table, "entry", "left_semi")
        .groupBy("_row")
        .agg(F.count("*").alias("_n"), F.max("_size").alias("_size"))
    )
    # Without a hit both are zero, so only rows with one need their number of tokens.
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("long")
    share = F.coalesce(F.col("_n") / F.col("_size").cast("double"), F.lit(0.0))
    return rows.join(hits, "_row", "left").select(*df.columns, n.alias(count), share.alias(ratio))


def add_vague_words(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    return add_lexicon_hits(df, lexicon, *VAGUE_FEATURES)


def add_modal_verbs(df: DataFrame, lexicon: Lexicon = fv.MODAL_VERBS) -> DataFrame:
    return add_lexicon_hits(df, lexicon, *MODAL_FEATURES)


def add_sentiment(df: DataFrame, scores: Column) -> DataFrame:
    """Sentiment columns from any label → score map column."""
    return _with(df, fx.sentiment_from_scores(scores))


def add_lexicon_sentiment(
    df: DataFrame, positive: Lexicon, negative: Lexicon, max_inline: int = MAX_INLINE_ENTRIES
) -> DataFrame:
    """Sentiment columns from shares of polar tokens; lexicons beyond ``max_inline`` are joined."""
    lists = [lexicon_entries(words, max_inline) for words in (positive, negative)]
    if None not in lists:
        return _on_tokens(df, fx.sentiment_from_scores(fx.lexicon_sentiment_scores(F.col("_tokens"), *lists)))
    counted = with_tokens(df)
    for words, name in ((positive, "_pos"), (negative, "_neg")):
        counted = add_lexicon_hits(counted, words, name, f"{name}_ratio", max_inline)
    scores = fx.polar_shares(F.col("_pos"), F.col("_neg"))
    done = add_sentiment(counted, scores).drop("_pos", "_neg", "_pos_ratio", "_neg_ratio")
    return done if "_tokens" in df.columns else done.drop("_tokens")


def rule_features(
    sentences: DataFrame, vague: Lexicon, modal: Lexicon = fv.MODAL_VERBS
) -> DataFrame:
    """Concreteness, vague words and modal verbs; the tokens are split once."""
    out = add_concreteness(with_tokens(sentences))
    out = add_modal_verbs(add_vague_words(out, vague), modal)
    return out if "_tokens" in sentences.columns else out.drop("_tokens")


def feature_table(
    sentences: DataFrame,
    vague: Lexicon,
    gazetteer: DataFrame | Iterable[tuple[str, str]],
    positive: Lexicon,
    negative: Lexicon,
    modal: Lexicon = fv.MODAL_VERBS,
) -> DataFrame:
    """All sentence columns and the sixteen feature columns, computed on the same row."""
    out = rule_features(with_tokens(sentences), vague, modal)
    out = entity_counts(out, gazetteer)
    return add_lexicon_sentiment(out, positive, negative).drop("_tokens")
