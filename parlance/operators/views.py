"""Document views over the predicted sentence table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.features import escape_markup, markup_span
from parlance.schema import KEY, NEG_LABEL, POS_LABEL


def filter_corpus(df: DataFrame, date: str | None = None, classe: str | None = None) -> DataFrame:
    """Optional equality filters; on a table partitioned by them they prune folders."""
    if date is not None:
        df = df.where(F.col("date") == date)
    if classe is not None:
        df = df.where(F.col("classe") == classe)
    return df


def options(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def doc_list(df: DataFrame) -> DataFrame:
    return options(df, "doc_id")


def display_label(pred: Column, proba: Column, threshold: float = 0.5) -> Column:
    """Predictions below the display threshold are shown as negative."""
    return F.when(proba < threshold, NEG_LABEL).otherwise(pred)


def display_labels(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("pred", display_label(F.col("pred"), F.col("proba"), threshold))


def doc_scores(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Displayed positives and their share of the sentences of each document."""
    return (
        display_labels(df, threshold)
        .groupBy("doc_id")
        .agg(
            F.count_if(F.col("pred") == POS_LABEL).alias("n_positive"),
            F.count("*").alias("n_sentences"),
        )
        .withColumn("share", F.col("n_positive") / F.col("n_sentences").cast("double"))
    )


def doc_sentences(df: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Sentences in reading order, of one document or of all."""
    chosen = df if doc_id is None else df.where(F.col("doc_id") == doc_id)
    return chosen.orderBy("doc_id", "sent_idx")


def top_sentences(df: DataFrame, k: int) -> DataFrame:
    """The ``k`` likeliest sentences of each document.

    A rank filter like this one is cut to ``k`` rows per document and task before the
    shuffle, so a long document does not pile up in one task.
    """
    order = Window.partitionBy("doc_id").orderBy(F.desc("proba"), "sent_idx")
    return (
        df.withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= k)
        .select("doc_id", "rank", KEY, "sentence", "proba", "pred")
    )


def corpus_totals(df: DataFrame) -> DataFrame:
    """Sentences, predicted positives, share and documents."""
    per_document = df.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("pred") == POS_LABEL).alias("pos")
    )
    return per_document.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_sentences"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_positive"),
        F.try_divide(F.sum("pos").cast("double"), F.sum("n")).alias("share"),
        F.count("*").alias("n_documents"),
    )


def render_documents(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One marked-up text per document; the rendered spans are what gets shuffled."""
    shown = display_label(F.col("pred"), F.col("proba"), threshold)
    part = F.when(
        shown == POS_LABEL, markup_span(F.col("sentence"), F.col("proba"))
    ).otherwise(escape_markup(F.col("sentence")))
    return (
        df.groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("sent_idx", part.alias("part")))).alias("_parts"))
        .select(
            "doc_id",
            F.concat(
                F.lit("<article>"),
                F.array_join(F.transform("_parts", lambda p: p["part"]), " "),
                F.lit("</article>"),
            ).alias("markup"),
        )
    )


def doc_header(df: DataFrame) -> DataFrame:
    """Date and class of the first sentence, and the number of sentences."""
    return df.groupBy("doc_id").agg(
        F.min_by("date", "sent_idx").alias("date"),
        F.min_by("classe", "sent_idx").alias("classe"),
        F.count("*").alias("n_sentences"),
    )
