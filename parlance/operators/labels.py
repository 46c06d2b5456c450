"""Joins of features, embeddings and labels; the annotation sheet."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import fixed_values as fv
from parlance.functions.text import WORD
from parlance.operators.prefix import seeded_prefix
from parlance.operators.sentences import document_sizes
from parlance.schema import KEY, NEG_LABEL, POS_LABEL, VALID_LABELS, validate_schema
from parlance.session import cut_lineage

_STRATUM = ("date", "classe")
# Fixed value: a stratum may pass its target by this factor.
TOLERANCE = 1.15


def merge_features(features: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Left join on the sentence key; only the vector comes from the right."""
    validate_schema(features, [KEY], "features")
    validate_schema(embeddings, [KEY, "embedding"], "embeddings")
    return features.join(embeddings.select(KEY, "embedding"), KEY, "left")


def key_gaps(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct keys on one side only; one aggregation instead of two anti-joins."""
    sides = left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).union(
        right.select(F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    seen = sides.groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("only_left"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("only_right"),
    )


def clean_labels(sheet: DataFrame, order: str) -> DataFrame:
    """Non-blank labels, the first per key by ``order``; the label is not trimmed.

    The first row is an aggregate, so repeats of a key combine before the shuffle.
    """
    validate_schema(sheet, [KEY, "label"], "labels")
    missing = F.col("label").isin(*fv.MISSING_TOKENS)
    return (
        sheet.where(F.col("label").isNotNull() & ~missing & F.col("label").rlike(WORD))
        .groupBy(KEY)
        .agg(F.min_by("label", order).alias("label"))
    )


def invalid_labels(labels: DataFrame, valid: Iterable[str] = VALID_LABELS) -> DataFrame:
    """Distinct label values that are not allowed."""
    return labels.where(~F.col("label").isin(*valid)).select("label").distinct()


def check_labels(labels: DataFrame, valid: Iterable[str] = VALID_LABELS) -> None:
    """Raise ``ValueError`` that lists all unknown label values of the sheet."""
    unknown = [r.label for r in invalid_labels(labels, valid).orderBy("label").collect()]
    if unknown:
        raise ValueError(f"unknown labels: {unknown}; expected: {sorted(valid)}")


def apply_labels(final: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join of cleaned labels; sentences without one keep a null label."""
    validate_schema(final, [KEY], "final")
    return final.join(labels.select(KEY, "label"), KEY, "left")


def labelled_counts(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count("label").alias("n_labelled"),
        F.count_if(F.col("label").isNull()).alias("n_unlabelled"),
    )


def two_class_view(labelled: DataFrame, keep_unlabelled: bool = True) -> DataFrame:
    """The two main labels; rows without a label stay unless told otherwise."""
    kept = F.col("label").isin(POS_LABEL, NEG_LABEL)
    return labelled.where(kept | F.col("label").isNull() if keep_unlabelled else kept)


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n")).orderBy("label")


def sample_documents(sentences: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """Whole documents per stratum, in seeded order, near a share of ``target``.

    A stratum's target is proportional to its sentences. Documents are taken until the
    first that would pass the target by more than the tolerance; the running total never
    falls, so that is a filter on it.
    """
    sizes = cut_lineage(document_sizes(sentences))
    strata = sizes.groupBy(*_STRATUM).agg(F.sum("n_sentences").alias("stratum_rows"))
    total = strata.agg(F.sum("stratum_rows")).scalar()
    goal = F.floor(F.lit(target) * F.col("stratum_rows") / total.cast("double"))
    running = seeded_prefix(sizes, _STRATUM, "doc_id", "n_sentences", seed)
    limit = running.withColumnRenamed("total", "stratum_rows").withColumn("goal", goal)
    kept = limit.where(F.col("before") + F.col("n_sentences") <= F.col("goal") * TOLERANCE)
    return sentences.join(kept.select("doc_id", *_STRATUM), ["doc_id", *_STRATUM], "left_semi")


def annotation_sheet(sample: DataFrame) -> DataFrame:
    """Five columns and an empty label."""
    return sample.select(KEY, "doc_id", "date", "classe", "sentence", F.lit("").alias("label"))


def argmax_label(scores: Column, labels: Sequence[str] = VALID_LABELS) -> Column:
    """Label of the highest score; the earliest one wins a tie."""
    names = F.array(*[F.lit(name) for name in labels])
    return F.try_element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))


def is_blank(label: Column) -> Column:
    return ~F.coalesce(label, F.lit("")).rlike(WORD)


def pending_annotations(sheet: DataFrame, resume: bool = True) -> DataFrame:
    """Rows still to annotate: blank labels on resume, else all of them, labels reset."""
    if resume:
        return sheet.where(is_blank(F.col("label")))
    return sheet.withColumn("label", F.lit(""))


def update_labels(sheet: DataFrame, new: DataFrame) -> DataFrame:
    """Write new labels into the sheet by key; other rows keep theirs."""
    fresh = new.groupBy(KEY).agg(F.max("label").alias("_new"))
    return (
        sheet.join(fresh, KEY, "left")
        .withColumn("label", F.coalesce("_new", "label"))
        .drop("_new")
    )


def annotation_stats(sheet: DataFrame) -> DataFrame:
    """Per label: rows and percent of the annotated rows; ``TOTAL`` and open rows too."""
    per_label = (
        sheet.groupBy(F.when(~is_blank(F.col("label")), F.col("label")).alias("label"))
        .agg(F.count("*").alias("n"))
    )
    # One row per label from here on.
    totals = per_label.agg(
        F.coalesce(F.sum(F.when(F.col("label").isNotNull(), F.col("n"))), F.lit(0)).alias("done"),
        F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)).alias("open"),
    )
    done = totals.select("done").scalar()
    labelled = per_label.where(F.col("label").isNotNull()).select(
        "label", "n", F.round(F.col("n") / done * 100.0, 1).alias("pct")
    )
    summary = totals.select(
        F.explode(
            F.array(
                F.struct(
                    F.lit("TOTAL").alias("label"), F.col("done").alias("n"), F.lit(100.0).alias("pct")
                ),
                F.struct(
                    F.lit("UNANNOTATED").alias("label"),
                    F.col("open").alias("n"),
                    F.lit(None).cast("double").alias("pct"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    return labelled.union(summary)
