"""The given tables in the shapes of the pipeline, and the settings of the queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from parlance.functions.fixed_values import MODAL_VERBS
from parlance.operators import features as ft
from parlance.operators.models import LogisticScorer, predicted_label
from parlance.operators.prefix import spread
from parlance.operators.sentences import sentence_table
from parlance.operators.trees import NODES, BoostedTrees, from_rows
from parlance.schema import KEY, LINGUISTIC_FEATURES, NEG_LABEL, POS_LABEL
from parlance.session import scratch_path
from parlance.sources.tables import materialize

# Words that occur in the given texts stand in for the lexicons.
VAGUE = ("the", "of", "de", "que", "la", "und", "les", "el", "of,", "in the")
MODAL = (*MODAL_VERBS, "is", "was", "be", "est", "ist", "es", "on")
POSITIVE = ("that", "with", "les", "die", "los")
NEGATIVE = ("and", "der", "en", "from", "des")
GAZETTEER = (
    ("the", "ORG"), ("of the", "LOC"), ("in the the", "LAW"), ("de", "ORG"),
    ("de la", "GPE"), ("le", "PER"), ("der", "LOC"), ("und", "MISC"), ("la", "LAW"),
)
LEMMAS = (
    ("des", "de"), ("du", "de"), ("les", "le"), ("la", "le"), ("is", "be"), ("was", "be"),
    ("are", "be"), ("der", "die"), ("das", "die"), ("los", "el"),
)
ENDINGS = ("er", "ing", "en", "s", "ed", "re", "on", "es", ".", ",")
ENTRIES = ("be", "le", "de le", "ther", "tion", "und die", "of the", "que", "absent", "el")
FALSE_POSITIVES = ("ther", "el")
FALSE_NEGATIVES = ("with", "une", "von")
THRESHOLD = 0.6
WEIGHTS = {
    "n_digits": 0.5, "numeric_ratio": -8.0, "n_vague_words": -0.05, "vague_ratio": 4.0,
    "n_modal_verbs": 0.1, "modal_ratio": -6.0, "filter_ratio": 2.0,
}
INTERCEPT = 0.3
# Words that describe the labels of zero-shot scoring, and letters that a stand-in model counts.
DESCRIPTIONS = {
    "langue_de_bois": "the of and that with the", "non_langue_de_bois": "de la les que le und", "autre": "der die absent los el",
}
LETTERS = "aeinorst"
SENTIMENT_LABELS = ("Positive", "NEGATIVE", "neutral")
# Trees of a fixed second model: (column, threshold, at most, above); a number is a leaf.
TREES = (
    ("vague_ratio", 0.18, ("n_digits", 0.5, -0.4, 0.3), ("embedding[0]", 0.0, 0.25, 0.7)),
    ("embedding[5]", 0.1, ("modal_ratio", 0.02, -0.2, 0.1), 0.35),
    ("filter_ratio", 0.25, 0.15, -0.6),
)
VECTOR_SIZE = 64
# Added before sums of short decimals are rounded, so that none of them lies on a tie.
OFF_TIES = 2.71e-6
STAT_FEATURES = (
    "n_digits", "numeric_ratio", "n_vague_words", "vague_ratio", "n_modal_verbs",
    "modal_ratio", "filter_ratio",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("lang").alias("date"),
        F.col("source").alias("classe"),
        "text",
    )


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_table(documents(spark, folder))


def stored_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences as a stage table: for steps that read them more than once."""
    return materialize(spark, lambda: sentences(spark, folder), scratch_path(spark, "sentences"))


def rule_features(df: DataFrame) -> DataFrame:
    return ft.rule_features(df, VAGUE, MODAL)


def full_features(df: DataFrame) -> DataFrame:
    return ft.feature_table(df, VAGUE, GAZETTEER, POSITIVE, NEGATIVE, MODAL)


def document_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label of each labelled document: quality 1 is the positive class."""
    return table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.when(F.col("quality") == 1, POS_LABEL).otherwise(NEG_LABEL).alias("label"),
        F.col("toxic"),
    )


def fixed_scorer() -> LogisticScorer:
    names = tuple(WEIGHTS)
    return LogisticScorer(
        names, dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0), WEIGHTS, INTERCEPT
    )


def fixed_trees() -> BoostedTrees:
    """``TREES`` over the linguistic features and a vector of ``VECTOR_SIZE`` numbers."""
    places = {name: i for i, name in enumerate(LINGUISTIC_FEATURES)}
    places |= {f"embedding[{i}]": len(LINGUISTIC_FEATURES) + i for i in range(VECTOR_SIZE)}
    rows: list[list] = []

    def add(tree: int, node) -> int:
        mine = len(rows)
        rows.append([tree, mine, -1, 0.0, mine, mine, 0.0])
        if isinstance(node, tuple):
            name, threshold, low, high = node
            rows[mine][2:6] = [places[name], threshold, add(tree, low), add(tree, high)]
        else:
            rows[mine][6] = node
        return mine

    for number, root in enumerate(TREES):
        add(number, root)
    names = [c.split()[0] for c in NODES.split(", ")]
    return from_rows([Row(**dict(zip(names, r))) for r in rows], len(places))


def letter_shares():
    """Predictor of a stand-in model: shares of some letters in a text."""

    def predict(texts):
        return np.array([[t.count(c) / max(len(t), 1) for c in LETTERS] for t in texts])

    return predict


def letter_totals():
    """The same with named columns: vowels and all letters counted."""

    def predict(texts):
        vowels = np.array([sum(t.count(c) for c in "aeio") for t in texts], float)
        return {"vowels": vowels, "letters": vowels + np.array([sum(t.count(c) for c in "nrst") for t in texts])}

    return predict


def scored(df: DataFrame) -> DataFrame:
    """Probability of fixed coefficients, to six decimals, and the predicted label."""
    return df.withColumn("proba", F.round(fixed_scorer().proba(), 6)).withColumn(
        "pred", predicted_label(F.col("proba"), THRESHOLD)
    )


def scored_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return scored(rule_features(sentences(spark, folder)))


def labelled_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of labelled documents; every sentence has the label of its document."""
    labels = document_labels(spark, folder).select("doc_id", "label")
    labelled_documents = documents(spark, folder).join(labels, "doc_id")
    return rule_features(sentence_table(labelled_documents, keep=("label",)))


def labelled_scores(spark: SparkSession, folder: str) -> DataFrame:
    """``(key, y, proba, pred)`` of the labelled sentences, ``pred`` as 0 or 1."""
    return scored(labelled_sentences(spark, folder)).select(
        KEY,
        "doc_id",
        (F.col("label") == POS_LABEL).cast("int").alias("y"),
        "proba",
        (F.col("proba") >= THRESHOLD).cast("int").alias("pred"),
    )


def document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias(KEY), "embedding"
    )
