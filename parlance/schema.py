"""Column contracts of the stage tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEY = "PRIMARY_KEY"
META = ("doc_id", "date", "classe")

# Label names.
POS_LABEL = "langue_de_bois"
NEG_LABEL = "non_langue_de_bois"
OTHER_LABEL = "autre"
VALID_LABELS = (POS_LABEL, NEG_LABEL, OTHER_LABEL)

# The seventeen linguistic model features.
NUMERIC_FEATURES = ("n_digits", "n_dates", "n_money", "n_percent", "numeric_ratio")
VAGUE_FEATURES = ("n_vague_words", "vague_ratio")
MODAL_FEATURES = ("n_modal_verbs", "modal_ratio")
ENTITY_FEATURES = ("n_ent_org", "n_ent_loc", "n_ent_law", "n_ent_total")
SENTIMENT_FEATURES = ("sentiment_positive", "sentiment_negative", "sentiment_intensity")
LINGUISTIC_FEATURES = (
    NUMERIC_FEATURES
    + VAGUE_FEATURES
    + MODAL_FEATURES
    + ENTITY_FEATURES
    + SENTIMENT_FEATURES
    + ("filter_ratio",)
)

SENTENCES = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField(KEY, T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("classe", T.StringType()),
        T.StructField("sent_idx", T.LongType()),
        T.StructField("sentence", T.StringType()),
        T.StructField("filter_ratio", T.DoubleType()),
    ]
)


def validate_schema(df: DataFrame, required: Iterable[str], name: str = "") -> None:
    """Raise ``ValueError`` naming the missing and the present columns."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        prefix = f"[{name}] " if name else ""
        raise ValueError(
            f"{prefix}missing columns: {missing}; present columns: {sorted(df.columns)}"
        )
