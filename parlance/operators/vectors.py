"""Sentence vectors: encoders, masked pooling, the embedding table, model input."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import tokens
from parlance.schema import KEY, LINGUISTIC_FEATURES, META

# Fixed value: width of a sentence vector.
DIMENSIONS = 768


@dataclass(frozen=True)
class HashingEncoder:
    """Mean of hashed one-hot token vectors; needs no training and no Python worker."""

    dimensions: int = DIMENSIONS

    def encode(self, sentences: DataFrame) -> DataFrame:
        words = sentences.withColumn("_tokens", tokens(F.lower("sentence")))
        hashed = HashingTF(
            inputCol="_tokens", outputCol="_tf", numFeatures=self.dimensions
        ).transform(words)
        # Counts sum to the number of tokens, so the norm of order one is what a mean divides by;
        # the vector stays sparse until the end.
        mean = Normalizer(inputCol="_tf", outputCol="_mean", p=1.0).transform(hashed)
        dense = vector_to_array("_mean", dtype="float32")
        return mean.withColumn("embedding", dense).drop("_tokens", "_tf", "_mean")


def embedding_table(encoded: DataFrame) -> DataFrame:
    """Key, document columns and the vector as single-precision floats."""
    vector = F.transform("embedding", lambda x: x.cast("float"))
    return encoded.select(KEY, *META, vector.alias("embedding"))


def mean_pooling(token_vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; zeros when none is."""
    zipped = F.arrays_zip(token_vectors.alias("v"), mask.alias("m"))
    width = F.coalesce(F.size(F.get(token_vectors, F.lit(0))), F.lit(0))
    zero = F.array_repeat(F.lit(0.0), width)
    weights = F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m.cast("double"))
    return F.aggregate(
        zipped,
        zero,
        lambda acc, t: F.zip_with(acc, t["v"], lambda a, x: a + x.cast("double") * t["m"]),
        lambda acc: F.transform(acc, lambda a: a / F.greatest(weights, F.lit(1e-9))),
    )


def assemble_vector(
    df: DataFrame, features: Sequence[str] = LINGUISTIC_FEATURES, output: str = "features"
) -> DataFrame:
    """One ML vector of the linguistic features and the embedding; no nulls allowed."""
    vectored = df.withColumn("_embedding", array_to_vector("embedding"))
    return (
        VectorAssembler(
            inputCols=[*features, "_embedding"], outputCol=output, handleInvalid="error"
        )
        .transform(vectored)
        .drop("_embedding")
    )
