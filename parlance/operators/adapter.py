"""Any model behind one interface: vectors, label scores and score maps of a text column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: sentences per model call.
BATCH_SIZE = 256

Predictor = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class TextModel:
    """A model that maps an array of strings to a matrix, one row each.

    ``make_predictor`` runs once per Python worker, so weights are loaded there and never
    shipped with a task. A null text is given to the model as an empty one.
    """

    make_predictor: Callable[[], Predictor]
    batch_size: int = BATCH_SIZE

    def _matrix(self, text: Column, kind: T.DataType) -> Column:
        predict = predict_batch_udf(self.make_predictor, return_type=T.ArrayType(kind), batch_size=self.batch_size)
        return predict(F.coalesce(text, F.lit("")))

    def vector(self, text: Column) -> Column:
        """The row as a vector of single-precision floats."""
        return self._matrix(text, T.FloatType())

    def scores(self, text: Column) -> Column:
        """The row as an array of doubles, one score per label of the model."""
        return self._matrix(text, T.DoubleType())

    def score_map(self, text: Column, labels: Sequence[str]) -> Column:
        """The row as a map of label to score, for label and sentiment features."""
        names = F.array(*[F.lit(name) for name in labels])
        return F.map_from_arrays(names, F.slice(self.scores(text), 1, len(labels)))


@dataclass(frozen=True)
class StructModel:
    """A model that returns several columns at once, each an array with one value per text."""

    make_predictor: Callable[[], Callable[[np.ndarray], dict[str, np.ndarray]]]
    fields: Sequence[str]
    batch_size: int = BATCH_SIZE

    def predict(self, text: Column) -> Column:
        kind = T.StructType([T.StructField(name, T.DoubleType()) for name in self.fields])
        run = predict_batch_udf(self.make_predictor, return_type=kind, batch_size=self.batch_size)
        return run(F.coalesce(text, F.lit("")))


@dataclass(frozen=True)
class BatchModelEncoder:
    """Sentence vectors of a text model."""

    model: TextModel

    def encode(self, sentences: DataFrame) -> DataFrame:
        return sentences.withColumn("embedding", self.model.vector(F.col("sentence")))
