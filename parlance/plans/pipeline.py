"""The stages of the analysis as jobs over Parquet tables."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import labels as lb
from parlance.operators.diagnostics import metrics_table
from parlance.operators.features import Lexicon, feature_table
from parlance.operators.models import (
    SEARCH_SPACE,
    LogisticReport,
    LogisticScorer,
    TreeSearch,
    feature_vector,
    logistic_path,
    predict_all,
    train_gbt,
)
from parlance.operators.prefix import spread
from parlance.operators.sentences import STRATUM, cap_sentences, key_collisions, sentence_table
from parlance.operators.stats import calibrate_threshold, labelled_target, split_column
from parlance.operators.trees import BoostedTrees, from_rows
from parlance.operators.vectors import HashingEncoder, embedding_table
from parlance.schema import KEY, LINGUISTIC_FEATURES, validate_schema
from parlance.sources.corpus import read_text_corpus
from parlance.sources.tables import (
    load_settings,
    materialize,
    read_labels,
    save_metrics,
    save_model,
    save_settings,
    slices_of,
    write_stage,
)
from parlance.session import stored, tidied


@dataclass(frozen=True)
class Paths:
    """Where the stages live: one shared folder."""

    root: str

    def __getattr__(self, stage: str) -> str:
        if stage.startswith("_"):
            raise AttributeError(stage)
        return f"{self.root}/{stage}"


def sentences_stage(
    spark: SparkSession, corpus: str, out: Paths, max_sentences: int = 0, force: bool = False
) -> DataFrame:
    """Sentences of the corpus; a cap goes by class, date and full file name.

    Warns of files of one name in several strata: their sentence keys are the same.
    """

    def build() -> DataFrame:
        documents = spread(read_text_corpus(spark, corpus), "doc_id")
        repeated = key_collisions(documents).count()
        if repeated:
            warnings.warn(f"{repeated} document ids occur more than once", stacklevel=2)
        sentences = sentence_table(documents, keep=("file_name",))
        return cap_sentences(sentences, max_sentences, (*STRATUM, "file_name")).drop("file_name")

    return materialize(spark, build, out.sentences, force)


def features_stage(
    spark: SparkSession,
    sentences: DataFrame,
    out: Paths,
    vague: Lexicon,
    gazetteer: DataFrame | Iterable[tuple[str, str]],
    positive: Iterable[str],
    negative: Iterable[str],
    force: bool = False,
) -> DataFrame:
    return materialize(
        spark,
        lambda: feature_table(sentences, vague, gazetteer, positive, negative),
        out.features,
        force,
    )


def embeddings_stage(
    spark: SparkSession, sentences: DataFrame, out: Paths, encoder=HashingEncoder(), force: bool = False
) -> DataFrame:
    return materialize(
        spark, lambda: embedding_table(encoder.encode(sentences)), out.embeddings, force
    )


def merge_stage(
    spark: SparkSession, features: DataFrame, embeddings: DataFrame, out: Paths, force: bool = False
) -> DataFrame:
    slices = slices_of(spark, out.features)
    return materialize(spark, lambda: lb.merge_features(features, embeddings), out.final, force, slices=slices)


def label_stage(
    spark: SparkSession, final: DataFrame, labels_csv: str, out: Paths
) -> tuple[DataFrame, DataFrame]:
    """The labelled table and its two-class view; unknown labels stop the job."""
    validate_schema(final, [KEY], "final")
    cleaned = lb.clean_labels(read_labels(spark, labels_csv), "line")
    with tidied(spark):
        lb.check_labels(cleaned)
    write_stage(lb.apply_labels(final, cleaned), out.final_labeled, slices=slices_of(spark, out.final))
    labelled = spark.read.parquet(out.final_labeled)
    write_stage(lb.two_class_view(labelled), out.final_labeled_2class)
    return labelled, spark.read.parquet(out.final_labeled_2class)


@dataclass(frozen=True)
class Training:
    logistic: LogisticReport
    trees: TreeSearch
    trees_threshold: float
    metrics: DataFrame
    splits: DataFrame
    features: tuple[str, ...]


def train_job(
    labelled: DataFrame,
    features: Sequence[str] = LINGUISTIC_FEATURES,
    space: Mapping[str, Sequence] = SEARCH_SPACE,
    n_draws: int = 30,
    seed: int = 42,
    key: str = KEY,
) -> Training:
    """Split, fit both models on train, set thresholds on val, report on every split.

    The labelled rows are written out once, column by column, and stay where they are: the
    split is an expression over them, and every step reads the columns it needs. Both models
    score each row once.
    """
    validate_schema(labelled, [*features, "label", "embedding"], "final_labeled")
    rows = stored(
        labelled_target(labelled)
        .select(key, *features, "embedding", "y")
        .withColumn("_row", F.monotonically_increasing_id()),
        "labelled",
    )
    splits = rows.withColumn("split", split_column(rows, "_row", seed=seed, key=key)).drop("_row")
    train = splits.where(F.col("split") == "train")
    val = splits.where(F.col("split") == "val")
    logistic = logistic_path(train, val, features)
    trees = train_gbt(train, features, space, n_draws, seed=seed, key=key)
    proba = trees.model.proba(splits.sparkSession, feature_vector(features, F.col("embedding")))
    scored = stored(
        splits.select("split", "y", logistic.scorer.proba().alias("by_lr"), proba.alias("by_trees")),
        "scored",
    )
    by_lr, by_trees = (scored.select("split", "y", F.col(c).alias("proba")) for c in ("by_lr", "by_trees"))
    threshold = calibrate_threshold(by_trees.where(F.col("split") == "val")).first().threshold
    metrics = (
        metrics_table(by_lr, logistic.threshold)
        .withColumn("model", F.lit("logistic"))
        .union(metrics_table(by_trees, threshold).withColumn("model", F.lit("trees")))
    )
    return Training(logistic, trees, threshold, metrics, splits, tuple(features))


@dataclass(frozen=True)
class Models:
    """What it takes to score sentences: both models with their thresholds."""

    scorer: LogisticScorer
    threshold: float
    trees: BoostedTrees
    trees_threshold: float
    features: tuple[str, ...]
    settings: Mapping[str, object]
    cv_auc: float

    def predict(self, corpus: DataFrame) -> DataFrame:
        return predict_all(
            corpus, self.scorer, self.threshold, self.trees, self.trees_threshold, self.features
        )


def save_models(fitted: Training, out: Paths) -> None:
    """Both models, the moments behind the scores, thresholds and search results."""
    spark = fitted.splits.sparkSession
    save_model(fitted.logistic.model, out.models + "/logistic")
    write_stage(fitted.trees.model.table(spark), out.models + "/trees")
    record = {
        "scorer": asdict(fitted.logistic.scorer),
        "threshold": fitted.logistic.threshold,
        "trees_threshold": fitted.trees_threshold,
        "n_features": fitted.trees.model.n_features,
        "features": list(fitted.features),
        "settings": dict(fitted.trees.settings),
        "cv_auc": fitted.trees.cv_auc,
        "trials": [[dict(s), auc] for s, auc in fitted.trees.trials],
    }
    save_settings(spark, record, out.models + "/settings")


def load_models(spark: SparkSession, out: Paths) -> Models:
    record = load_settings(spark, out.models + "/settings")
    scorer = record["scorer"] | {"features": tuple(record["scorer"]["features"])}
    return Models(
        LogisticScorer(**scorer), record["threshold"],
        from_rows(spark.read.parquet(out.models + "/trees").collect(), record["n_features"]), record["trees_threshold"],
        tuple(record["features"]), record["settings"], record["cv_auc"],
    )


def rescore(splits: DataFrame, models: Models) -> DataFrame:
    """Metrics of both saved models on rows with ``split`` and ``y``."""
    scored = models.predict(splits)
    return (
        metrics_table(scored.withColumn("proba", F.col("proba_lr")), models.threshold)
        .withColumn("model", F.lit("logistic"))
        .union(
            metrics_table(
                scored.where(F.col("proba_xgb").isNotNull()).withColumn("proba", F.col("proba_xgb")),
                models.trees_threshold,
            ).withColumn("model", F.lit("trees"))
        )
    )


def train_stage(
    labelled: DataFrame, corpus: DataFrame, out: Paths, **settings
) -> DataFrame:
    """Train, score the whole corpus, and save predictions, models and metrics."""
    fitted = train_job(labelled, **settings)
    predicted = predict_all(
        corpus,
        fitted.logistic.scorer,
        fitted.logistic.threshold,
        fitted.trees.model,
        fitted.trees_threshold,
        fitted.features,
    )
    write_stage(predicted, out.final_predicted)
    save_models(fitted, out)
    save_metrics(fitted.metrics, out.models + "/evaluation")
    save_metrics(fitted.logistic.table, out.models + "/features")
    return labelled.sparkSession.read.parquet(out.final_predicted)
