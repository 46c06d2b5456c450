"""Feature selection by Wald test, the two classifiers, and corpus scoring."""

from __future__ import annotations

import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import spread_trees, trees
from parlance.operators.stats import (
    IV_THRESHOLD,
    WALD_ALPHA,
    calibrate_threshold,
    class_weights,
    information_value,
    moments,
    select_by_iv,
    standardize,
    stratified_folds,
)
from parlance.operators.trees import BoostedTrees
from parlance.schema import KEY, LINGUISTIC_FEATURES, NEG_LABEL, POS_LABEL
from parlance.session import stored

# Searched settings.
SEARCH_SPACE = {
    "n_estimators": (100, 200, 300, 500),
    "max_depth": (3, 4, 5, 6, 7),
    "learning_rate": (0.01, 0.05, 0.1, 0.2, 0.3),
    "subsample": (0.7, 0.8, 0.9, 1.0),
    "colsample_bytree": (0.5, 0.7, 0.8, 1.0),
    "gamma": (0.0, 0.1, 0.5, 1.0),
    "reg_alpha": (0.0, 0.1, 1.0),
    "reg_lambda": (1.0, 2.0, 5.0),
}
N_DRAWS, N_FOLDS = 30, 3


def _assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(
        inputCols=list(columns), outputCol="features", handleInvalid="error"
    ).transform(df)


def linearly_independent(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Leave out constant columns and columns that are a combination of earlier ones.

    One pass gathers the correlation matrix (features², so bounded); the elimination on
    it runs on the driver.
    """
    names = list(features)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(
        *[F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i, j in pairs]
    ).first()
    cov = {}
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c_{i}_{j}"] or 0.0
    kept: list[int] = []
    residual = {i: dict() for i in range(len(names))}
    for i in range(len(names)):
        # Variance of column i that the kept columns do not explain (Cholesky step).
        left = cov[i, i]
        for k in kept:
            earlier = sum(residual[i][m] * residual[k][m] for m in kept if m < k)
            residual[i][k] = (cov[i, k] - earlier) / residual[k][k]
            left -= residual[i][k] ** 2
        if cov[i, i] > 1e-12 and left > 1e-9 * cov[i, i]:
            residual[i][i] = left**0.5
            kept.append(i)
    return [names[i] for i in kept]


def wald_p_values(
    train: DataFrame, features: Sequence[str], max_iter: int = 200
) -> DataFrame:
    """p-value of each coefficient of an unregularised logit on standardised columns.

    Constant and collinear columns get a null p-value: no test exists for them.
    """
    spark = train.sparkSession
    values: dict[str, float | None] = {f: None for f in features}
    # Every step of the fit reads the rows again.
    rows = train.select("y", *features).persist()
    try:
        usable = linearly_independent(rows, features)
        if usable:
            columns = [f + "_z" for f in usable]
            scaled = standardize(rows, usable).select("y", *columns)
            model = GeneralizedLinearRegression(
                family="binomial", link="logit", labelCol="y", maxIter=max_iter, regParam=0.0
            ).fit(_assembled(scaled, columns))
            # The intercept comes last.
            values.update(zip(usable, model.summary.pValues))
    finally:
        rows.unpersist()
    return spark.createDataFrame(list(values.items()), "feature string, p_value double")


def wald_select(
    train: DataFrame, features: Sequence[str], alpha: float = WALD_ALPHA
) -> DataFrame:
    """Features with p ≤ alpha; all of them if none is."""
    tested = wald_p_values(train, features)
    best = F.min("p_value").over(Window.partitionBy())  # one row per feature
    passed = F.coalesce(F.col("p_value") <= alpha, F.lit(False))
    return tested.withColumn("selected", passed | F.coalesce(best > alpha, F.lit(True)))


@dataclass(frozen=True)
class LogisticScorer:
    """Standardisation and coefficients as one column expression."""

    features: tuple[str, ...]
    means: Mapping[str, float]
    scales: Mapping[str, float]
    coefficients: Mapping[str, float]
    intercept: float

    def proba(self) -> Column:
        z = F.lit(self.intercept)
        for f in self.features:
            z = z + (F.col(f) - self.means[f]) / F.lit(self.scales[f]) * self.coefficients[f]
        return 1.0 / (1.0 + F.exp(-z))


def train_lr(
    train: DataFrame, features: Sequence[str], max_iter: int = 500
) -> tuple[LogisticScorer, Model]:
    """L2 logistic regression on standardised columns with balanced class weights."""
    rows = train.select("y", *features).persist()
    try:
        fitted = moments(rows, features)
        balance = class_weights(rows).first()
        n = balance.n_neg + balance.n_pos
        weight = F.when(F.col("y") == 1, balance.weight_pos).otherwise(balance.weight_neg)
        scaled = standardize(rows, features, fitted).withColumn("weight", weight)
        columns = [f + "_z" for f in features]
        model = LogisticRegression(
            labelCol="y", weightCol="weight", elasticNetParam=0.0, regParam=1.0 / n,
            standardization=False, maxIter=max_iter, tol=1e-6,
        ).fit(_assembled(scaled.select("y", "weight", *columns), columns))
    finally:
        rows.unpersist()
    scorer = LogisticScorer(
        tuple(features),
        {f: fitted[f][0] for f in features},
        {f: fitted[f][1] for f in features},
        dict(zip(features, (float(c) for c in model.coefficients))),
        float(model.intercept),
    )
    return scorer, model


def sample_settings(
    space: Mapping[str, Sequence], n: int, seed: int = 42
) -> Iterator[dict[str, object]]:
    """Distinct draws from the product of the space, by index, without listing it."""
    size = 1
    for values in space.values():
        size *= len(values)
    for index in random.Random(seed).sample(range(size), min(n, size)):
        setting = {}
        for name, values in space.items():
            index, position = divmod(index, len(values))
            setting[name] = values[position]
        yield setting


@dataclass(frozen=True)
class TreeSearch:
    model: BoostedTrees
    settings: Mapping[str, object]
    cv_auc: float
    trials: list[tuple[dict[str, object], float]] = field(default_factory=list)


def feature_vector(features: Sequence[str], embedding: Column) -> Column:
    """The linguistic features and then the vector as one array of doubles; null without a vector."""
    names = F.array(*[F.col(f).cast("double") for f in features])
    return F.concat(names, F.transform(embedding, lambda x: x.cast("double")))


def train_gbt(
    train: DataFrame,
    features: Sequence[str] = LINGUISTIC_FEATURES,
    space: Mapping[str, Sequence] = SEARCH_SPACE,
    n_draws: int = N_DRAWS,
    n_folds: int = N_FOLDS,
    seed: int = 42,
    key: str = KEY,
) -> TreeSearch:
    """Random search over boosted trees by cross-validated exact ROC AUC; the best is refitted.

    The draws come by index from the product of the space. Folds are dealt per class in
    seeded order, by the keys alone. All labelled rows count: up to ``trees.MAX_TRAINING_ROWS`` of
    them every fit is a task that holds them, and of more every fit is spread over them.
    """
    spark = train.sparkSession
    keys = stored(train.select(key, "y"), "keys")
    balance = class_weights(keys).first()
    weight = F.when(F.col("y") == 1, balance.positive_scale).otherwise(1.0)
    vector = feature_vector(features, F.col("embedding"))
    rows = train.select(key, "y", vector.alias("vector"), weight.alias("weight"))
    draws = list(sample_settings(space, n_draws, seed))
    if keys.count() > trees.MAX_TRAINING_ROWS:
        data = spread_trees.spread_rows(rows, key, n_folds, seed)
        aucs = spread_trees.cross_validate(spark, data, draws, seed)
        fit = lambda best: spread_trees.refit(spark, data, best, seed)
    else:
        sample = trees.gathered(rows, key, stratified_folds(keys, n_folds, seed, key))
        aucs = trees.cross_validate(spark, sample, draws, n_folds, seed)
        fit = lambda best: trees.refit(spark, sample, best, seed)
    trials = list(zip(draws, aucs))
    best, auc = max(trials, key=lambda t: t[1])
    return TreeSearch(fit(best), best, auc, trials)


def predicted_label(proba: Column, threshold: float | Column) -> Column:
    return F.when(proba >= threshold, POS_LABEL).otherwise(NEG_LABEL)


def predict_all(
    corpus: DataFrame,
    lr: LogisticScorer,
    lr_threshold: float,
    trees: BoostedTrees,
    trees_threshold: float,
    features: Sequence[str] = LINGUISTIC_FEATURES,
) -> DataFrame:
    """Score every sentence with both models.

    Without a vector the trees cannot score a sentence: it stays, with nulls. One scan.
    """
    vector = feature_vector(features, F.col("embedding"))
    both = corpus.withColumns({"proba_lr": lr.proba(), "proba_xgb": trees.proba(corpus.sparkSession, vector)})
    by_trees = predicted_label(F.col("proba_xgb"), trees_threshold)
    return both.withColumns(
        {
            "pred_lr": predicted_label(F.col("proba_lr"), lr_threshold),
            "pred_xgb": F.when(F.col("proba_xgb").isNotNull(), by_trees),
        }
    )


@dataclass(frozen=True)
class LogisticReport:
    scorer: LogisticScorer
    threshold: float
    table: DataFrame
    model: Model


def logistic_path(
    train: DataFrame,
    val: DataFrame,
    features: Sequence[str] = LINGUISTIC_FEATURES,
    iv_threshold: float = IV_THRESHOLD,
    alpha: float = WALD_ALPHA,
) -> LogisticReport:
    """Selection and fit on train only, threshold on validation only."""
    scores = information_value(train, features)
    after_iv = [r.feature for r in select_by_iv(scores, iv_threshold).collect()]
    tested = wald_select(train, after_iv, alpha)
    table = feature_report(scores, tested)
    chosen = [r.feature for r in table.where("selected").orderBy(F.desc("iv"), "feature").collect()]
    scorer, model = train_lr(train, chosen)
    threshold = calibrate_threshold(val.withColumn("proba", scorer.proba())).first().threshold
    return LogisticReport(scorer, threshold, table, model)


def feature_report(scores: DataFrame, tested: DataFrame) -> DataFrame:
    """IV, p-value and whether a feature was kept, for those that passed the IV step."""
    return (
        scores.join(tested, "feature")
        .select("feature", "iv", "p_value", "selected")
        .orderBy(F.desc("iv"), "feature")
    )
