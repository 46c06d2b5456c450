"""Residuals, calibration and the tables behind the model report."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.prefix import value_counts, with_bins
from parlance.operators.stats import classification_report, roc_auc
from parlance.session import cut_lineage

_FLOOR = 1e-8


def _clipped(proba: Column) -> Column:
    return F.greatest(F.least(proba, F.lit(1 - _FLOOR)), F.lit(_FLOOR))


def pearson_residual(y: Column, proba: Column) -> Column:
    p = _clipped(proba)
    return (y - p) / F.sqrt(p * (1 - p))


def deviance_residual(y: Column, proba: Column) -> Column:
    p = _clipped(proba)
    deviance = (y * F.ln(p) + (1 - y) * F.ln(1 - p)) * -2.0
    return F.signum(y - p) * F.sqrt(F.greatest(deviance, F.lit(0.0)))


def residuals(df: DataFrame) -> DataFrame:
    """Add both residuals to rows of ``(y, proba)``."""
    return df.withColumns(
        {
            "pearson": pearson_residual(F.col("y"), F.col("proba")),
            "deviance": deviance_residual(F.col("y"), F.col("proba")),
        }
    )


def residual_summary(df: DataFrame) -> DataFrame:
    """Mean and population deviation of both residuals."""
    return residuals(df).agg(
        F.avg("pearson").alias("pearson_mean"),
        F.stddev_pop("pearson").alias("pearson_std"),
        F.avg("deviance").alias("deviance_mean"),
        F.stddev_pop("deviance").alias("deviance_std"),
    )


def hosmer_lemeshow_table(df: DataFrame, n_groups: int = 10) -> DataFrame:
    """Observed and expected positives and negatives per quantile group of ``proba``."""
    counts = cut_lineage(
        value_counts(
            df.withColumn("_name", F.lit("proba")), "_name", "proba",
            F.sum(F.col("y").cast("long")).alias("events"),
        )
    )
    grouped = with_bins(counts, n_groups).where(F.col("bin").isNotNull())
    table = grouped.groupBy(F.col("bin").alias("decile")).agg(
        F.sum("events").alias("obs_pos"),
        F.sum("n").alias("total"),
        F.sum(F.col("value") * F.col("n")).alias("_p"),
    )
    mean = F.col("_p") / F.col("total")
    return table.select(
        "decile",
        "obs_pos",
        (F.col("total") - F.col("obs_pos")).alias("obs_neg"),
        "total",
        mean.alias("mean_p"),
        (F.col("total") * mean).alias("exp_pos"),
        (F.col("total") * (1 - mean)).alias("exp_neg"),
    )


def chi2_upper_tail(x: float, dof: int) -> float:
    """P(X > x) for a chi-square variable with a whole number of degrees of freedom."""
    h = x / 2.0
    if dof % 2 == 0:
        return math.exp(-h) * math.fsum(h**i / math.factorial(i) for i in range(dof // 2))
    half = [math.exp(-h) * h ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (dof + 1) // 2)]
    return math.erfc(math.sqrt(h)) + math.fsum(half)


def hosmer_lemeshow(df: DataFrame, n_groups: int = 10, alpha: float = 0.05) -> DataFrame:
    """The statistic, its p-value (null under three groups) and the verdict: one row.

    Only that row reaches the driver, where the upper tail has a closed form.
    """
    table = hosmer_lemeshow_table(df, n_groups)

    def distance(observed: str, expected: str) -> Column:
        gap = F.col(observed) - F.col(expected)
        return gap * gap / F.greatest(F.col(expected), F.lit(_FLOOR))

    test = table.agg(
        F.sum(distance("obs_pos", "exp_pos") + distance("obs_neg", "exp_neg")).alias("chi2"),
        F.count("*").alias("n_groups"),
    ).first()
    p_value = verdict = None
    if test.n_groups >= 3:
        p_value = chi2_upper_tail(test.chi2, test.n_groups - 2)
        verdict = "poor calibration" if p_value < alpha else "acceptable calibration"
    return df.sparkSession.createDataFrame(
        [(test.chi2, test.n_groups, p_value, verdict)],
        "chi2 double, n_groups long, p_value double, verdict string",
    )


def equal_width_bin(value: Column, low: Column, high: Column, n_bins: int) -> Column:
    """0-based right-closed bin between ``low`` and ``high``; ``low`` is in bin 0.

    The division only guesses the bin; comparing with the edges decides, so a value on an
    edge always falls to the bin below.
    """
    width = (high - low) / n_bins
    guess = F.ceil((value - low) / F.nullif(width, F.lit(0.0))).cast("int") - 1
    guess = F.greatest(F.least(F.coalesce(guess, F.lit(0)), F.lit(n_bins - 1)), F.lit(0))
    lower, upper = low + width * guess, low + width * (guess + 1)
    return (
        F.when((value <= lower) & (guess > 0), guess - 1)
        .when((value > upper) & (guess < n_bins - 1), guess + 1)
        .otherwise(guess)
        .cast("long")
    )


def with_equal_width_bins(df: DataFrame, column: str, n_bins: int) -> DataFrame:
    """Add ``bin`` over the observed range of a column, taken as a scalar subquery."""
    span = df.agg(
        F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("span")
    ).scalar()
    return df.withColumn("_span", span).withColumn(
        "bin", equal_width_bin(F.col(column), F.col("_span.low"), F.col("_span.high"), n_bins)
    )


def calibration_curve(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Mean prediction, share of positives and rows per equal-width bin that has rows."""
    rows = cut_lineage(df.select("proba", "y"))  # the range and the bins read these
    return with_equal_width_bins(rows, "proba", n_bins).groupBy("bin").agg(
        F.avg("proba").alias("mean_pred"), F.avg("y").alias("frac_pos"),
        F.count("*").alias("n"),
    )


def histogram(df: DataFrame, column: str, n_bins: int, *by: str) -> DataFrame:
    """Rows per equal-width bin, with the lower edge of the bin."""
    rows = cut_lineage(df.select(column, *by))  # the range and the bins read these
    binned = with_equal_width_bins(rows, column, n_bins)
    low, high = F.col("_span.low"), F.col("_span.high")
    left = low + (high - low) / n_bins * F.col("bin")
    return binned.groupBy(*by, "bin").agg(F.min(left).alias("left_edge"), F.count("*").alias("n"))


def residual_histogram(df: DataFrame, n_bins: int = 50) -> DataFrame:
    """Rows per equal-width bin of the Pearson residual."""
    return histogram(residuals(df), "pearson", n_bins)


def proba_by_class(df: DataFrame, n_bins: int = 40) -> DataFrame:
    """Rows per probability bin and true class; both classes share the bins."""
    return histogram(df, "proba", n_bins, "y")


def metrics_table(df: DataFrame, threshold: Column | float) -> DataFrame:
    """One row per split: AUC, threshold, and the scores of the positive class."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    df = cut_lineage(df.select("split", "y", "proba"))  # scores and AUC read these
    judged = df.withColumn("pred", (F.col("proba") >= limit).cast("int"))
    report = classification_report(judged, "split")
    positive = report.where(F.col("entry") == "1").select("split", "f1", "precision", "recall")
    accuracy = report.where(F.col("entry") == "accuracy").select(
        "split", F.col("f1").alias("accuracy")
    )
    # One row per split on every side.
    joined = roc_auc(df, "split").join(positive, "split").join(accuracy, "split")
    return joined.select(
        "split",
        F.round("auc_roc", 4).alias("auc_roc"),
        F.round(limit, 3).alias("threshold"),
        *[F.round(c, 4).alias(c) for c in ("f1", "precision", "recall", "accuracy")],
    )
