"""Splits, Information Value, scaling, thresholds, reports and ROC AUC."""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.features import seeded_order
from parlance.operators.prefix import (
    HASH_DIGITS,
    range_prefix,
    seeded_prefix,
    seeded_rank,
    value_counts,
    with_bins,
)
from parlance.schema import KEY, LINGUISTIC_FEATURES, NEG_LABEL, POS_LABEL
from parlance.session import cut_lineage

# Selection and calibration settings.
IV_THRESHOLD = 0.02
WALD_ALPHA = 0.05
N_THRESHOLDS, FIRST_THRESHOLD, LAST_THRESHOLD = 200, 0.01, 0.99


def labelled_target(df: DataFrame) -> DataFrame:
    """Keep the two main labels; ``y`` is 1 for the positive one."""
    return df.where(F.col("label").isin(POS_LABEL, NEG_LABEL)).withColumn(
        "y", (F.col("label") == POS_LABEL).cast("int")
    )


def stratified_split(
    df: DataFrame,
    test_size: float = 0.15,
    val_size: float = 0.15,
    seed: int = 42,
    key: str = KEY,
    group_by: str | None = None,
) -> DataFrame:
    """Add ``split``: exact shares of each class in seeded order, test first, then val.

    Sentences are split one by one unless ``group_by`` names a column, such as
    ``doc_id``, whose values must not be torn apart; see :func:`grouped_split`.
    """
    if group_by is not None:
        return grouped_split(df, group_by, test_size, val_size, seed)
    ranked = seeded_rank(df, ["y"], key, seed)
    n_test, n_val = _shares(F.col("total"), test_size, val_size)
    split = (
        F.when(F.col("before") < n_test, "test")
        .when(F.col("before") < n_test + n_val, "val")
        .otherwise("train")
    )
    return ranked.withColumn("split", split).drop("before", "total")


def _shares(total: Column, test_size: float, val_size: float) -> tuple[Column, Column]:
    """Rows of a class that go to test and to val."""
    n_test = F.round(total * test_size)
    return n_test, F.round((total - n_test) * (val_size / (1 - test_size)))


def split_column(
    df: DataFrame, row: str, test_size: float = 0.15, val_size: float = 0.15, seed: int = 42, key: str = KEY
) -> Column:
    """The split of :func:`stratified_split` as an expression, for wide rows that must not move.

    ``row`` names a number that no two rows share; rows of equal keys go by it. Counts per class
    and bucket of the seeded order tell in which buckets the cuts lie (two per class), and only
    the keys in those are ranked.
    """
    order = seeded_order(F.col(key), seed)
    keys = df.select("y", order.alias("_order"), F.substring(order, 1, HASH_DIGITS).alias("_bucket"), key, row)
    whole = Window.partitionBy("y")  # at most a few thousand buckets per class
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = keys.groupBy("y", "_bucket").agg(F.count("*").alias("n")).select(
        "y", "_bucket", "n",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("total"),
    )
    n_test, n_val = _shares(F.col("total"), test_size, val_size)
    placed = buckets.select("*", n_test.cast("long").alias("test"), (n_test + n_val).cast("long").alias("val")).collect()
    cells = [
        (r.y, r._bucket, part, r[part] - r.before)
        for r in placed for part in ("test", "val") if r.before <= r[part] < r.before + r.n
    ]
    kinds = {f.name: f.dataType.simpleString() for f in keys.schema}
    wanted = df.sparkSession.createDataFrame(cells, f"_y {kinds['y']}, _cell string, part string, at long")
    inside = Window.partitionBy("part", "y").orderBy("_order", key, row)
    here = keys.join(F.broadcast(wanted), F.col("y").eqNullSafe(F.col("_y")) & F.col("_bucket").eqNullSafe(F.col("_cell")))
    ranked = here.withColumn("_rank", F.row_number().over(inside) - 1).where(F.col("_rank") == F.col("at"))
    cuts = {(r.y, r.part): r for r in ranked.collect()}  # the first row beyond each part
    mine = F.struct(order, F.col(key), F.col(row))
    split = F.when(F.lit(False), "train")
    for y in {r.y for r in placed}:
        for part in ("test", "val"):
            belongs, cut = F.col("y").eqNullSafe(F.lit(y)), cuts.get((y, part))
            if cut is not None:
                first = [F.lit(cut[c]).cast(kinds[c]) for c in ("_order", key, row)]
                belongs &= mine < F.struct(*first)
            split = split.when(belongs, part)
    return split.otherwise("train")


def stratified_folds(
    df: DataFrame, n_folds: int = 3, seed: int = 42, key: str = KEY, group_by: str | None = None
) -> DataFrame:
    """Add ``fold``: classes dealt evenly over the folds in seeded order.

    With ``group_by`` the rows of one value share a fold; see :func:`grouped_folds`.
    """
    if group_by is not None:
        return grouped_folds(df, group_by, n_folds, seed)
    ranked = seeded_rank(df, ["y"], key, seed)
    return ranked.withColumn("fold", (F.col("before") % n_folds).cast("int")).drop("before", "total")


def _placed_groups(df: DataFrame, group_by: str, seed: int) -> DataFrame:
    """``(group, _at, total)``: where the middle of each group lies among the rows of its kind.

    Groups of one class, of the other and of both are three kinds; each is laid end to end in
    seeded order by bucketed prefix sums, so no kind is ordered in one task. Equal groups of a
    null id are one.
    """
    sizes = df.groupBy(F.col(group_by).alias("_group")).agg(
        F.count("*").alias("_n"), F.min("y").alias("_low"), F.max("y").alias("_high")
    )
    kind = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(2).alias("_kind")
    name = F.coalesce(F.col("_group").cast("string"), F.lit("")).alias("_name")
    laid = seeded_prefix(sizes.select("_group", name, kind, "_n"), ["_kind"], "_name", "_n", seed)
    return laid.select("_group", (F.col("before") + F.col("_n") / 2.0).alias("_at"), "total")


def _back(df: DataFrame, placed: DataFrame, group_by: str, name: str, value: Column) -> DataFrame:
    chosen = placed.select("_group", value.alias(name))
    return df.join(chosen, F.col(group_by).eqNullSafe(F.col("_group")), "left").drop("_group")


def grouped_split(
    df: DataFrame, group_by: str, test_size: float = 0.15, val_size: float = 0.15, seed: int = 42
) -> DataFrame:
    """Add ``split`` so that no group is torn: the side on which the middle of a group lies.

    Of each kind of group (see :func:`_placed_groups`) the rows of a split differ from their
    exact share by at most one group.
    """
    at, total = F.col("_at"), F.col("total")
    split = F.when(at < total * test_size, "test").when(at < total * (test_size + val_size), "val")
    return _back(df, _placed_groups(df, group_by, seed), group_by, "split", split.otherwise("train"))


def grouped_folds(df: DataFrame, group_by: str, n_folds: int = 3, seed: int = 42) -> DataFrame:
    """Add ``fold`` so that no group is torn, with shares as in :func:`grouped_split`."""
    fold = F.least(F.floor(F.col("_at") * n_folds / F.col("total")), F.lit(n_folds - 1)).cast("int")
    return _back(df, _placed_groups(df, group_by, seed), group_by, "fold", fold)


def unpivot_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(…keep, feature, value)``."""
    numeric = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])
    return numeric.unpivot(list(keep), list(features), "feature", "value")


def binned_counts(
    df: DataFrame, features: Sequence[str], target: str = "y", n_bins: int = 10
) -> DataFrame:
    """Rows and events per feature and equal-frequency bin.

    One pass over the rows reduces them to distinct (feature, value) pairs, which are
    written out; edges and bins come from those.
    """
    long = unpivot_features(df, features, [target])
    counts = cut_lineage(
        value_counts(long, "feature", "value", F.sum(F.col(target).cast("long")).alias("events"))
    )
    return with_bins(counts, n_bins).groupBy("feature", "bin").agg(
        F.sum("n").alias("total"), F.sum("events").alias("events"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
    )


def quantile_bins(df: DataFrame, features: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Size and value range of every equal-frequency bin; constant columns have none."""
    return (
        binned_counts(df.withColumn("_none", F.lit(0)), features, "_none", n_bins)
        .where(F.col("bin").isNotNull())
        .select("feature", "bin", "total", "min_value", "max_value")
    )


def information_value(
    df: DataFrame, features: Sequence[str] = LINGUISTIC_FEATURES, target: str = "y", n_bins: int = 10
) -> DataFrame:
    """Information Value of all features at once, over ``(feature, bin)`` counts.

    Bins without events or without non-events are left out; a constant feature and a
    single-class target give 0.
    """
    bins = binned_counts(df, features, target, n_bins)
    whole = Window.partitionBy("feature")  # at most n_bins rows per feature
    non_events = F.col("total") - F.col("events")
    shares = bins.where(F.col("bin").isNotNull()).select(
        "feature",
        F.try_divide(F.col("events"), F.sum("events").over(whole)).alias("d1"),
        F.try_divide(non_events, F.sum(non_events).over(whole)).alias("d0"),
    )
    part = F.when(
        (F.col("d1") > 0) & (F.col("d0") > 0),
        (F.col("d1") - F.col("d0")) * F.ln(F.col("d1") / F.col("d0")),
    )
    found = shares.groupBy("feature").agg(F.sum(part).alias("iv"))
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(found, "feature", "left").select(
        "feature", F.coalesce("iv", F.lit(0.0)).alias("iv")
    )


def select_by_iv(scores: DataFrame, threshold: float = IV_THRESHOLD) -> DataFrame:
    """Features with enough Information Value, best first; all of them if none has."""
    best = F.max("iv").over(Window.partitionBy())  # one row per feature
    return (
        scores.withColumn("_best", best)
        .where((F.col("iv") >= threshold) | (F.col("_best") < threshold))
        .drop("_best")
        .orderBy(F.desc("iv"), "feature")
    )


def moments(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature: one row to the driver."""
    row = df.agg(
        *[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features)],
    ).first()
    out = {}
    for i, f in enumerate(features):
        mean, std = row[f"m_{i}"], row[f"s_{i}"]
        out[f] = (mean or 0.0, std if std and std > 1e-12 else 1.0)
    return out


def standardize(
    df: DataFrame,
    features: Sequence[str],
    fitted: dict[str, tuple[float, float]] | None = None,
    suffix: str = "_z",
) -> DataFrame:
    """Centre and scale by the moments given, or by those of ``df``; constants scale by 1."""
    fitted = fitted if fitted is not None else moments(df, features)
    return df.withColumns(
        {f + suffix: (F.col(f) - fitted[f][0]) / F.lit(fitted[f][1]) for f in features}
    )


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weight of each class and the weight of positives against negatives."""
    return df.agg(
        F.count_if(F.col("y") == 0).alias("n_neg"), F.count_if(F.col("y") == 1).alias("n_pos")
    ).select(
        "n_neg",
        "n_pos",
        F.try_divide(F.col("n_neg") + F.col("n_pos"), F.col("n_neg") * 2.0).alias("weight_neg"),
        F.try_divide(F.col("n_neg") + F.col("n_pos"), F.col("n_pos") * 2.0).alias("weight_pos"),
        (F.col("n_neg") / F.greatest("n_pos", F.lit(1)).cast("double")).alias("positive_scale"),
    )


def threshold_grid(
    n: int = N_THRESHOLDS, first: float = FIRST_THRESHOLD, last: float = LAST_THRESHOLD
) -> list[float]:
    """Evenly spaced thresholds whose last value is exact."""
    step = (last - first) / (n - 1)
    return [first + i * step for i in range(n - 1)] + [last]


def _n_reached(proba: Column, grid: Sequence[float]) -> Column:
    """How many thresholds are at most ``proba``: a position on the even grid, corrected."""
    n = len(grid)
    step = (grid[-1] - grid[0]) / (n - 1)
    guess = F.floor((proba - grid[0]) / step).cast("int") + 1
    guess = F.greatest(F.least(guess, F.lit(n)), F.lit(0))
    values = F.array(*[F.lit(t) for t in [-math.inf, *grid, math.inf]])
    at_guess = F.element_at(values, guess + 1)
    after = F.element_at(values, guess + 2)
    return F.when(at_guess > proba, guess - 1).when(after <= proba, guess + 1).otherwise(guess)


def threshold_risks(
    df: DataFrame, cost_fp: float = 1.0, cost_fn: float = 1.0, grid: Sequence[float] | None = None
) -> DataFrame:
    """Errors and risk at each threshold, from one histogram over the grid."""
    grid = list(grid or threshold_grid())
    n = len(grid)
    histogram = df.groupBy(_n_reached(F.col("proba"), grid).alias("reached")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    # At most n + 1 histogram rows, so collecting them into one array is bounded.
    cells = histogram.agg(F.collect_list(F.struct("reached", "pos", "neg")).alias("h"))

    def total(field: str, keep) -> Column:
        return F.aggregate(
            F.filter("h", keep), F.lit(0).cast("long"), lambda acc, c: acc + c[field]
        )

    indexed = cells.select(
        "h", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("i", "threshold")
    )
    i = F.col("i")
    errors = indexed.select(
        "threshold",
        total("neg", lambda c: c["reached"] > i).alias("fp"),
        total("pos", lambda c: c["reached"] <= i).alias("fn"),
        total("pos", lambda c: c["reached"] > i).alias("tp"),
    )
    return errors.withColumn("risk", F.col("fp") * F.lit(cost_fp) + F.col("fn") * F.lit(cost_fn))


def calibrate_threshold(df: DataFrame, cost_fp: float = 1.0, cost_fn: float = 1.0) -> DataFrame:
    """The smallest threshold of least risk, with its risk and F1."""
    risks = threshold_risks(df, cost_fp, cost_fn)
    best = risks.agg(
        F.min_by(
            F.struct("threshold", "risk", "tp", "fp", "fn"), F.struct("risk", "threshold")
        ).alias("b")
    ).select("b.*")
    f1 = F.try_divide(F.col("tp") * 2.0, F.col("tp") * 2 + F.col("fp") + F.col("fn"))
    return best.select("threshold", "risk", F.coalesce(f1, F.lit(0.0)).alias("f1"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, *by: str) -> DataFrame:
    """Counts of the four outcomes of ``(y, pred)``."""
    y, p = F.col("y"), F.col("pred")
    return df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )


def classification_report(df: DataFrame, *by: str) -> DataFrame:
    """Precision, recall, F1 and support per class, their averages, and accuracy."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def entry(name: str, hit: Column, wrong: Column, lost: Column) -> Column:
        return F.struct(
            F.lit(name).alias("entry"),
            _ratio(hit, hit + wrong).alias("precision"),
            _ratio(hit, hit + lost).alias("recall"),
            _ratio(hit * 2, hit * 2 + wrong + lost).alias("f1"),
            (hit + lost).alias("support"),
        )

    classes = confusion(df, *by).select(
        *by, entry("0", tn, fn, fp).alias("neg"), entry("1", tp, fp, fn).alias("pos"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        (tn + fp + fn > 0).cast("double").alias("has_neg"),
        (tp + fp + fn > 0).cast("double").alias("has_pos"),
    )
    n = F.col("neg.support") + F.col("pos.support")

    def averaged(name: str, w_neg: Column, w_pos: Column) -> Column:
        def mean(field: str) -> Column:
            return (F.col(f"neg.{field}") * w_neg + F.col(f"pos.{field}") * w_pos).alias(field)

        return F.struct(
            F.lit(name).alias("entry"), mean("precision"), mean("recall"), mean("f1"),
            n.alias("support"),
        )

    # Averages go over the classes that occur, as truth or as prediction.
    has_neg, has_pos = F.col("has_neg"), F.col("has_pos")
    present = has_neg + has_pos
    accuracy = F.struct(
        F.lit("accuracy").alias("entry"),
        *[F.col("accuracy").alias(f) for f in ("precision", "recall", "f1")],
        n.alias("support"),
    )
    rows = F.array(
        F.col("neg"),
        F.col("pos"),
        accuracy,
        averaged("macro avg", _ratio(has_neg, present), _ratio(has_pos, present)),
        averaged("weighted avg", _ratio(F.col("neg.support"), n), _ratio(F.col("pos.support"), n)),
    )
    return classes.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def roc_auc(df: DataFrame, *by: str) -> DataFrame:
    """Exact area under the ROC curve by rank sums; ties count half, one class gives NaN."""
    per_score = cut_lineage(
        df.groupBy(*by, "proba").agg(
            F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
        )
    )
    ranked = range_prefix(per_score, list(by), ["proba"], "neg")
    won = F.col("pos") * (F.col("before") + F.col("neg") / F.lit(2.0))
    sums = ranked.groupBy(*by).agg(
        F.sum(won).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    auc = F.try_divide(F.col("won"), F.col("pos").cast("double") * F.col("neg"))
    return sums.select(*by, F.coalesce(auc, F.lit(float("nan"))).alias("auc_roc"))


def prediction_distribution(df: DataFrame, pred: str = "pred") -> DataFrame:
    """Rows and share per predicted label."""
    counts = df.groupBy(F.col(pred).alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per label
    return counts.select("label", "n", (F.col("n") / total.cast("double")).alias("share"))
