"""Trees on all labelled rows, spread over them: the same as those of one task that holds them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import models, spread_trees, trees
from parlance.operators.stats import stratified_folds
from parlance.schema import KEY

SETTINGS = [
    {"n_estimators": n, "max_depth": 3, "learning_rate": 0.3, "colsample_bytree": 0.7, "reg_alpha": 0.1} for n in (2, 5)
] + [{"n_estimators": 3, "max_depth": 2, "gamma": 0.5}]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(size=900), rng.integers(-2, 3, 900), rng.integers(0, 40, 900) - 20.0, np.zeros(900), rng.exponential(size=900)], axis=1)
    x[rng.random(900) < 0.2, 0] = -0.0
    y = (x[:, 0] + 0.4 * x[:, 1] + rng.normal(size=900) > 0.5).astype(int)
    data = [(f"k{i}", x[i].tolist(), int(y[i]), 1.5 if y[i] else 1.0) for i in range(900)]
    return spark.createDataFrame(data, f"{KEY} string, vector array<double>, y int, weight double").repartition(5).persist()


@pytest.fixture(scope="module")
def both(spark, rows):
    """The same rows with the same folds, on the driver and spread."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(spread_trees, "BLOCK_ROWS", 64)
        folds = stratified_folds(rows.select(KEY, "y"), 3, 42)
        return trees.gathered(rows, KEY, folds.select(KEY, "y", "fold")), spread_trees.spread_rows(rows, KEY, 3, 42)


def test_edges_are_those_of_all_rows(both):
    sample, spread = both
    assert spread.n == 900
    for s in range(4):
        assert [e.tolist() for e in spread.edges[s]] == [trees.bin_edges(c).tolist() for c in sample.x[sample.fold != s].T]


def test_numbers_keep_the_order_of_doubles():
    x = np.array([-np.inf, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.0, 2.0, np.inf])
    keys = spread_trees.ordered(x)
    assert (np.diff(keys.astype(object)) > 0).all() and (spread_trees._doubles(keys) == x).all()
    assert spread_trees.ordered(np.array([-0.0]))[0] == spread_trees.ordered(np.array([0.0]))[0]


def test_fits_on_spread_rows_are_those_of_one_task(spark, both, monkeypatch):
    sample, spread = both
    monkeypatch.setattr(spread_trees, "KEPT_TREES", 2)
    monkeypatch.setattr(spread_trees, "SUM_BYTES", 100_000)
    monkeypatch.setattr(spread_trees, "MANY_PARTS", 1)
    monkeypatch.setattr(spread_trees, "MARGIN_BYTES", 8 * 900 * 3)  # one setting at a time
    got, want = spread_trees.cross_validate(spark, spread, SETTINGS, 7), trees.cross_validate(spark, sample, SETTINGS, 3, 7)
    assert np.allclose(got, want, atol=1e-12) and min(want) > 0.6
    one, other = spread_trees.refit(spark, spread, SETTINGS[1], 7), trees.refit(spark, sample, SETTINGS[1], 7)
    for name in ("feature", "threshold", "left", "right", "roots"):
        assert getattr(one, name).tolist() == getattr(other, name).tolist(), name
    assert np.allclose(one.value, other.value) and one.n_features == other.n_features == 5


def test_rows_are_drawn_by_their_keys(spark, both):
    names = np.arange(20_000, dtype=np.int64) * 7919
    some, same, others = (spread_trees.drawn(names, s, 0.7) for s in ((1, 0, 2, 5), (1, 0, 2, 5), (1, 0, 2, 6)))
    assert (some == same).all() and abs(some.mean() - 0.7) < 0.02 and abs((some & others).mean() - 0.49) < 0.02
    auc = spread_trees.cross_validate(spark, both[1], [SETTINGS[1] | {"subsample": 0.7}], 7)[0]
    assert abs(auc - trees.cross_validate(spark, both[0], [SETTINGS[1]], 3, 7)[0]) < 0.05


def test_training_beyond_what_a_task_holds_takes_all_rows(spark, rows, monkeypatch):
    """Rows of which a small sample knows nothing: one in twenty has the feature that tells the classes apart."""
    monkeypatch.setattr(trees, "MAX_TRAINING_ROWS", 40)
    data = rows.select(KEY, "y", F.col("vector")[0].alias("a"), F.array((F.xxhash64(KEY) % 20 == 0).cast("double") * (F.col("y") * 2 - 1)).alias("embedding"))
    space = {"n_estimators": (2,), "max_depth": (2,), "learning_rate": (1.0,)}
    done = models.train_gbt(data, ["a"], space, 1)
    monkeypatch.setattr(trees, "MAX_TRAINING_ROWS", 1000)
    whole = models.train_gbt(data, ["a"], space, 1)
    assert done.model.threshold.tolist() == whole.model.threshold.tolist() and np.allclose(done.model.value, whole.model.value)
    assert abs(done.cv_auc - whole.cv_auc) < 1e-12
