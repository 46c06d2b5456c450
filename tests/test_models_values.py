"""Fitted models against closed forms and against Newton steps on the same rows."""

import math
import random

import numpy as np
import pytest

from parlance.operators import models
from parlance.schema import KEY


def table(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(["y int", *[f"{n} double" for n in names]]))


def newton(x, y, weight, penalty):
    """Logistic regression by Newton's method; the intercept, in the first column, is free."""
    beta, free = np.zeros(x.shape[1]), np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (weight * (p - y)) + free @ beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + free
        beta = beta - np.linalg.solve(hessian, gradient)
    return beta, hessian


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for _ in range(400):
        a, b, c = rng.gauss(0, 1), rng.gauss(2, 3), rng.choice([0.0, 1.0])
        p = 1 / (1 + math.exp(-(0.8 * a - 0.2 * b + 1.1 * c - 0.3)))
        out.append((int(rng.random() < p), a, b, c, rng.gauss(0, 1), 5.0, 2 * a + b))
    return out


def test_wald_on_one_binary_feature_has_the_closed_form(spark):
    """Log odds ratio and its error from the four counts."""
    counts = {(0, 0): 40, (0, 1): 15, (1, 0): 25, (1, 1): 30}  # (y, x)
    data = [(y, float(x)) for (y, x), n in counts.items() for _ in range(n)]
    got = models.wald_p_values(table(spark, data, ["x"]), ["x"]).first().p_value
    z = math.log(counts[1, 1] * counts[0, 0] / (counts[1, 0] * counts[0, 1])) / math.sqrt(sum(1 / n for n in counts.values()))
    assert abs(got - math.erfc(abs(z) / math.sqrt(2))) < 1e-6


def test_wald_matches_newton_and_has_no_test_for_dependent_columns(spark, rows):
    names = ["a", "b", "c", "noise", "constant", "sum"]
    tested = {r.feature: (r.p_value, r.selected) for r in models.wald_select(table(spark, rows, names), names).collect()}
    data = np.array(rows)
    z = (data[:, 1:5] - data[:, 1:5].mean(0)) / data[:, 1:5].std(0)
    beta, hessian = newton(np.hstack([np.ones((400, 1)), z]), data[:, 0], np.ones(400), 0.0)
    error = np.sqrt(np.diag(np.linalg.inv(hessian)))
    for i, name in enumerate(names[:4]):
        assert abs(tested[name][0] - math.erfc(abs(beta[i + 1] / error[i + 1]) / math.sqrt(2))) < 1e-6
        assert tested[name][1] == (tested[name][0] <= 0.05)
    assert tested["constant"] == (None, False) and tested["sum"] == (None, False)
    weak = models.wald_select(table(spark, [r[:1] + (r[4],) for r in rows], ["noise"]), ["noise"]).first()
    assert weak.selected  # the best of none that pass


def test_logistic_regression_is_at_its_optimum(spark, rows):
    names = ["a", "b", "c"]
    scorer, model = models.train_lr(table(spark, [r[:4] for r in rows], names), names)
    data = np.array(rows)
    y = data[:, 0]
    z = (data[:, 1:4] - data[:, 1:4].mean(0)) / data[:, 1:4].std(0)
    weight = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    beta, _ = newton(np.hstack([np.ones((400, 1)), z]), y, weight, weight.sum() / 400)
    assert np.allclose([scorer.intercept, *[scorer.coefficients[n] for n in names]], beta, atol=2e-4)
    p = 1 / (1 + np.exp(-(scorer.intercept + z @ [scorer.coefficients[n] for n in names])))
    assert np.abs(z.T @ (weight * (p - y)) + np.array([scorer.coefficients[n] for n in names])).max() < 0.05
    scored = table(spark, [r[:4] for r in rows], names).select(scorer.proba().alias("p")).collect()
    assert np.allclose([r.p for r in scored], p)


def test_the_feature_report_joins_both_tests(spark):
    scores = spark.createDataFrame([("a", 0.3), ("b", 0.5), ("c", 0.01)], "feature string, iv double")
    tested = spark.createDataFrame([("a", 0.01, True), ("b", 0.2, False)], "feature string, p_value double, selected boolean")
    report = [tuple(r) for r in models.feature_report(scores, tested).collect()]
    assert report == [("b", 0.5, 0.2, False), ("a", 0.3, 0.01, True)]


def test_both_models_score_rows_with_and_without_a_vector(spark):
    from parlance.plans import inputs as q

    names = models.LINGUISTIC_FEATURES
    row = {n: 0.0 for n in names} | {"vague_ratio": 0.3, "filter_ratio": 0.5}
    values = [(f"k{i}", *[row[n] for n in names], v) for i, v in enumerate([None, [0.5] * 64])]
    frame = spark.createDataFrame(values, f"{KEY} string, " + ", ".join(f"{n} double" for n in names) + ", embedding array<float>")
    done = {r[KEY]: r for r in models.predict_all(frame, q.fixed_scorer(), 0.5, q.fixed_trees(), 0.55).collect()}
    assert done["k0"].proba_xgb is None and done["k0"].pred_xgb is None and done["k0"].proba_lr == done["k1"].proba_lr
    assert abs(done["k1"].proba_xgb - 1 / (1 + math.exp(-(0.7 + 0.35 - 0.6)))) < 1e-12
