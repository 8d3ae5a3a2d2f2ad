"""Classifiers on made data: known weights, held-out rates, and plain numpy."""

import numpy as np
import pytest

from spectrafold.functions import training


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    rows = [(i, [float(v) for v in r], int(k), i % 3) for i, (r, k) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame([*rows, (300, None, 1, 0), (301, [0.0, 0.0, 0.0], None, 1)], "id int, v array<double>, y int, fold int").cache()


def test_logistic_agrees_with_newton(made):
    x, y, rows = made
    w, b = training.logistic(rows, "v", "y", 0.01)
    a, theta = np.c_[x, np.ones(len(x))], np.zeros(4)
    ridge = np.diag([0.01] * 3 + [0.0]) * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ theta))
        theta -= np.linalg.solve(a.T * (p * (1 - p)) @ a + ridge, a.T @ (p - y) + ridge @ theta)
    assert np.allclose([*w[0], b[0]], theta, atol=1e-3)


def test_lasso_drops_what_says_nothing(made):
    w, _ = training.logistic(made[2], "v", "y", 0.1, 1.0)
    assert w[0][2] == 0 and w[0][0] > 0 > w[0][1]


def test_discriminant_agrees_with_numpy(made):
    x, y, rows = made
    w, b = training.discriminant(rows.where("v is not null and y is not null"), "v", "y", 3)
    means = [x[y == k].mean(axis=0) for k in (0, 1)]
    within = sum((x[y == k] - means[k]).T @ (x[y == k] - means[k]) for k in (0, 1)) / len(x)
    assert np.allclose(w, np.linalg.solve(within, means[1] - means[0]), rtol=1e-3)
    assert np.isclose(b, -w @ (means[0] + means[1]) / 2)


def test_folds_and_penalties(made):
    _, _, rows = made
    values = training.over_folds(rows.where("v is not null and y is not null"), "v", "y", "fold", [0, 1, 2], [0.01, 10.0])
    assert values.count() == 600
    best = training.best_penalty(values.withColumn("side", values.y * 2 - 1), "side").first()
    assert best["rate"] > 0.9
