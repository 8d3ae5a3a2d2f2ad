"""Pipelines over folds against refitting, kernel features, distances of matrices, chance, fractional bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.functions import covariances, decisions, kernels, pipelines
from spectrafold.operators import statistics


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(21)
    x = rng.normal(size=(240, 5)) @ rng.normal(size=(5, 5)) + 3
    y = x @ [1.0, -2.0, 0.5, 0.0, 1.0] + rng.normal(size=240)
    return x, y, np.arange(240) % 4, (np.arange(240) // 4) % 3


def _rows(spark, made, extra=()):
    x, y, fold, inner = made
    rows = [(i, int(f), int(k), [float(v) for v in r], float(t)) for i, (r, t, f, k) in enumerate(zip(x, y, fold, inner))]
    return spark.createDataFrame(rows + list(extra), "id int, fold int, inner int, v array<double>, y double").repartition(4)


def _refit(x, y, stages, penalty):
    """The stages in turn, each on what the one before gives."""
    now, ways = x, []
    for stage in stages:
        m = np.c_[np.ones(len(now)), now, y]
        step = stage(m.T @ m)
        ways.append(step)
        now = (m @ step)[:, 1:-1]
    centre = now.mean(0)
    w = np.linalg.solve((now - centre).T @ (now - centre) + penalty * np.eye(now.shape[1]), (now - centre).T @ (y - y.mean()))

    def apply(v):
        for step in ways:
            v = (np.c_[np.ones(len(v)), v, np.zeros(len(v))] @ step)[:, 1:-1]
        return (v - centre) @ w + y.mean()

    return apply


STAGES = [pipelines.standardised, pipelines.components(3), pipelines.whitened]


@pytest.mark.parametrize("stages", [[], [pipelines.centred], STAGES[:1], STAGES])
def test_equals_refitting_without_the_fold(spark, made, stages):
    x, y, fold, _ = made
    extra = [(900, None, 0, [1.0] * 5, 1.0), (901, 0, 0, None, 1.0), (902, 0, 0, [1.0, None, 1.0, 1.0, 1.0], 1.0), (903, 1, 0, [0.0] * 5, None)]
    rows = _rows(spark, made, extra)
    weights = pipelines.fold_weights(rows, "fold", "v", "y", 5, stages, [0.1, 2.0])
    found = {(r["id"], r["penalty"]): r["dv"] for r in pipelines.fold_values(rows, "fold", "v", weights, [0.1, 2.0]).collect()}
    assert len(found) == 2 * 244 and all(found[i, 2.0] is None for i in (900, 901, 902))
    for p in (0.1, 2.0):
        for f in range(4):
            wanted = _refit(x[fold != f], y[fold != f], stages, p)(x[fold == f])
            assert np.allclose([found[i, p] for i in np.flatnonzero(fold == f)], wanted, atol=1e-6)


def test_nested_folds(spark, made):
    x, y, fold, inner = made
    penalties = [0.01, 30.0, 1e4]
    best, weights = pipelines.nested(_rows(spark, made), "fold", "inner", "v", "y", 5, [pipelines.standardised], penalties)
    for f in range(4):
        errors = []
        for p in penalties:
            total = 0.0
            for k in range(3):
                train, held = (fold != f) & (inner != k), (fold != f) & (inner == k)
                total += ((_refit(x[train], y[train], [pipelines.standardised], p)(x[held]) - y[held]) ** 2).sum()
            errors.append(total)
        assert best[f] == penalties[int(np.argmin(errors))]
        assert np.allclose(weights[f, best[f]][0] + x @ weights[f, best[f]][1:], _refit(x[fold != f], y[fold != f], [pipelines.standardised], best[f])(x))


def test_pipelines_of_nothing(spark, made):
    rows = _rows(spark, made)
    assert pipelines.fold_weights(rows.limit(0), "fold", "v", "y", 5, STAGES, [1.0]) == {}
    alone = rows.where("fold = 2")
    weights = pipelines.fold_weights(alone, "fold", "v", "y", 5, STAGES, [1.0])
    assert weights == {} and all(r["dv"] is None for r in pipelines.fold_values(alone, "fold", "v", weights, [1.0]).collect())
    assert pipelines.nested(rows.limit(0), "fold", "inner", "v", "y", 5, [], [1.0]) == ({}, {})


@pytest.mark.parametrize(("kind", "scale"), [("linear", 1.0), ("poly", 1.0), ("rbf", 4.0), ("distance", 4.0)])
def test_kernel_features(spark, made, kind, scale):
    x = made[0]
    rows = _rows(spark, made, [(900, 0, 0, None, 0.0), (901, 0, 0, [float(v) for v in x[0]], 0.0)])
    errors = []
    for count in (8, 60):
        chosen, error = kernels.landmarks(rows, "v", 5, count, kind=kind, scale=scale)
        assert len(chosen) <= count and len(np.unique(chosen, axis=0)) == len(chosen)
        found = {r["id"]: r["v"] for r in kernels.nystrom(rows, "v", 5, chosen, kind, scale).collect()}
        phi, exact = np.array([found[i] for i in range(240)]), kernels.between(x, x, kind, scale)
        left = np.diag(exact) - (phi * phi).sum(1)
        assert left.min() > -1e-6 * exact.max() and found[900] is None and np.allclose(found[901], found[0])
        # A landmark's products are exact, and any other is as far off as the two diagonals allow.
        near = [i for i in range(240) if (x[i] == chosen).all(1).any()]
        assert np.allclose(phi[near] @ phi.T, exact[near], atol=1e-5 * exact.max())
        assert (np.abs(phi @ phi.T - exact) <= np.sqrt(np.outer(np.maximum(left, 0), np.maximum(left, 0))) + 1e-5 * exact.max()).all()
        assert error == pytest.approx(np.append(left, left[0]).mean(), abs=1e-5 * exact.max())
        errors.append(error)
    assert errors[1] <= errors[0] + 1e-9
    assert kernels.landmarks(rows.limit(0), "v", 5, 4)[0].shape == (0, 5)


def test_distances_of_matrices(spark):
    rng = np.random.default_rng(2)
    m = [(a := rng.normal(size=(4, 4))) @ a.T + 0.1 * np.eye(4) for _ in range(12)]
    rows = [(i, [float(v) for v in c.ravel()]) for i, c in enumerate(m)] + [(90, None), (91, [1.0]), (92, [None] * 16), (93, [0.0] * 16)]
    table, given = spark.createDataFrame(rows, "id int, m array<double>").repartition(3), np.array(m[:2])
    for how in covariances.KINDS:
        found = {r["id"]: r["distance"] for r in covariances.distances(table, "m", 4, given, how).collect()}
        for i, x in enumerate(m):
            for k, z in enumerate(given):
                values = np.linalg.eigvals(np.linalg.solve(x, z)).real
                wanted = {"log_product": 0.5 * (np.linalg.slogdet(x)[1] / 2 + np.linalg.slogdet(z)[1] / 2 - np.linalg.slogdet((x + z) / 2)[1]), "logarithms": np.sqrt((np.log(values) ** 2).sum()), "traces": (values.sum() + (1 / values).sum()) / 2}[how]
                assert found[i][k] == pytest.approx(wanted, rel=1e-8, abs=1e-9)
        assert all(found[i] == [None, None] for i in (90, 91, 92, 93))
    assert covariances.distances(table.limit(0), "m", 4, given, "traces").collect() == []


def test_chance_against_shuffles(spark):
    rng = np.random.default_rng(7)
    data = {g: (np.where(rng.random(n) < share, 1, -1), np.round(rng.normal(size=n), 1)) for g, n, share in (("a", 60, 0.5), ("b", 41, 0.2), ("c", 1, 1.0))}
    rows = [(g, int(y), float(v)) for g, (ys, vs) in data.items() for y, v in zip(ys, vs)] + [("a", 0, 1.0), ("a", None, 1.0), ("b", 1, None), ("none", 0, 1.0)]
    table = spark.createDataFrame(rows, "g string, y int, x double").repartition(3)
    found = {r["g"]: r for r in decisions.permutation_bounds(table, ["g"], "y", "x").collect()}
    assert sorted(found) == ["a", "b", "c"] and found["c"]["p"] == 0
    chance = {r["g"]: r for r in decisions.auc_chance(table, ["g"]).collect()}
    for g in ("a", "b"):
        ys, vs = data[g]
        shuffled = np.array([rng.permutation(ys) for _ in range(4000)])
        rates = ((shuffled > 0) == (vs > 0)).mean(1)
        p = (rates > found[g]["rate"] + 1e-12).mean()
        assert found[g]["rate"] == pytest.approx(((ys > 0) == (vs > 0)).mean()) and abs(found[g]["p"] - p) < 4 * (max(p * (1 - p), 0.001) / 4000) ** 0.5
        assert (rates >= found[g]["bound"] - 1e-12).mean() > 0.03 and (rates > found[g]["bound"] + 1e-12).mean() < 0.07
        above = lambda y: np.mean([(a > b) + 0.5 * (a == b) for a in vs[y > 0] for b in vs[y < 0]])
        assert chance[g]["auc"] == pytest.approx(above(ys)) and chance[g]["se"] == pytest.approx(np.std([above(y) for y in shuffled[:600]]), rel=0.1)
    assert decisions.permutation_bounds(table.limit(0), ["g"], "y", "x").collect() == []


def test_fractional_bins(spark):
    cells = [("a", t, float(t * t)) for t in range(10)] + [("b", 3, None), ("b", None, 1.0), (None, 0, 2.0)]
    found = {(r["k"], r["bin"]): (r["x"], r["weight"]) for r in statistics.fractional_bins(spark.createDataFrame(cells, "k string, t int, x double"), "t", 2.5).collect()}
    fine = np.repeat([float(t * t) for t in range(10)], 2).reshape(4, 5).mean(1)
    assert {k: v for k, v in found.items() if k[0] == "a"} == {("a", b): (pytest.approx(fine[b]), pytest.approx(2.5)) for b in range(4)}
    assert found["b", 1] == (None, 0.0) and found[None, 0] == (2.0, 1.0)


def test_lasso_from_sums(made):
    x, y, _, _ = made
    m = np.c_[np.ones(len(x)), x, y]
    for penalty in (0.0, 0.1, 1.0, 100.0):
        w = pipelines.lasso(m.T @ m, penalty)
        left = y - w[0] - x @ w[1:]
        slope = x.T @ left / len(x)
        # Where a weight is, the slope is the penalty; elsewhere it is no larger.
        assert abs(left.mean()) < 1e-8 and np.allclose(slope[w[1:] != 0], penalty * np.sign(w[1:][w[1:] != 0]), atol=1e-6) and (np.abs(slope) <= penalty + 1e-6).all()
    assert (w[1:] == 0).all()


def test_support_vectors(spark):
    from spectrafold.functions import training

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = (x @ [2.0, -1.0] + 0.5 + 0.4 * rng.normal(size=200) > 0).astype(int)
    rows = spark.createDataFrame([([float(v) for v in r], int(k)) for r, k in zip(x, y)] + [(None, 1), ([0.0, 0.0], None)], "v array<double>, y int")
    w, b = training.support_vectors(rows, "v", "y", 0.05)
    loss = lambda w, b: np.maximum(0, 1 - (2 * y - 1) * (x @ w + b)).mean() + 0.025 * (w @ w)
    assert all(loss(w, b) <= loss(w + d, b + c) + 2e-3 for d, c in ((np.array([0.1, 0]), 0), (np.array([-0.1, 0]), 0), (np.array([0, 0.1]), 0), (np.array([0, -0.1]), 0), (np.zeros(2), 0.1), (np.zeros(2), -0.1)))
    assert ((x @ w + b > 0) == (y > 0)).mean() > 0.9
    assert training.support_vectors(rows.where("y = 1"), "v", "y", 0.05)[1] == 1.0 and len(training.support_vectors(rows.limit(0), "v", "y", 0.05)[0]) == 0
