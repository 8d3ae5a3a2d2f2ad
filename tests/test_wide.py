"""Products, factors, components, canonical pairs and robust sums against numpy, over several tasks and with awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import wide

AWKWARD = [(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [1.0, float("nan"), 2.0, 3.0]), (903, [1.0]), (904, [])]


def _table(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra), "id int, v array<double>").repartition(5)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(12)
    return rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + [5.0, 0.0, -3.0, 1.0]


def test_sums_and_factor(spark, cloud):
    rows = _table(spark, cloud, AWKWARD)
    sums = wide.gathered(wide.outer_sums(rows, F.when(F.col("id") % 3 > 0, F.col("id") % 3), "v", 4), 4, 4)
    assert sorted(sums) == [1, 2]
    for g, m in sums.items():
        own = cloud[np.arange(400) % 3 == g]
        assert np.allclose(m, own.T @ own)
    for fan in (2, 16):
        r = wide.triangle(rows, "v", 4, fan)
        assert np.allclose(r.T @ r, cloud.T @ cloud) and np.allclose(r, np.triu(r)) and (np.diag(r) >= 0).all()
    n, middle = wide.mean(rows, "v", 4)
    assert n == 400 and np.allclose(middle, cloud.mean(0))
    changed = {r["id"]: r["v"] for r in wide.projected(rows, "v", np.eye(4)[:, :2], middle).collect()}
    assert np.allclose([changed[i] for i in range(400)], (cloud - cloud.mean(0))[:, :2]) and all(changed[i] is None for i, _ in AWKWARD)


def test_few_rows_and_none(spark):
    assert np.allclose(wide.triangle(_table(spark, [[3.0, 4.0]]), "v", 2), [[3.0, 4.0], [0.0, 0.0]])
    none = _table(spark, [[1.0, 2.0]]).limit(0)
    assert np.allclose(wide.triangle(none, "v", 2), 0) and wide.mean(none, "v", 2)[0] == 0
    _, components, variances = wide.principal(none, "v", 2, 2)
    assert components.shape == (2, 0) and len(variances) == 0
    assert wide.robust_covariance(none, F.lit(0), "v", 2, "bounded", 2.0) == {} and wide.projected(none, "v", np.eye(2)).collect() == []
    assert np.allclose(wide.canonical(none.select("v", F.col("v").alias("w")), "v", "w", 2, 2)[2], 0)


def test_components_of_wide_vectors(spark):
    # 300 dimensions, 5 of them large: found without a matrix of 300 x 300.
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    x = (rng.normal(size=(500, 300)) * np.r_[20, 15, 11, 8, 6, np.full(295, 0.1)]) @ turn.T + rng.normal(size=300)
    middle, found, variances = wide.principal(_table(spark, x), "v", 300, 5)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(middle, x.mean(0)) and np.allclose(variances, s[:5] ** 2 / 500, rtol=1e-8)
    assert np.allclose(np.abs((vt[:5] * found.T).sum(1)), 1, atol=1e-6)


def test_canonical_pairs(spark):
    rng = np.random.default_rng(3)
    shared = rng.normal(size=(600, 2))
    p = np.c_[shared[:, 0] + 0.1 * rng.normal(size=600), rng.normal(size=600), rng.normal(size=600)]
    q = np.c_[rng.normal(size=600), shared[:, 0] + 0.1 * rng.normal(size=600)]
    rows = spark.createDataFrame([([float(v) for v in a], [float(v) for v in b]) for a, b in zip(p, q)] + [(None, [1.0, 2.0])], "p array<double>, q array<double>").repartition(4)
    wx, wy, rho = wide.canonical(rows, "p", "q", 3, 2)
    u, v = (p - p.mean(0)) @ wx, (q - q.mean(0)) @ wy
    assert np.allclose(u.T @ u / 600, np.eye(2), atol=1e-9) and np.allclose(u.T @ v / 600, np.diag(rho), atol=1e-9) and rho[0] > 0.97


@pytest.mark.parametrize(("how", "parameter"), [("sign", 0.0), ("power", 1.0), ("bounded", 2.0), ("cut", 2.0)])
def test_robust_sums(spark, how, parameter):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) @ np.diag([1.0, 2.0, 0.5])
    x[::20] += [0.0, 0.0, 40.0]
    found, rounds = wide.robust_covariance(_table(spark, x), F.lit(0), "v", 3, how, parameter, rounds=8)[0]
    c, w = x.T @ x, np.ones(300)
    for k in range(1, 9):
        inverse = np.linalg.pinv(c)
        new = wide.WEIGHTS[how](np.einsum("ij,jk,ik->i", x, inverse, x), (x * x).sum(1), parameter, 300, 3)
        c, change, w = (x * new[:, None]).T @ x * 300 / new.sum(), np.abs(new - w).sum(), new
        if change <= 1e-5 * new.sum():
            break
    assert rounds == k and np.allclose(found, c, rtol=1e-8)
    if how in ("bounded", "cut"):
        # The planted outliers hardly count.
        assert found[2, 2] / 300 < 0.2 * (x.T @ x)[2, 2] / 300


def test_shrinkage_to_a_market(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 1)) * [1.0, 0.5, 0.8, 1.2] + rng.normal(size=(60, 4)) * [0.3, 1.0, 0.5, 0.7]
    found, amount = wide.market_shrunk(_table(spark, x, AWKWARD), "v", 4)
    z = x - x.mean(0)
    market = z.mean(1)
    sample, shared, variance = z.T @ z / 60, z.T @ market / 60, (market**2).mean()
    model = np.outer(shared, shared) / variance
    np.fill_diagonal(model, np.diag(sample))
    # Each entry's noise, and how it goes with the model's, sample by sample.
    noise = together = 0.0
    for i in range(4):
        for j in range(4):
            own = z[:, i] * z[:, j] - sample[i, j]
            noise += (own**2).mean()
            if i == j:
                together += (own**2).mean()
            else:
                change = (shared[j] * variance * z[:, i] + shared[i] * variance * z[:, j] - shared[i] * shared[j] * market) / variance**2 * market * z[:, i] * z[:, j]
                together += change.mean() - shared[i] * shared[j] / variance * sample[i, j]
    wanted = min(1, max(0, (noise - together) / ((sample - model) ** 2).sum() / 60))
    assert 0 < amount < 1 and amount == pytest.approx(wanted, rel=1e-6)
    assert np.allclose(found, amount * model + (1 - amount) * sample)
    assert wide.market_shrunk(_table(spark, x).limit(0), "v", 4)[1] == 0
