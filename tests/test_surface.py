"""Spherical splines: known sums, smooth fields found again, patterns of missing channels, awkward rows."""

import numpy as np
import pytest

from spectrafold.operators import surface


def test_splines():
    # The first two terms by hand: P1 = c, P2 = (3 c^2 - 1) / 2.
    assert surface.spline(np.array(0.5), 4, 2) == pytest.approx((3 / 16 * 0.5 + 5 / 1296 * (3 * 0.25 - 1) / 2) / (4 * np.pi))
    assert np.allclose(surface.weights(np.eye(3)[:1], np.eye(3)), 1)
    rng = np.random.default_rng(2)
    at = rng.normal(size=(40, 3))
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    field = lambda p: 2 + p[:, 0] - 0.5 * p[:, 1] * p[:, 2]
    assert np.abs(surface.weights(at[:30], at[30:], 1e-9) @ field(at[:30]) - field(at[30:])).max() < 0.05


def test_filling(spark):
    at = {"a": (1.0, 0.0, 0.0), "b": (0.0, 2.0, 0.0), "c": (0.0, 0.0, 1.0), "d": (-1.0, 1.0, 0.5)}
    cells = [(0, "a", 1.0), (0, "b", 2.0), (0, "c", 3.0), (0, "d", 4.0), (1, "a", 1.0), (1, "b", None), (1, "c", float("nan")), (1, "d", 5.0), (2, "a", 7.0), (3, "z", 9.0), (3, None, 8.0), (4, "a", None), (None, "a", 1.0)]
    found = {(r["time"], r["ch"]): r["x"] for r in surface.filled(spark.createDataFrame(cells, "time int, ch string, x double").repartition(3), at).collect()}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in at.items()}
    two = surface.weights(np.array([unit["a"], unit["d"]]), np.array([unit["b"], unit["c"]])) @ [1.0, 5.0]
    assert found[1, "b"] == pytest.approx(two[0]) and found[1, "c"] == pytest.approx(two[1])
    assert [found[0, c] for c in "abcd"] == [1, 2, 3, 4] and all(found[t, c] == pytest.approx(v) for t, v in ((2, 7.0), (None, 1.0)) for c in "abcd")
    assert found[3, "z"] == 9 and found[3, None] == 8 and not any(t == 4 for t, _ in found) and len(found) == 18
    assert surface.filled(spark.createDataFrame([], "time int, ch string, x double"), at).collect() == []
