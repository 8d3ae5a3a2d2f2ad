"""Deconvolution: planted responses under overlap, dense least squares, awkward rows."""

import numpy as np
import pytest

from spectrafold.operators import responses


def _made(rng, n_series=3, n=200, length=6):
    irf = {("a", c): rng.normal(size=length) for c in (1, 2)} | {("b", c): rng.normal(size=length) for c in (1, 2)}
    cells, stimuli = [], []
    for e in range(n_series):
        x = {ch: np.zeros(n) for ch in "ab"}
        for t in range(n):
            for c in (1, 2):
                if rng.random() < 0.2:
                    w = float(rng.choice([1.0, 2.0]))
                    stimuli.append((e, t, c, w))
                    for ch in "ab":
                        tail = irf[ch, c][: n - t]
                        x[ch][t : t + len(tail)] += w * tail
        cells += [(ch, e, t, float(v)) for ch in "ab" for t, v in enumerate(x[ch])]
    return irf, cells, stimuli


def test_planted_responses(spark):
    # Responses overlap, and the last ones are cut off by the series' end.
    irf, cells, stimuli = _made(np.random.default_rng(8))
    cube = spark.createDataFrame(cells, "ch string, epoch int, time int, x double").repartition(4)
    extra = [(0, None, 1, 1.0), (0, 3, None, 1.0), (0, 3, 1, None), (9, 3, 1, 1.0), (None, 3, 1, 1.0), (0, -5, 1, 1.0), (0, 200, 2, 1.0)]
    table = spark.createDataFrame(stimuli + extra, "epoch int, time int, code int, w double").repartition(3)
    found = {(r["ch"], r["code"], r["lag"]): r["x"] for r in responses.deconvolved(cube, table, ["epoch"], 6).collect()}
    assert found == {(ch, c, lag): pytest.approx(v[lag], abs=1e-8) for (ch, c), v in irf.items() for lag in range(6)}


def test_against_dense_least_squares(spark):
    rng = np.random.default_rng(2)
    _, cells, stimuli = _made(rng, 2, 60, 5)
    cells = [(ch, e, t, x + float(rng.normal())) for ch, e, t, x in cells if ch == "a"]
    found = responses.deconvolved(spark.createDataFrame(cells, "ch string, epoch int, time int, x double"), spark.createDataFrame(stimuli, "epoch int, time int, code int, w double"), ["epoch"], 5, 0.01)
    design, y = np.zeros((120, 10)), np.zeros(120)
    for _, e, t, x in cells:
        y[60 * e + t] = x
    for e, t, c, w in stimuli:
        for lag in range(min(5, 60 - t)):
            design[60 * e + t + lag, 5 * (c - 1) + lag] += w
    gram = design.T @ design
    wanted = np.linalg.solve(gram + 0.01 * np.trace(gram) / 10 * np.eye(10), design.T @ y)
    assert {(r["code"], r["lag"]): r["x"] for r in found.collect()} == {(c, lag): pytest.approx(wanted[5 * (c - 1) + lag], abs=1e-9) for c in (1, 2) for lag in range(5)}


def test_empty_and_too_wide(spark):
    cube = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, None)], "ch string, epoch int, time int, x double")
    none = spark.createDataFrame([], "epoch int, time int, code int, w double")
    assert responses.deconvolved(cube, none, ["epoch"], 3).collect() == []
    assert responses.deconvolved(cube.limit(0), spark.createDataFrame([(0, 0, 1, 1.0)], none.schema), ["epoch"], 3).collect() == []
    with pytest.raises(ValueError, match="unknowns"):
        responses.deconvolved(cube, spark.createDataFrame([(0, 0, 1, 1.0)], none.schema), ["epoch"], 5000)
