"""Recursive filters and running sums: step by step, over many parts, nulls, ties, resets, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import ordered, recursive


def _steps(system, xs, resets=None):
    state, out = np.zeros(len(system.take)), []
    for k, x in enumerate(xs):
        if resets and resets[k]:
            state = np.zeros(len(system.take))
        if x is None or x != x:
            out.append(None)
        else:
            out.append(float(system.give @ state + system.through * x))
            state = system.step @ state + system.take * x
    return out


def test_one_long_series(spark):
    # A million rows of one key: dealt over ranges, equal to a run step by step.
    rows = spark.range(1_000_000).select(F.lit("a").alias("k"), F.col("id").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(2000)) / 1000.0 - 1).alias("x")).repartition(7)
    system = recursive.butterworth(4, 0.1, 1.0)
    found = recursive.filtered(rows, ["k"], ["t"], system).toPandas().sort_values("t")
    xs = rows.orderBy("t").toPandas()["x"].to_numpy()
    state, wanted = np.zeros(4), np.empty(len(xs))
    for k, x in enumerate(xs):
        wanted[k] = system.give @ state + system.through * x
        state = system.step @ state + system.take * x
    assert len(found) == len(xs) and np.abs(found["x"].to_numpy() - wanted).max() < 1e-9


@pytest.mark.parametrize("system", [recursive.equation([2.0]), recursive.equation([0.5, 0.25], [2.0, -1.0, 0.3]), recursive.butterworth(2, (0.1, 0.2), 1.0, "bandpass"), recursive.equation(recursive.windowed_taps(8, 0.2, 1.0, "high"))])
def test_against_steps(spark, system):
    rng = np.random.default_rng(4)
    rows = [(k, i, None if rng.random() < 0.1 else float(rng.normal()), bool(rng.random() < 0.1)) for k in ("a", "b", None) for i in range(120)]
    rows += [("c", 0, float("nan"), False), ("d", 5, 1.0, True)]
    table = spark.createDataFrame(rows, "k string, t int, x double, r boolean").repartition(5)
    for reset in (None, F.col("r")):
        found = {(r["k"], r["t"]): r["x"] for r in recursive.filtered(table, ["k"], ["t"], system, reset).collect()}
        assert len(found) == len(rows)
        for key in ("a", "b", None, "c", "d"):
            own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
            wanted = _steps(system, [r[2] for r in own], [r[3] for r in own] if reset is not None else None)
            for r, w in zip(own, wanted):
                assert found[key, r[1]] == (w if w is None else pytest.approx(w, abs=1e-9))


def test_ties_and_empty(spark):
    system = recursive.equation([1.0], [1.0, -0.5])
    table = spark.createDataFrame([(1, 2.0), (1, 1.0), (1, 1.0), (0, 4.0)], "t int, x double")
    assert sorted(r["x"] for r in recursive.filtered(table, [], ["t"], system).collect()) == sorted(_steps(system, [4.0, 1.0, 1.0, 2.0]))
    assert recursive.filtered(table.limit(0), [], ["t"], system).collect() == []
    assert recursive.less_exponential_mean(table.limit(0), [], ["t"], 3.0).collect() == []


def test_designs():
    def gain(system, f):
        z = np.exp(2j * np.pi * f)
        return abs(system.give @ np.linalg.solve(z * np.eye(len(system.take)) - system.step, system.take) + system.through)

    for order in (1, 2, 3, 5):
        for kind, cut, one, none in (("low", 0.1, 1e-6, 0.5 - 1e-9), ("high", 0.1, 0.5 - 1e-9, 1e-6), ("stop", (0.1, 0.2), 1e-6, None), ("bandpass", (0.1, 0.2), None, 1e-6)):
            system = recursive.butterworth(order, cut, 1.0, kind)
            assert np.abs(np.linalg.eigvals(system.step)).max() < 1
            for edge in np.atleast_1d(cut):
                assert gain(system, edge) == pytest.approx(0.5**0.5, abs=1e-6)
            assert one is None or gain(system, one) == pytest.approx(1, abs=1e-6)
            assert none is None or gain(system, none) < 1e-4
    # An ideal response under a window: half at the edge.
    taps = recursive.equation(recursive.windowed_taps(60, 0.2, 1.0))
    assert gain(taps, 1e-9) == pytest.approx(1, abs=1e-9) and abs(gain(taps, 0.2) - 0.5) < 0.01 and gain(taps, 0.3) < 0.01


def test_numbers_and_sums_over_parts(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 7 > 0, F.col("id") % 11).alias("v")).withColumn("k", F.when(F.col("k") > 0, F.col("k"))).repartition(6)
    found = ordered.running_sums(rows, ["k"], ["t"], {"s": F.col("v")}, total=True)
    found = {r["t"]: (r["number"], r["s"], r["s_all"]) for r in ordered.numbered(found, ["k"], [F.desc("t")]).collect()}
    for k in range(3):
        own = [t for t in range(5000) if t % 3 == k]
        sums = np.cumsum([t % 11 if t % 7 else 0 for t in own])
        for i, t in enumerate(own):
            assert found[t] == (len(own) - i, sums[i], sums[-1])
    assert ordered.numbered(rows.limit(0), [], ["t"]).collect() == []


def test_exponential_means_of_tied_rows(spark):
    # One pass for all powers: rows of one place stay as many as they are.
    table = spark.createDataFrame([(0, 4.0), (1, 2.0), (1, 1.0), (2, None), (3, 1.0)], "t int, x double")
    for name, k in (("less_exponential_mean", 1), ("by_exponential_power", 2)):
        found = getattr(recursive, name)(table, [], ["t"], 0.5).collect()
        e = [_steps(recursive.equation([0.5], [1.0, -0.5]), [x if x is None else x**j for x in (4.0, 1.0, 2.0, None, 1.0)]) for j in (0, k)]
        wanted = [None if x is None else x - m / w if k == 1 else x / (m / w) ** 0.5 for x, w, m in zip((4.0, 1.0, 2.0, None, 1.0), *e)]
        assert [r["x"] for r in sorted(found, key=lambda r: (r["t"], r["t"] == 1 and (r["x"] or 0)))] == [w if w is None else pytest.approx(w) for w in wanted]
