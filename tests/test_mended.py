"""Empty tables, nulls, single classes, and groups larger than a task, of functions that once failed on them."""

import numpy as np
from pyspark.sql import functions as F

from spectrafold.functions import decisions, scores, spectra, training
from spectrafold.operators import moments, spatial, windows


def test_weights_of_nothing(spark):
    none = spark.createDataFrame([], "fold long, v array<double>, y double")
    assert spatial.ridge_folds(none, "fold", "v", "y", 2, 1.0) == {}
    assert spatial.decision_values(none, "fold", "v", {}).columns == ["fold", "v", "y", "dv"]
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1.0)], none.schema)
    assert spatial.decision_values(rows, "fold", "v", {}).collect()[0]["dv"] is None


def test_folds_of_nothing_and_of_one_class(spark):
    none = spark.createDataFrame([], "v array<double>, y int, fold int")
    assert training.over_folds(none, "v", "y", "fold", [0, 1], [0.1]).collect() == []
    one = spark.createDataFrame([([float(i)], 1, i % 2) for i in range(8)] + [([1.0], 0, None)], none.schema)
    assert {r["dv"] for r in training.over_folds(one, "v", "y", "fold", [0, 1], [0.1]).collect()} == {1.0}
    alone = one.where("fold = 0")
    assert {r["dv"] for r in training.over_folds(alone, "v", "y", "fold", [0], [0.1]).collect()} == {None}


def test_null_elements_and_times(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (0, [None, 5.0]), (0, [float("nan"), 5.0]), (None, [9.0, 9.0])], "g int, v array<double>")
    assert np.allclose(spatial.second_moments(rows, "g", "v", 2)[0], [[1, 2], [2, 4]])
    cells = [("a", t, float(np.sin(t))) for t in range(40)] + [("a", None, 1.0), ("b", 3, None), (None, 0, 1.0)]
    found = spectra.welch(spark.createDataFrame(cells, "ch string, time int, x double"), "time", 1.0, 8).collect()
    assert {r["ch"] for r in found} == {"a", "b", None} and all(np.isfinite(r["x"]) for r in found)
    assert spectra.welch(spark.createDataFrame(cells, "ch string, time int, x double").limit(0), "time", 1.0, 8).collect() == []


def test_welch_window_by_window(spark):
    rng = np.random.default_rng(3)
    x = {t: float(rng.normal()) for t in range(5, 205) if t % 9}
    found = {r["freq"]: r["x"] for r in spectra.welch(spark.createDataFrame(list(x.items()), "time int, x double").repartition(5), "time", 10.0, 32).collect()}
    series, taper = np.array([x.get(t, 0.0) for t in range(5, 205)]), np.hamming(32)
    t, power = np.arange(32), []
    for s in range(0, len(series) - 31, 16):
        part = series[s : s + 32]
        power.append(2 * np.abs(np.fft.rfft((part - np.polyval(np.polyfit(t, part, 1), t)) * taper)) ** 2 / (taper**2).sum())
    wanted = np.mean(power, 0)
    assert np.allclose([found[k] for k in sorted(found)], wanted) and np.allclose(sorted(found), np.fft.rfftfreq(32, 0.1))


def test_one_group_over_many_parts(spark):
    rng = np.random.default_rng(5)
    y, v = rng.choice([-1, 1], 3000), np.round(rng.normal(size=3000), 2)
    v = v + 0.5 * y
    rows = spark.createDataFrame([(0, int(a), float(b)) for a, b in zip(y, v)] + [(None, 1, 1.0), (None, -1, 0.0), (1, 0, 2.0), (1, None, 2.0)], "g int, y int, x double").repartition(6)
    found = {r["g"]: r["auc"] for r in scores.auc(rows, ["g"]).collect()}
    wins = (v[y > 0][:, None] > v[y < 0]).mean() + 0.5 * (v[y > 0][:, None] == v[y < 0]).mean()
    assert np.isclose(found[0], wins) and found[None] == 1.0 and 1 not in found
    best = {r["g"]: (r["offset"], r["errors"]) for r in decisions.best_offset(rows, "y", "x", ["g"]).collect()}
    errors = lambda cut: ((v > cut) != (y > 0)).sum()
    values = np.unique(v)
    assert best[0][1] == min(errors(c) for c in (values[:-1] + values[1:]) / 2) == errors(-best[0][0])
    folds = scores.folds(spark.range(1001).select((F.col("id") % 2).alias("c"), "id").repartition(5), "c", "id", 3)
    assert sorted((r["c"], r["fold"], r["count"]) for r in folds.groupBy("c", "fold").count().collect()) == [(0, 0, 167), (0, 1, 167), (0, 2, 167), (1, 0, 167), (1, 1, 167), (1, 2, 166)]
    ranks = decisions.shuffled_rank(spark.range(1000).withColumn("g", F.lit(1)).repartition(4), ["g"], F.col("id")).collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 1001)) and [r["id"] for r in sorted(ranks, key=lambda r: r["rank"])] != list(range(1000))


def test_spans_by_bins(spark):
    cube = spark.createDataFrame([("a", t, float(t)) for t in range(50)] + [("a", None, 1.0)], "ch string, time int, x double")
    spans = spark.createDataFrame([("p", 3, 10), ("q", 8, 40), ("r", 60, 70), ("s", 5, 5)], "name string, lo int, hi int")
    found = sorted((r["name"], r["time"]) for r in windows.given_epochs(cube, spans, "time").collect())
    assert found == [("p", t) for t in range(3, 10)] + [("q", t) for t in range(8, 40)]
    assert windows.given_epochs(cube, spans.limit(0), "time").collect() == []


def test_shrinkage_reads_its_samples_once(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3)) @ [[1, 0.5, 0], [0, 1, 0.5], [0, 0, 1]]
    cells = [(c, t, 0, float(x[t, c])) for t in range(50) for c in range(3)] + [(0, 99, 0, 5.0)]
    found = moments.shrunk_to_diagonal(spark.createDataFrame(cells, "ch int, time int, epoch int, x double"))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 4
    z = x - x.mean(0)
    s, q = z.T @ z / 50, (z**2).T @ (z**2) / 50
    off = ~np.eye(3, dtype=bool)
    amount = min(1, (q - s**2)[off].sum() / (s[off] ** 2).sum() / 50)
    assert all(np.isclose(r["x"], s[r["i"], r["j"]] * (1 - amount if r["i"] != r["j"] else 1)) for r in found.collect())
