"""Plans of windows, nulls among keys, long series, and what has no SQL."""

import time

import pytest
from pyspark.sql import functions as F

from spectrafold.functions import decisions
from spectrafold.operators import cells, moments, records, statistics, windows
from spectrafold.plans.windowing import plan_windows
from spectrafold.sources.made import noise, toy_cube

CUBE = "ch string, time long, epoch long, x double"


def test_window_plans():
    assert plan_windows(100, overlap=0.5, width=10) == (list(range(0, 91, 5)), 10)
    assert plan_windows(100, count=19, width=10) == (list(range(0, 91, 5)), 10)
    assert plan_windows(100, count=19, overlap=0.5) == (list(range(0, 91, 5)), 10)
    assert plan_windows(100, width=10, step=5) == (list(range(0, 91, 5)), 10)
    assert plan_windows(100, starts=[3, 20], width=10) == ([3, 20], 10)
    assert plan_windows(100, starts=[0, 10, 20], overlap=0.5) == ([0, 10, 20], 15)
    assert plan_windows(100) == ([0], 100)


def test_null_keys_stay(spark):
    cube = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 0, 3.0), (None, 0, 0, 2.0), (None, 1, 0, None)], CUBE)
    for made in (statistics.standardised(cube, ["ch"]), statistics.normalised(cube, ["ch"]), statistics.clipped(cube, ["ch"]), statistics.outliers(cube, ["ch"], rounds=6), statistics.detrended(cube, "time")):
        assert made.count() == 4
    none = cube.limit(0)
    assert statistics.outliers(none, ["ch"]).count() == statistics.standardised(none, ["ch"]).count() == moments.shrunk_to_diagonal(none).count() == 0


def test_outliers_of_six_rounds(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    x[::10] *= 8
    bad = np.zeros(len(x), bool)
    for _ in range(6):
        good = x[~bad]
        bad |= x > np.median(good) + 2.0 * np.sqrt(np.mean((good - np.median(good)) ** 2))
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "ch string, epoch long, x double")
    found = {r["epoch"]: r["bad"] for r in statistics.outliers(rows, ["ch"], 2.0, 6).collect()}
    assert [found[i] for i in range(len(x))] == bad.tolist() and bad.any()


def test_one_long_series_ends_soon(spark):
    rows = spark.range(100_000).select(F.lit("a").alias("k"), F.col("id").alias("at"), (F.col("id") % 1000 == 0).alias("r"))
    began = time.time()
    found = windows.next_match(rows, "k", "at", F.col("at") % 2 == 1, F.col("r"))
    assert found.agg(F.count("next_at")).first()[0] == 49_500
    assert windows.nearest_match(rows, "k", "at", ~F.col("r"), F.col("r")).agg(F.count("nearest_at")).first()[0] == 99_900
    assert time.time() - began < 60


def test_squeeze_refuses_what_is_wide(spark):
    with pytest.raises(ValueError):
        cells.squeezed(spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, 1.0)], CUBE), ["ch"])


def test_record_fields(spark):
    rows = spark.createDataFrame([(1, (("x", 2),))], "id int, who struct<user:struct<name:string,n:int>>")
    assert records.has_field(rows, "who.user") and not records.has_field(rows, "who.age")
    assert records.leaves(rows.schema) == ["id", "who.user.name", "who.user.n"]
    assert records.set_field(rows, "who.user.n", F.lit(5)).select("who.user.n").first()[0] == 5


def test_made_cubes_repeat(spark):
    one, two = (toy_cube(spark, 2, 5, 3, noise(7)) for _ in range(2))
    assert one.exceptAll(two).count() == 0 and one.count() == 30
    assert one.agg(F.max(F.abs("x"))).first()[0] <= 1


def test_ties_are_decided(spark):
    rows = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (2, "b", None)], "i int, sub_problem string, y double")
    assert [tuple(r) for r in decisions.labelled(rows, ["i"]).collect()] == [(1, "a")]


def test_filter_bank_groups_cells_once(spark):
    # Coefficients and cells are made row by row, so no task holds groups of every cell of every band.
    from pyspark.sql import functions as F

    from spectrafold.functions import fourier

    cube = spark.createDataFrame([("a", t, float(t * t % 7)) for t in range(8)] + [("b", 0, None)], "ch string, time int, x double")
    found = fourier.filter_bank(cube, "time", 8, {"all": F.lit(1.0), "mean": F.when(F.col("k") == 0, 1.0).otherwise(0.0)})
    cells = {(r["ch"], r["band"], r["time"]): r["x"] for r in found.collect()}
    mean = sum(t * t % 7 for t in range(8)) / 8
    assert all(abs(cells["a", "all", t] - t * t % 7) < 1e-9 and abs(cells["a", "mean", t] - mean) < 1e-9 and cells["b", "all", t] is None for t in range(8)) and len(cells) == 32
    assert found.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
