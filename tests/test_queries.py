"""Every query with SQL gives DuckDB's rows; the others are held against numpy or a plain loop."""

import math

import duckdb
import numpy as np
import pytest

from spectrafold.functions.spectra import welch
from spectrafold.functions.scores import agreement, binary_losses
from spectrafold.operators import records, restructure, spatial, windows
from spectrafold.queries import ORACLES, QUERIES
from spectrafold.streaming.filters import bias_filtered

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "labels", "conversations", "orders"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, f"{x:.3f}" if isinstance(x, float) else str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = _sorted(tuple(r) for r in df.select(*columns).collect())
    sql = tables.sql(ORACLES[name])
    at = [sql.columns.index(c) for c in columns]
    wanted = _sorted(tuple(r[i] for i in at) for r in sql.fetchall())
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert all(math.isclose(p, q, abs_tol=2e-5) if isinstance(p, float) and q is not None else p == q for p, q in zip(a, b)), (a, b)


def test_welch_against_numpy(spark):
    x = np.sin(np.arange(40) * 0.7)
    cube = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "ch string, time long, x double")
    found = [r["x"] for r in welch(cube, "time", 10.0, 16).orderBy("freq").collect()]
    taper, trend = np.hamming(16), np.vstack([np.ones(16), np.arange(16)]).T
    parts = []
    for s in range(0, 25, 8):
        w = x[s : s + 16]
        w = w - trend @ np.linalg.lstsq(trend, w, rcond=None)[0]
        parts.append(2 * np.abs(np.fft.rfft(w * taper)) ** 2 / (taper**2).sum())
    assert np.allclose(found, np.mean(parts, axis=0))


def test_runs_drop_what_is_left(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate("aaabbbba")], "k int, i int, v string")
    found = sorted((r["i"], r["run"], r["seq"], r["at"]) for r in restructure.split_runs(rows, ["k"], ["i"], "v", 2).collect())
    assert found == [(0, 1, 0, 0), (1, 1, 0, 1), (3, 2, 0, 0), (4, 2, 0, 1), (5, 2, 1, 0), (6, 2, 1, 1)]


def test_nearest_takes_the_lower_of_two(spark):
    cube = spark.createDataFrame([(1, 0.0), (3, 0.0), (9, 0.0)], "t int, x double")
    assert sorted(r["t"] for r in restructure.retain_nearest(cube, "t", [2, 8]).collect()) == [1, 9]


def test_moving_average_of_few(spark):
    cube = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 9.0)], "ch string, time int, x double")
    assert [r["x"] for r in windows.moving_average(cube, "time", 2).orderBy("time").collect()] == [2.0, 3.0, 6.5]


def test_streaming_bias_filter(spark, tmp_path):
    rows = [("a", i, float(i % 5)) for i in range(20)] + [("b", i, 1.0) for i in range(20)]
    spark.createDataFrame(rows, "ch string, t int, x double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ch string, t int, x double").parquet(str(tmp_path / "in"))
    q = bias_filtered(stream, "ch", "t", 0.9).writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    found = {(r["ch"], r["t"]): r["x"] for r in spark.table("filtered").collect()}
    n = s = 0.0
    for i in range(20):
        n, s = 0.9 * n + 0.1, 0.9 * s + 0.1 * (i % 5)
        assert found["a", i] == pytest.approx(i % 5 - s / n)
    assert all(abs(found["b", i]) < 1e-9 for i in range(20))


def _vectors(spark, n=60, d=4):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=n) > 0, 1.0, -1.0)
    rows = [(i, v.tolist(), float(t), i % 3) for i, (v, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame([*rows, (n, None, 1.0, 0), (n + 1, [1.0], 1.0, 1), (n + 2, [0.0] * d, 1.0, None)], "vec_id long, v array<double>, y double, fold long")


def test_second_moments_and_whitening_against_numpy(spark):
    x, _, rows = _vectors(spark)
    sums = spatial.second_moments(rows, "fold", "v", 4)
    assert sorted(sums) == [0, 1, 2]
    assert all(np.allclose(sums[f], x[f::3].T @ x[f::3]) for f in range(3))
    w = spatial.whitener(sum(sums.values()) / len(x))
    out = rows.where("vec_id < 60").orderBy("vec_id").select(spatial.project("v", w).alias("v")).collect()
    white = np.array([r["v"] for r in out])
    assert np.allclose(white, x @ w) and np.allclose(white.T @ white / len(x), np.eye(4))


def test_common_patterns_share_out_the_variance(spark):
    x, y, _ = _vectors(spark)
    a, b = (x[y == s].T @ x[y == s] for s in (1, -1))
    w = spatial.common_patterns(a, b, 1)
    assert np.allclose(w.T @ (a + b) @ w, np.eye(2))


def test_ridge_folds_against_numpy(spark):
    x, y, rows = _vectors(spark)
    rows = rows.where("vec_id < 60")
    weights = spatial.ridge_folds(rows, "fold", "v", "y", 4, 0.5)
    full = np.hstack([x, np.ones((len(x), 1))])
    dv = {r["vec_id"]: r["dv"] for r in spatial.decision_values(rows, "fold", "v", weights).collect()}
    for f in range(3):
        train = np.arange(len(x)) % 3 != f
        w = np.linalg.solve(full[train].T @ full[train] + np.diag([0.5] * 4 + [0.0]), full[train].T @ y[train])
        assert np.allclose(weights[f], w)
        assert all(math.isclose(dv[i], full[i] @ w, abs_tol=1e-9) for i in np.flatnonzero(~train))
    assert np.mean([(dv[i] > 0) == (y[i] > 0) for i in range(len(x))]) > 0.8


def test_records_match_and_negate(spark):
    rows = spark.createDataFrame([(1, ("hello", 1)), (2, ("say hello", None)), (3, (None, 3)), (4, None)], "id int, a struct<b:string,c:int>")
    ids = lambda conditions: sorted(r["id"] for r in rows.where(records.match(conditions)).collect())
    assert ids({"a.b": "#hel#"}) == [1] and ids({"~a.b": "#hel#"}) == [2, 3, 4]
    assert ids({"a.c": "*"}) == [1, 3] and ids({"a.c": [3, 4]}) == [3] and ids({"a.c": lambda c: c < 2, "a.b": "hello"}) == [1] and ids({}) == [1, 2, 3, 4]


def test_scores_of_empty_groups_are_null(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5), (2, -1, -1.0)], "g int, y int, dv double")
    found = {r["g"]: r for r in binary_losses(rows, "y", "dv", ["g"]).collect()}
    assert (found[1]["tp"], found[1]["balanced"], found[2]["recall"], found[2]["tn"]) == (1, None, None, 1)
    counts = spark.createDataFrame([(1, 1, 5)], "t int, p int, n long")
    assert [r["kappa"] for r in agreement(counts, "t", "p").collect()] == [None]


def test_interpolation_stays_within(spark):
    cube = spark.createDataFrame([("a", t, x) for t, x in enumerate([None, 1.0, None, None, 4.0, None])], "ch string, time long, x double")
    assert [r["x"] for r in windows.interpolated(cube, "time").orderBy("time").collect()] == [None, 1.0, 2.0, 3.0, 4.0, None]


def test_nearest_takes_the_earlier_of_two(spark):
    rows = spark.createDataFrame([(1, 0, "p"), (1, 5, "c"), (1, 10, "p"), (1, 8, "c"), (2, 1, "c")], "k int, at long, s string")
    found = windows.nearest_match(rows, "k", "at", windows.F.col("s") == "c", windows.F.col("s") == "p").collect()
    assert sorted((r["at"], r["nearest_at"]) for r in found) == [(1, None), (5, 0), (8, 10)]
