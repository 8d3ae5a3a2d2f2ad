"""Recordings written byte by byte and read back; caps; cubes by key; filters in batch and on a stream."""

import math

import numpy as np
from pyspark.sql import functions as F

from spectrafold.sources import recordings
from spectrafold.streaming import filters


def _write(path, data, labels, width, spr, notes=None, said=None):
    """data: [signals, samples] of whole numbers; notes: bytes of each record's annotations."""
    n, records = len(labels) + bool(notes), data.shape[1] // spr
    names = [*labels, *(["EDF Annotations"] if notes else [])]
    samples = [spr] * len(labels) + ([len(notes[0]) // width] if notes else [])
    pad = lambda v, w: str(v).encode().ljust(w)
    version = b"\xffBIOSEMI" if width == 3 else b"0".ljust(8)
    head = version + b" " * 160 + b" " * 16 + pad(256 * (n + 1), 8) + b" " * 44 + pad(records if said is None else said, 8) + pad(1, 8) + pad(n, 4)
    edge = 2 ** (8 * width - 1)
    for values, w in ((names, 16), ([""] * n, 80), (["uV"] * n, 8), ([-100] * n, 8), ([100] * n, 8), ([-edge] * n, 8), ([edge - 1] * n, 8), ([""] * n, 80), (samples, 8), ([""] * n, 32)):
        head += b"".join(pad(v, w) for v in values)
    body = b""
    for r in range(records):
        for row in data:
            body += b"".join(int(v).to_bytes(width, "little", signed=True) for v in row[r * spr : (r + 1) * spr])
        body += notes[r] if notes else b""
    path.write_bytes(head + body)


def test_both_widths(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recordings, "TASK_BYTES", 100)
    rng = np.random.default_rng(3)
    for width in (2, 3):
        edge = 2 ** (8 * width - 1)
        data = rng.integers(-edge, edge, (3, 40))
        path = tmp_path / f"r{width}"
        _write(path, data, ["A", "B", "Status"], width, 8, said=-1)
        raw = recordings.read_samples(spark, str(path), digital=True)
        assert raw.rdd.getNumPartitions() > 1
        found = {(r["ch"], r["time"]): r["x"] for r in raw.collect()}
        assert found == {(ch, t): float(data[k, t]) for k, ch in enumerate(["A", "B", "Status"]) for t in range(40)}
        scaled = {r["time"]: r for r in recordings.read_samples(spark, str(path), channels=["B"]).collect()}
        assert len(scaled) == 40 and all(math.isclose(scaled[t]["x"], (data[1, t] + edge) * 200 / (2 * edge - 1) - 100, abs_tol=1e-9) and scaled[t]["seconds"] == t / 8 for t in range(40))


def test_status_and_annotations(spark, tmp_path):
    status = [0, 5 | 1 << 16, 5, 0, 7 | 1 << 22, 7, 9, 0]
    _write(tmp_path / "s", np.array([status]), ["Status"], 3, 8)
    words = recordings.read_samples(spark, str(tmp_path / "s"), digital=True).select("time", *recordings.decode_status(F.col("x")))
    rows = words.orderBy("time").collect()
    assert [r["status"] for r in rows] == [0, 5, 5, 0, 7, 7, 9, 0] and rows[1]["epoch"] and rows[4]["low_battery"] and not rows[2]["epoch"]
    assert sorted(map(tuple, recordings.status_events(words).collect())) == [(1, 5), (4, 7), (6, 9)]
    notes = [b"+0\x14\x14\x00+0.5\x151.5\x14left\x14foot\x14\x00".ljust(40, b"\0"), b"+1\x14\x14\x00+1.25\x14r\xc3\xbc\x14\x00".ljust(40, b"\0")]
    _write(tmp_path / "n", np.zeros((1, 16), int), ["A"], 2, 8, notes)
    found = recordings.read_annotations(spark, str(tmp_path / "n"))
    assert sorted(map(tuple, found.collect())) == [(0.5, 1.5, "foot"), (0.5, 1.5, "left"), (1.25, None, "rü")]
    assert recordings.read_samples(spark, str(tmp_path / "n")).select("ch").distinct().collect() == [("A",)]


def test_caps(spark, tmp_path):
    (tmp_path / "cap.txt").write_text("Cz\t0\t0\nFpz 90 90\n\n")
    found = {r["ch"]: (r["lat"], r["long"]) for r in recordings.read_cap(spark, str(tmp_path / "cap.txt")).collect()}
    assert found == {"Cz": (0.0, 0.0), "Fpz": (math.pi / 2, math.pi / 2)}


def test_cubes_by_key(spark, tmp_path):
    root = str(tmp_path / "store")
    for subj in ("s1", "s2"):
        recordings.save_cube(spark.createDataFrame([("a", 1, subj)], "ch string, time int, who string"), root, expt="e", subj=subj, session="x", label="raw")
    assert recordings.load_cube(spark, root, subj="s2", label="raw").select("who").collect() == [("s2",)]
    assert recordings.load_cube(spark, root, expt="e").count() == 2


def test_filters_in_batch_and_on_a_stream(spark, tmp_path):
    rng = np.random.default_rng(5)
    xs = rng.normal(size=60).cumsum()
    a = math.exp(math.log(0.5) / 10)
    n = s = q = 0.0
    wanted = {"bias": [], "standard": [], "relative": []}
    for i, x in enumerate(xs):
        if i == 30:
            n = s = q = 0.0
        n, s, q = a * n + 1 - a, a * s + (1 - a) * x, a * q + (1 - a) * x * x
        spread = math.sqrt(abs((q - s * s / n) / n))
        wanted["bias"].append(x - s / n)
        wanted["standard"].append((x - s / n) / (spread if spread > 2**-52 else 1) if n > 0.75 else x)
        wanted["relative"].append(x / math.sqrt(q / n))
    rows = spark.createDataFrame([("k", i, float(x), i == 30) for i, x in enumerate(xs)], "key string, at long, x double, fresh boolean")
    for name, values in wanted.items():
        found = [r["x"] for r in filters.filtered(rows, "key", "at", getattr(filters, name)(10), "fresh").orderBy("at").collect()]
        assert np.allclose(found, values)
    median = [r["x"] for r in filters.filtered(rows, "key", "at", filters.percentile(5)).orderBy("at").collect()]
    assert np.allclose(median, [x - sorted(xs[max(0, i - 4) : i + 1])[math.ceil(0.5 * min(5, i + 1)) - 1] for i, x in enumerate(xs)])
    steady = spark.createDataFrame([("k", i, 4.0) for i in range(400)], "key string, at long, x double")
    assert abs(filters.filtered(steady, "key", "at", filters.robust_bias(20)).orderBy(F.col("at").desc()).first()["x"]) < 0.1
    gaps = spark.createDataFrame([("k", 0, 1.0), ("k", 1, None), (None, 2, 1.0)], "key string, at long, x double")
    assert filters.filtered(gaps, "key", "at", filters.bias(0.5)).count() == 3
    source = tmp_path / "in"
    rows.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(rows.schema).parquet(str(source))
    done = filters.filtered(stream, "key", "at", filters.standard(10), "fresh").writeStream.format("memory").queryName("standard").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert np.allclose([r["x"] for r in spark.table("standard").orderBy("at").collect()], wanted["standard"])
