"""Buffer recordings: batch and stream against what was written, narrowed ranges, half-written ends, events of all kinds."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.sources import buffers


def _event(order, sample, kind, value, duration=0):
    def packed(v):
        if isinstance(v, str):
            return 0, len(v), v.encode("latin-1")
        a = np.asarray(v)
        return buffers.KINDS.index(a.dtype.str[1:]), a.size, a.astype(order + a.dtype.str[1:]).tobytes()

    (ka, na, a), (kb, nb, b) = packed(kind), packed(value)
    return struct.pack(order + buffers.EVENT, ka, na, kb, nb, sample, -3, duration, len(a) + len(b)) + a + b


def _folder(tmp_path, kind=">f4", n=1000, rolled=(300, 301)):
    x = np.random.default_rng(1).integers(-100, 100, (n, 3)).astype(kind)
    big = "big" if kind[0] == ">" else "little"
    name = buffers.NAMES[buffers.KINDS.index(kind[1:])]
    (tmp_path / "header.txt").write_text(f"version=1\nendian={big}\ndataType={name}\nfSample=250\nnSamples={n}\nnChans=3\n1:Cz\n3:Pz\n")
    raw, at = x.tobytes(), 0
    for k, size in enumerate([*rolled, n - sum(rolled)]):
        (tmp_path / f"samples{k or ''}").write_bytes(raw[at : at + size * x.itemsize * 3])
        at += size * x.itemsize * 3
    events = [_event(kind[0], 5, "stimulus", "left"), _event(kind[0], 17, "é", np.array([1, 2], "i4"), 4), _event(kind[0], 30, np.array([7], "f8"), ""), _event(kind[0], 31, "end", np.array([-1.5], "f4"))]
    (tmp_path / "events").write_bytes(b"".join(events))
    return x, events


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(buffers.BufferSamples)
    spark.dataSource.register(buffers.BufferEvents)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


EVENTS = [(5, -3, 0, "stimulus", "left"), (17, -3, 4, "é", "1,2"), (30, -3, 0, "7.0", ""), (31, -3, 0, "end", "-1.5")]


@pytest.mark.parametrize("kind", [">f4", "<i2", "<f8"])
def test_samples(source, tmp_path, kind):
    x, _ = _folder(tmp_path, kind)
    rows = source.read.format("buffer_samples").option("task_bytes", 7 * x.itemsize * 3).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == -(-1000 // 7)
    found = {(r["ch"], r["time"]): r["x"] for r in rows.collect()}
    assert found == {(c, t): float(x[t, k]) for t in range(1000) for k, c in enumerate(("Cz", "2", "Pz"))}
    some = rows.where((F.col("time") >= 295) & (F.col("time") < 310) & (F.col("ch") == "Pz"))
    # Only the parts of the range are read.
    assert some.rdd.getNumPartitions() == 3 and sorted((r["time"], r["x"]) for r in some.collect()) == [(t, float(x[t, 2])) for t in range(295, 310)]
    assert rows.where("time = 601").count() == 3 and rows.where("time > 5000").count() == 0


def test_events(source, tmp_path):
    _, events = _folder(tmp_path)
    assert sorted(map(tuple, source.read.format("buffer_events").load(str(tmp_path)).collect())) == EVENTS
    # A broken event ends the reading, a cut one isn't there yet.
    (tmp_path / "events").write_bytes(b"".join(events)[:-1])
    assert source.read.format("buffer_events").load(str(tmp_path)).count() == 3
    (tmp_path / "events").write_bytes(b"")
    assert source.read.format("buffer_events").load(str(tmp_path)).count() == 0


def test_streams_go_on_where_they_were(source, tmp_path):
    folder, state = tmp_path / "rec", str(tmp_path / "state")
    folder.mkdir()
    x, events = _folder(folder, "<i2", 400, (100,))
    late = (folder / "samples1").read_bytes()
    # Half a sample at the end, half an event.
    (folder / "samples1").write_bytes(late[:601])
    (folder / "events").write_bytes(b"".join(events[:2]) + events[2][:20])

    def go(kind, name):
        query = source.readStream.format(kind).load(str(folder)).writeStream.format("parquet").option("checkpointLocation", f"{state}/{name}").trigger(once=True).start(f"{tmp_path}/{name}")
        query.awaitTermination(60)
        return source.read.parquet(f"{tmp_path}/{name}")

    assert go("buffer_samples", "s").count() == 3 * 200 and go("buffer_events", "e").count() == 2
    (folder / "samples1").write_bytes(late)
    (folder / "events").write_bytes(b"".join(events))
    found = {(r["ch"], r["time"]): r["x"] for r in go("buffer_samples", "s").collect()}
    assert found == {(c, t): float(x[t, k]) for t in range(400) for k, c in enumerate(("Cz", "2", "Pz"))}
    assert sorted(map(tuple, go("buffer_events", "e").collect())) == EVENTS


def test_binary_header(source, tmp_path):
    names = b"A\0B\0"
    (tmp_path / "header").write_bytes(struct.pack("<IIIfII", 2, 3, 0, 100.0, 9, 8 + len(names)) + struct.pack("<II", 1, len(names)) + names)
    (tmp_path / "samples").write_bytes(np.arange(6, dtype="<f4").tobytes())
    rows = source.read.format("buffer_samples").load(str(tmp_path)).collect()
    assert sorted((r["time"], r["ch"], r["x"]) for r in rows) == [(t, c, float(2 * t + k)) for t in range(3) for k, c in enumerate("AB")]
    assert source.read.format("buffer_events").load(str(tmp_path)).count() == 0
