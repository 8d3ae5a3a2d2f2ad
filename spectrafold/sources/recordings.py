"""Recordings in the European data formats (EDF of 16 bits, BDF of 24), caps of electrode positions, and cubes kept by key.

A recording is read by ranges of its data records: the driver reads the header, each task its bytes, so a file of any size is
dealt over the cluster. Paths are those that driver and executors share.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that one task reads, about.
TASK_BYTES = 64 << 20
NOTES = ("EDF Annotations", "BDF Annotations")
_NOTE = re.compile(rb"([+-]\d+(?:\.\d*)?)(?:\x15(\d+(?:\.\d*)?))?\x14((?:[^\x00\x14]*\x14)*)\x00")


def _open(path: str):
    if re.match(r"file:|/", path):
        return open(re.sub(r"^file:/*", "/", path), "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


@dataclass(frozen=True)
class Header:
    size: int
    width: int
    records: int
    seconds: float
    labels: tuple[str, ...]
    low: tuple[float, ...]
    gain: tuple[float, ...]
    digital: tuple[float, ...]
    samples: tuple[int, ...]

    @property
    def record_bytes(self) -> int:
        return self.width * sum(self.samples)


def read_header(path: str) -> Header:
    with _open(path) as source:
        fixed = source.read(256)
        n = int(fixed[252:256])
        rest = source.read(256 * n)
        source.seek(0, 2)
        whole = source.tell()
    at = 0

    def column(width: int) -> list[str]:
        nonlocal at
        found = [rest[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)]
        at += n * width
        return found

    labels, _, _, low, high, dlow, dhigh, _, samples = (column(w) for w in (16, 80, 8, 8, 8, 8, 8, 80, 8))
    low, high, dlow, dhigh = ([float(v) for v in c] for c in (low, high, dlow, dhigh))
    gain = tuple((h - lo) / (dh - dl) if dh != dl else 1.0 for lo, h, dl, dh in zip(low, high, dlow, dhigh))
    head = Header(int(fixed[184:192]), 3 if fixed[:1] == b"\xff" else 2, int(fixed[236:244]), float(fixed[244:252]), tuple(labels), tuple(low), gain, tuple(dlow), tuple(map(int, samples)))
    # A recording that was cut off does not say how many records it has.
    return head if head.records >= 0 else Header(**{**head.__dict__, "records": (whole - head.size) // head.record_bytes})


def _numbers(raw: np.ndarray, width: int) -> np.ndarray:
    if width == 2:
        return raw.reshape(-1, 2).copy().view("<i2").ravel().astype(np.int64)
    b = raw.reshape(-1, 3).astype(np.int64)
    value = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
    return value - ((value & 0x800000) << 1)


def _ranges(spark: SparkSession, head: Header) -> tuple[DataFrame, int]:
    each = max(1, TASK_BYTES // max(1, head.record_bytes))
    parts = max(1, -(-head.records // each))
    return spark.range(0, parts, 1, parts), each


def _blocks(path: str, head: Header, each: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """First record and bytes, one row a record, of each range."""
    for batch in batches:
        for part in batch.column(0).to_pylist():
            first = part * each
            count = min(each, head.records - first)
            if count > 0:
                with _open(path) as source:
                    source.seek(head.size + first * head.record_bytes)
                    raw = np.frombuffer(source.read(count * head.record_bytes), np.uint8)
                yield first, raw[: len(raw) // head.record_bytes * head.record_bytes].reshape(-1, head.record_bytes)


def read_samples(spark: SparkSession, path: str, digital: bool = False, channels: list[str] | None = None) -> DataFrame:
    """ch, time (sample of the channel, from 0), seconds, x: physical values, or the recorded numbers; annotations are left out.

    Columns of chosen channels alone are decoded. A last record that is cut short is left out.
    """
    head = read_header(path)
    ranges, each = _ranges(spark, head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.append(0, np.cumsum(head.samples)) * head.width
        for first, raw in _blocks(path, head, each, batches):
            for k, label in enumerate(head.labels):
                if label in NOTES or channels is not None and label not in channels or not head.samples[k]:
                    continue
                numbers = _numbers(np.ascontiguousarray(raw[:, edge[k] : edge[k + 1]]).ravel(), head.width)
                x = numbers.astype(float) if digital else (numbers - head.digital[k]) * head.gain[k] + head.low[k]
                time = first * head.samples[k] + np.arange(len(x))
                names = pa.DictionaryArray.from_arrays(np.zeros(len(x), np.int32), [label]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(time), pa.array(time * (head.seconds / head.samples[k])), pa.array(x)], ["ch", "time", "seconds", "x"])

    return ranges.mapInArrow(run, "ch string, time long, seconds double, x double")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """onset, duration (seconds; null if none is said), text: of the annotation channels; the marks that only keep time are left out."""
    head = read_header(path)
    ranges, each = _ranges(spark, head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.append(0, np.cumsum(head.samples)) * head.width
        for _, raw in _blocks(path, head, each, batches):
            found = []
            for k, label in enumerate(head.labels):
                if label in NOTES:
                    for row in raw[:, edge[k] : edge[k + 1]]:
                        for onset, duration, texts in _NOTE.findall(row.tobytes()):
                            found += [(float(onset), float(duration) if duration else None, t.decode("utf-8", "replace")) for t in texts.split(b"\x14") if t]
            columns = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.float64(), pa.string()))], ["onset", "duration", "text"])

    return ranges.mapInArrow(run, "onset double, duration double, text string")


def decode_status(number: Column) -> list[Column]:
    """status (the low 16 bits), epoch, in_range and low_battery of a status channel's numbers of 24 bits."""
    bits = number.cast("long").bitwiseAND(F.lit((1 << 24) - 1))
    flag = lambda k, name: (F.shiftright(bits, k).bitwiseAND(F.lit(1)) == 1).alias(name)
    return [bits.bitwiseAND(F.lit(0xFFFF)).alias("status"), flag(16, "epoch"), flag(20, "in_range"), flag(22, "low_battery")]


def status_events(status: DataFrame) -> DataFrame:
    """sample, value where the status changes to another value than 0. status: time, status.

    One task sorts a whole recording's status channel: one number a sample.
    """
    before = F.lag("status", 1, 0).over(Window.partitionBy(F.lit(0)).orderBy("time"))
    return status.withColumn("_b", before).where("status <> _b AND status <> 0").select(F.col("time").alias("sample"), F.col("status").alias("value"))


def read_cap(spark: SparkSession, path: str) -> DataFrame:
    """ch, lat, long (radians) of a cap's text file: name, latitude, longitude; name, x, y where `xy` is in the file's name.

    Degrees are known by values above two pi. A cap has a few hundred rows at most.
    """
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.get(part, 0).alias("ch"), F.get(part, 1).cast("double").alias("a"), F.get(part, 2).cast("double").alias("b"))
    if "xy" in path.rsplit("/", 1)[-1]:
        return rows.select("ch", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("lat"), F.atan2("b", "a").alias("long"))
    most = rows.agg(F.max(F.greatest(F.abs("a"), F.abs("b")))).first()[0] or 0.0
    scale = pi / 180 if most > 2 * pi else 1.0
    return rows.select("ch", (F.col("a") * scale).alias("lat"), (F.col("b") * scale).alias("long"))


KEY = ("expt", "subj", "session", "label")


def save_cube(cube: DataFrame, root: str, **key: str) -> None:
    """Keeps a cube under its experiment, subject, session and label; what was kept under that key is replaced."""
    path = "/".join([root.rstrip("/"), *(f"{k}={key[k]}" for k in KEY)])
    cube.write.mode("overwrite").parquet(path)


def load_cube(spark: SparkSession, root: str, **key: str) -> DataFrame:
    """All cubes that agree with the parts of the key that are given; the others are columns. Only their files are read."""
    found = spark.read.option("basePath", root).parquet(root)
    for k, v in key.items():
        found = found.where(F.col(k).cast("string") == v)
    return found.drop(*key)
