"""Recordings that a buffer server writes: a folder with header, samples and events, as sources of Spark, in batch and as streams.

    spark.dataSource.register(BufferSamples); spark.read.format("buffer_samples").load(folder)
    spark.dataSource.register(BufferEvents);  spark.readStream.format("buffer_events").load(folder)

Samples are dealt by ranges of bytes, task_bytes to a partition, over the parts that the server rolls its file into (samples,
samples1, ..). Conditions on time narrow the ranges that are read. A stream's offset is the number of whole samples, or of
bytes of whole events, that are there; so a batch that is run again gives the same rows, and what is half written comes with
the next. An empty file gives no rows; a missing header is an error. Folders are those that driver and executors share.

samples: ch, time (from 0), x. events: sample (from 0), offset, duration, type, value (text, or numbers joined by commas).
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Fixed values of the format: kinds of numbers by their code.
KINDS = ["S1", "u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8", "f4", "f8"]
NAMES = ["char", "uint8", "uint16", "uint32", "uint64", "int8", "int16", "int32", "int64", "float32", "float64"]
#: An event: kind and number of type and value, sample, offset, duration, bytes that follow.
EVENT = "IIIIiiiI"


def _local(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


@dataclass(frozen=True)
class Header:
    channels: tuple[str, ...]
    rate: float
    kind: str

    @property
    def sample_bytes(self) -> int:
        return len(self.channels) * np.dtype(self.kind).itemsize

    @property
    def order(self) -> str:
        return self.kind[0] if self.kind[0] in "<>" else "<"


def read_header(folder: str) -> Header:
    """From header.txt where it is, else from the binary header; channels without a name are numbered from 1."""
    folder, names = _local(folder), {}
    text, binary = f"{folder}/header.txt", f"{folder}/header"
    if os.path.exists(text) and os.path.getsize(text):
        known = {}
        with open(text, encoding="latin-1") as source:
            for line in source.read().splitlines():
                if line.count("=") == 1:
                    key, value = line.split("=")
                    known[key.strip()] = value.strip()
                elif m := re.match(r"\s*(\d+)\s*:(.*)", line):
                    names[int(m[1])] = m[2].strip()
        count, rate = int(known["nChans"]), float(known.get("fSample", 1))
        kind = (">" if known.get("endian") == "big" else "<") + KINDS[NAMES.index(known["dataType"])]
    else:
        with open(binary, "rb") as source:
            raw = source.read()
        count, _, _, rate, code, _ = struct.unpack_from("<IIIfII", raw)
        kind, at = "<" + KINDS[code], 24
        while at + 8 <= len(raw):
            what, size = struct.unpack_from("<II", raw, at)
            if what == 1:
                names = dict(enumerate((n.decode("latin-1") for n in raw[at + 8 : at + 8 + size].split(b"\0")), 1))
            at += 8 + size
    return Header(tuple(names.get(k) or str(k) for k in range(1, count + 1)), rate, kind)


def _parts(folder: str) -> list[tuple[str, int]]:
    """The files that samples are rolled into, in order, and their sizes."""
    found, k = [], 0
    while os.path.exists(path := f"{_local(folder)}/samples{k or ''}"):
        found.append((path, os.path.getsize(path)))
        k += 1
    return found


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


def _samples(folder: str, head: Header, first: int, last: int) -> Iterator[pa.RecordBatch]:
    """Samples first to last - 1, whichever files they lie in."""
    width, channels = head.sample_bytes, len(head.channels)
    lo, hi, at, raw = first * width, last * width, 0, []
    for path, size in _parts(folder):
        if at < hi and at + size > lo:
            with open(path, "rb") as source:
                source.seek(max(lo - at, 0))
                raw.append(source.read(min(hi, at + size) - max(lo, at)))
        at += size
    values = np.frombuffer(b"".join(raw), head.kind)
    values = values[: len(values) // channels * channels].reshape(-1, channels)
    for k in range(0, len(values), 1 << 14):
        some = values[k : k + (1 << 14)]
        n = len(some)
        names = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(channels, dtype=np.int32), n)), pa.array(head.channels)).cast(pa.string())
        time = np.repeat(np.arange(first + k, first + k + n), channels)
        x = some.view("u1") if head.kind.endswith("S1") else some
        yield pa.RecordBatch.from_arrays([names, pa.array(time), pa.array(x.astype(float).ravel())], ["ch", "time", "x"])


class _SampleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.task_bytes = options["path"], int(options.get("task_bytes", 64 << 20))
        self.head, self.lo, self.hi = read_header(self.folder), 0, None

    def pushFilters(self, filters):
        """Conditions on time become a range of samples; all others are left to Spark."""
        for f in filters:
            bound = {GreaterThanOrEqual: (0, None), GreaterThan: (1, None), LessThan: (None, 0), LessThanOrEqual: (None, 1), EqualTo: (0, 1)}.get(type(f))
            if bound is None or f.attribute != ("time",) or not isinstance(f.value, int):
                yield f
                continue
            if bound[0] is not None:
                self.lo = max(self.lo, f.value + bound[0])
            if bound[1] is not None:
                self.hi = min(f.value + bound[1], f.value + bound[1] if self.hi is None else self.hi)

    def partitions(self):
        there = sum(size for _, size in _parts(self.folder)) // self.head.sample_bytes
        last, each = there if self.hi is None else min(there, self.hi), max(1, self.task_bytes // self.head.sample_bytes)
        return [Range(k, min(k + each, last)) for k in range(self.lo, last, each)] or [Range(0, 0)]

    def read(self, partition):
        return _samples(self.folder, self.head, partition.first, partition.last)


class _SampleStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.task_bytes = options["path"], int(options.get("task_bytes", 64 << 20))
        self.head = read_header(self.folder)

    def initialOffset(self):
        return {"samples": 0}

    def latestOffset(self):
        return {"samples": sum(size for _, size in _parts(self.folder)) // self.head.sample_bytes}

    def partitions(self, start, end):
        each = max(1, self.task_bytes // self.head.sample_bytes)
        return [Range(k, min(k + each, end["samples"])) for k in range(start["samples"], end["samples"], each)]

    def read(self, partition):
        return _samples(self.folder, self.head, partition.first, partition.last)


class BufferSamples(DataSource):
    @classmethod
    def name(cls):
        return "buffer_samples"

    def schema(self):
        return "ch string, time long, x double"

    def reader(self, schema):
        return _SampleReader(self.options)

    def streamReader(self, schema):
        return _SampleStream(self.options)


def _event_text(raw: bytes, code: int, count: int, order: str) -> str:
    if KINDS[code] == "S1":
        return raw[:count].decode("latin-1")
    return ",".join(str(v) for v in np.frombuffer(raw, order + KINDS[code], count).tolist())


def _events(folder: str, order: str, first: int, last: int) -> Iterator[tuple]:
    """Events that begin at bytes first to last - 1; what follows a broken one is left out."""
    size, at = struct.calcsize(order + EVENT), first
    with open(f"{_local(folder)}/events", "rb") as source:
        while at < last:
            source.seek(at)
            kind, n, value_kind, value_n, sample, offset, duration, more = struct.unpack(order + EVENT, source.read(size))
            raw, width = source.read(more), lambda code, count: np.dtype(KINDS[code]).itemsize * count
            if max(kind, value_kind) >= len(KINDS) or width(kind, n) + width(value_kind, value_n) > more:
                return
            yield sample, offset, duration, _event_text(raw, kind, n, order), _event_text(raw[width(kind, n) :], value_kind, value_n, order)
            at += size + more


def _whole_events(folder: str, order: str, first: int) -> list[int]:
    """Where events begin from a byte on, and where the last whole one ends. Only their heads are read."""
    size, found, path = struct.calcsize(order + EVENT), [first], f"{_local(folder)}/events"
    there = os.path.getsize(path) if os.path.exists(path) else 0
    if there:
        with open(path, "rb") as source:
            while found[-1] + size <= there:
                source.seek(found[-1])
                end = found[-1] + size + struct.unpack(order + EVENT, source.read(size))[-1]
                if end > there:
                    break
                found.append(end)
    return found


#: Events of a partition.
EVENTS_EACH = 10_000


def _event_ranges(starts: list[int]) -> list[Range]:
    return [Range(starts[k], starts[min(k + EVENTS_EACH, len(starts) - 1)]) for k in range(0, len(starts) - 1, EVENTS_EACH)]


class _EventReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.order = read_header(self.folder).order

    def partitions(self):
        return _event_ranges(_whole_events(self.folder, self.order, 0)) or [Range(0, 0)]

    def read(self, partition):
        return _events(self.folder, self.order, partition.first, partition.last) if partition.last else iter(())


class _EventStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.order = read_header(self.folder).order
        self.seen = [0]

    def initialOffset(self):
        return {"bytes": 0}

    def latestOffset(self):
        # From where the last look ended.
        self.seen = _whole_events(self.folder, self.order, self.seen[-1])
        return {"bytes": self.seen[-1]}

    def partitions(self, start, end):
        return _event_ranges([b for b in _whole_events(self.folder, self.order, start["bytes"]) if b <= end["bytes"]])

    def read(self, partition):
        return _events(self.folder, self.order, partition.first, partition.last)


class BufferEvents(DataSource):
    @classmethod
    def name(cls):
        return "buffer_events"

    def schema(self):
        return "sample long, offset long, duration long, type string, value string"

    def reader(self, schema):
        return _EventReader(self.options)

    def streamReader(self, schema):
        return _EventStream(self.options)
