"""Transforms of long series in two passes: columns, twiddles, rows.

A series of length n = p q is a table of p rows and q columns. Its columns are transformed, each value is turned by its
twiddle, and the rows are transformed: two shuffles, and no group holds more than the larger factor. Where n has no factors
near its root, the transform is a convolution with a chirp, made by transforms of the next power of two.

Cells are at 0 to length - 1; those elsewhere are left out, absent and null ones count as 0, and several at one place add up.
A null key is one series; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group's values, at most; a length with a larger factor goes by chirps.
GROUP = 1 << 16
#: Values that a task turns at a time.
AT_ONCE = 1 << 20


def factors(length: int) -> tuple[int, int]:
    """The divisors nearest the root."""
    p = next(k for k in range(isqrt(length), 0, -1) if length % k == 0)
    return p, length // p


def _pass(rows: DataFrame, keep: list[str], by: str, at: str, size: int, name: str, whole: int) -> DataFrame:
    """keep, by, name, re, im: each group's values at 0 to size - 1, transformed; turned by twiddles if whole is not 0."""
    packed = rows.groupBy(*keep, by).agg(F.collect_list(F.struct(F.col(at).cast("int").alias("at"), "re", "im")).alias("cells"))
    n = len(keep)
    heads = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keep, by).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, AT_ONCE // size)
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, step):
                batch = whole_batch.slice(lo, step)
                lists = batch.column(n + 1)
                of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                place, re, im = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
                z = np.zeros((batch.num_rows, size), complex)
                np.add.at(z, (of, place), np.nan_to_num(re) + 1j * np.nan_to_num(im))
                z = np.fft.fft(z, axis=1)
                if whole:
                    turns = np.outer(batch.column(n).to_numpy().astype(np.int64), np.arange(size)) % whole
                    z *= np.exp(-2j * pi * turns / whole)
                ends = pa.array(np.arange(batch.num_rows + 1) * size, pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n + 1)), pa.ListArray.from_arrays(ends, pa.array(z.real.ravel())), pa.ListArray.from_arrays(ends, pa.array(z.imag.ravel()))], [*keep, by, "re", "im"])

    turned = packed.mapInArrow(run, f"{heads}, re array<double>, im array<double>")
    return turned.select(*keep, by, F.posexplode(F.arrays_zip("re", "im")).alias(name, "_z")).select(*keep, by, name, F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def _complex(cube: DataFrame, along: str, length: int) -> DataFrame:
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (("re", "im") if "re" in cube.columns else ("x",))]
    keep = [c for c in cube.columns if c not in (along, "x", "re", "im")]
    return cube.where(F.col(along).between(0, length - 1)).select(*keep, F.col(along).cast("long").alias("_t"), parts[0].alias("re"), (parts[1] if len(parts) > 1 else F.lit(0.0)).alias("im"))


def transform(cube: DataFrame, along: str, length: int, group: int = GROUP) -> DataFrame:
    """k, re, im: all coefficients of each series of x, or of re and im."""
    cells = _complex(cube, along, length)
    keep = [c for c in cells.columns if c not in ("_t", "re", "im")]
    p, q = factors(length)
    if q > group:
        return _by_chirps(cells, keep, length, group)
    columns = _pass(cells.withColumns({"_r": F.floor(F.col("_t") / q), "_c": F.col("_t") % q}), keep, "_c", "_r", p, "_k", length)
    rows = _pass(columns, keep, "_k", "_c", q, "_m", 0)
    return rows.select(*keep, (F.col("_k") + F.lit(p).cast("long") * F.col("_m")).alias("k"), "re", "im")


def _turned(rows: DataFrame, re: Column, im: Column) -> DataFrame:
    """re, im times another complex number."""
    return rows.withColumn("_w", F.struct(re.alias("re"), im.alias("im"))).withColumns({"re": F.col("re") * F.col("_w.re") - F.col("im") * F.col("_w.im"), "im": F.col("re") * F.col("_w.im") + F.col("im") * F.col("_w.re")}).drop("_w")


def _by_chirps(cells: DataFrame, keep: list[str], length: int, group: int) -> DataFrame:
    room = 1 << (2 * length - 1).bit_length()
    # A chirp's angle is pi t^2 / n; the square is taken by its remainder, so angles stay exact.
    angle = lambda t: pi * ((t * t) % (2 * length)) / length
    t, k = F.col("_t"), F.col("k")
    series = transform(_turned(cells, F.cos(angle(t)), -F.sin(angle(t))), "_t", room, group)
    lag = F.when(F.col("id") < length, F.col("id")).otherwise(F.col("id") - (2 * length - 1))
    chirp = cells.sparkSession.range(2 * length - 1).select(F.pmod(lag, F.lit(room)).alias("_t"), F.cos(angle(lag)).alias("re"), F.sin(angle(lag)).alias("im"))
    other = transform(chirp, "_t", room, group).select("k", F.col("re").alias("_re"), F.col("im").alias("_im"))
    product = _turned(series.join(other, "k"), F.col("_re"), F.col("_im")).drop("_re", "_im")
    back = inverse(product, "k", room, group).where(F.col("k") < length)
    return _turned(back, F.cos(angle(k)), -F.sin(angle(k))).select(*keep, "k", "re", "im")


def inverse(coefficients: DataFrame, along: str, length: int, group: int = GROUP) -> DataFrame:
    """along, re, im: the series of coefficients k, re, im."""
    found = transform(coefficients.withColumnRenamed("k", "_k0").withColumn("im", -F.col("im")), "_k0", length, group)
    return found.withColumnRenamed("k", along).withColumns({"re": F.col("re") / length, "im": -F.col("im") / length})


def filtered(cube: DataFrame, along: str, length: int, gain: Column, group: int = GROUP) -> DataFrame:
    """Each real series with its coefficients times a gain of k, 0 to length / 2; mirror images have their twin's."""
    found = transform(cube, along, length, group).withColumn("_of", F.col("k")).withColumn("k", F.least(F.col("k"), length - F.col("k")))
    scaled = found.withColumns({"re": F.col("re") * gain, "im": F.col("im") * gain}).drop("k").withColumnRenamed("_of", "k")
    return inverse(scaled, along, length, group).drop("im").withColumnRenamed("re", "x")
