"""Spectra of series: windows are arrays, transformed by numpy in Arrow batches."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.operators.statistics import met


def welch(cube: DataFrame, along: str, fs: float, width: int, overlap: float = 0.5) -> DataFrame:
    """Mean power over windows, Hamming taper, line removed from each; 2 * |fft|^2 by the taper's weight. Adds freq for the dimension.

    Cells are dealt by window, so a group is one window of a series, however long that is. A series shorter than a window is
    padded with zeros; gaps count as zero, also those of whole windows; cells of no time are left out.
    """
    keep = [c for c in cube.columns if c not in (along, "x")]
    step = max(1, round(width * (1 - overlap)))
    timed = cube.where(F.col(along).isNotNull()).withColumn("_t", F.col(along).cast("long"))
    spans = timed.groupBy(*keep).agg(F.min("_t").alias("_lo"), F.floor(F.greatest(F.lit(0), F.max("_t") - F.min("_t") + 1 - width) / step).alias("_last"))
    at = F.col("_t") - F.col("_lo")
    first, last = F.greatest(F.lit(0), F.ceil((at - (width - 1)) / step)), F.least(F.col("_last"), F.floor(at / step))
    cells = met(timed, spans, keep).where(first <= last).withColumn("_w", F.explode(F.sequence(first, last)))
    packed = cells.groupBy(*keep, "_w").agg(F.collect_list(F.struct((at - F.col("_w") * step).cast("int").alias("t"), F.coalesce("x", F.lit(0.0)).alias("x"))).alias("cells"), F.first("_last").alias("_last"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in packed.select(*keep).schema) + "_last long, power array<double>"
    taper = np.hamming(width)
    trend = np.vstack([np.ones(width), np.arange(width)]).T
    remove = np.eye(width) - trend @ np.linalg.pinv(trend)
    n, each = len(keep), max(1, (1 << 20) // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, each):
                batch = whole.slice(lo, each)
                lists = batch.column(n + 1)
                of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                t, x = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
                parts = np.zeros((batch.num_rows, width))
                parts[of, t] = x
                power = 2 * np.abs(np.fft.rfft(parts @ remove.T * taper)) ** 2 / (taper**2).sum()
                ends = pa.array(np.arange(batch.num_rows + 1) * power.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), batch.column(n + 2), pa.ListArray.from_arrays(ends, pa.array(power.ravel()))], [*keep, "_last", "power"])

    found = packed.mapInArrow(run, schema).select(*keep, "_last", F.posexplode("power").alias("_k", "_p"))
    return found.groupBy(*keep, "_k").agg((F.sum("_p") / (F.first("_last") + 1)).alias("x")).select(*keep, (F.col("_k") * (fs / width)).alias("freq"), "x")


def coefficients_of(cube: DataFrame, along: str, length: int, orders: list[int]) -> DataFrame:
    """A row for each series: _c, the named coefficients (k, re, im) of a transform of the length; absent cells count as zero."""
    keep = [c for c in cube.columns if c not in (along, "x")]
    angle = lambda k: F.lit(-2 * np.pi * k) * F.col(along) / length
    sums = [F.struct(F.lit(k).alias("k"), F.sum(F.col("x") * F.cos(angle(k))).alias("re"), F.sum(F.col("x") * F.sin(angle(k))).alias("im")) for k in orders]
    return cube.groupBy(*keep).agg(F.array(*sums).alias("_c"))


def fourier(cube: DataFrame, along: str, length: int, orders: list[int]) -> DataFrame:
    """re and im of the named coefficients of a transform of the length; absent cells count as zero. Sums of cosines, all in the JVM."""
    keep = [c for c in cube.columns if c not in (along, "x")]
    return coefficients_of(cube, along, length, orders).select(*keep, F.inline("_c"))
