"""Responses to stimuli that overlap, by least squares.

A series is the sum over stimuli of their code's response, irf(code, lag) at lag samples after each, times the stimulus's
weight. The normal equations are block-Toeplitz but for stimuli whose response the series' end cuts off: sums over pairs of
stimuli at each difference of times, less what lies beyond the end. So the pairs are stimuli near each other, never samples,
and what reaches the driver is one number for each pair of codes and difference, and each pair of lags of cut-off stimuli.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.operators.statistics import met

#: Codes times lags, at most: the equations are solved as one matrix.
UNKNOWNS = 4096


def normal_equations(stimuli: DataFrame, ends: DataFrame, keys: list[str], length: int, codes: list, at: str = "time") -> np.ndarray:
    """The matrix of sums over samples of codes' weights, code by lag. ends: keys and the last sample, hi, of each series."""
    n = len(codes)
    if n * length > UNKNOWNS:
        raise ValueError(f"{n} codes and {length} lags are more than {UNKNOWNS} unknowns")
    number = {c: k for k, c in enumerate(codes)}
    own = stimuli.select(*keys, F.col(at).cast("long").alias("_t"), F.col("code"), F.col("w").cast("double").alias("w"))
    near = own.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("_u", F.col("_t") + F.col("_d"))
    other = own.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_t").alias("_u"), F.col("code").alias("_code"), F.col("w").alias("_w"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [near["_u"] == other["_u"]]
    sums = near.join(other, on).groupBy("code", "_code", "_d").agg(F.sum(F.col("w") * F.col("_w")).alias("x"))
    blocks = np.zeros((n, n, length))
    for code, later, d, x in sums.collect():
        blocks[number[code], number[later], d] = x
    # An earlier stimulus at lag i and a later one, d samples on, at lag i - d meet in one sample.
    found = np.zeros((n, length, n, length))
    lag = np.arange(length)
    for d in range(length):
        found[:, lag[d:], :, lag[: length - d]] += blocks[:, :, d]
        if d:
            found[:, lag[: length - d], :, lag[d:]] += blocks[:, :, d].T
    late = met(own, ends, keys).where(F.col("_t") + length - 1 > F.col("hi")).withColumn("_i", F.explode(F.sequence(F.greatest(F.lit(0), F.col("hi") + 1 - F.col("_t")), F.lit(length - 1))))
    beyond = late.select(*keys, "code", "w", "_i", (F.col("_t") + F.col("_i")).alias("_s"))
    twin = beyond.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_s").alias("_s2"), F.col("code").alias("_code"), F.col("w").alias("_w"), F.col("_i").alias("_j"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [beyond["_s"] == twin["_s2"]]
    for code, other_code, i, j, x in beyond.join(twin, on).groupBy("code", "_code", "_i", "_j").agg(F.sum(F.col("w") * F.col("_w"))).collect():
        found[number[code], i, number[other_code], j] -= x
    return found.reshape(n * length, n * length)


def deconvolved(cube: DataFrame, stimuli: DataFrame, keys: list[str], length: int, ridge: float = 0.0, along: str = "time") -> DataFrame:
    """code, lag, x for each of the other dimensions: the responses by which the series are explained best.

    stimuli: keys (dimensions of the cube in which a series and its stimuli go together), along, code and w. Times are whole
    numbers. All series of a channel have the same responses. Cells that are absent or null count as 0, and so does what lies
    before the first sample and after the last; stimuli of null time, code or weight, or of no series, are left out. ridge
    is added to the diagonal, by its mean; equations without one solution give the smallest. Without stimuli the result is empty.
    """
    keep = [c for c in cube.columns if c not in (*keys, along, "x")]
    spans = cube.where(F.col(along).isNotNull()).groupBy(*keys).agg(F.min(along).cast("long").alias("lo"), F.max(along).cast("long").alias("hi"))
    inside = stimuli.select(*keys, F.col(along).alias("_at"), "code", "w").dropna(subset=["_at", "code", "w"])
    # A stimulus that ends before a series begins, or begins after it, has no sample there.
    inside = met(inside, spans, keys).where((F.col("_at") >= F.col("lo")) & (F.col("_at") <= F.col("hi"))).drop("lo", "hi").groupBy(*keys, "_at", "code").agg(F.sum("w").alias("w"))
    codes = sorted(r[0] for r in inside.select("code").distinct().limit(UNKNOWNS + 1).collect())
    gram = normal_equations(inside, spans.drop("lo"), keys, length, codes, "_at")
    moved = inside.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn(along, F.col("_at") + F.col("lag")).drop("_at")
    right = met(cube.where("x IS NOT NULL"), moved, [*keys, along]).groupBy(*keep, "code", "lag").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    if not codes:
        return right
    solve = np.linalg.pinv(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), hermitian=True)
    number = {c: k for k, c in enumerate(codes)}
    packed = right.groupBy(*keep).agg(F.collect_list(F.struct("code", "lag", "x")).alias("sums"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in right.select(*keep, "code").schema)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                there = np.zeros((batch.num_rows, len(gram)))
                for row, sums in enumerate(batch.column(n).to_pylist()):
                    for s in sums:
                        there[row, number[s["code"]] * length + s["lag"]] = s["x"]
                of = pa.array(np.repeat(np.arange(batch.num_rows), len(gram)))
                code = pa.array([c for c in codes for _ in range(length)] * batch.num_rows, whole.schema.field(n).type.value_type.field("code").type)
                lag = pa.array(np.tile(np.arange(length), len(codes) * batch.num_rows), pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in range(n)), code, lag, pa.array((there @ solve).ravel())], [*keep, "code", "lag", "x"])

    return packed.mapInArrow(run, f"{kinds}lag int, x double")
