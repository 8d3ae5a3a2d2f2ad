"""Channels on a sphere: what is missing is filled in by spherical splines through the channels that are there.

Channels and their positions are few, so weights are made on the driver, or in a task for each pattern of missing channels, and
remembered. Samples stay where they are: a sample's channels are one row, and rows of one pattern are multiplied together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spline(cosine: np.ndarray, order: int = 4, terms: int = 50) -> np.ndarray:
    """The sum over n of (2 n + 1) / (n (n + 1))^order times the n-th Legendre polynomial of the cosine, by 4 pi."""
    n = np.arange(1, terms + 1)
    return np.polynomial.legendre.legval(np.clip(cosine, -1, 1), np.r_[0.0, (2 * n + 1) / (n * (n + 1.0)) ** order]) / (4 * np.pi)


def weights(there: np.ndarray, wanted: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """wanted x there: by which values at positions there give those at positions wanted. Positions are unit vectors.

    The spline takes the values, but for the ridge, and a constant; one position gives its value everywhere.
    """
    n = len(there)
    whole = np.block([[spline(there @ there.T) + ridge * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    return np.c_[spline(wanted @ there.T), np.ones(len(wanted))] @ np.linalg.pinv(whole)[:, :n]


def filled(cube: DataFrame, positions: dict[str, tuple[float, float, float]], dim: str = "ch", ridge: float = 1e-5) -> DataFrame:
    """The cube with the cells of positioned channels that are absent, null or NaN filled in from those of the same sample.

    Channels without a position stay as they are, and so do samples without any positioned channel. Several cells of one
    channel in a sample: the largest counts.
    """
    step, names = [c for c in cube.columns if c not in (dim, "x")], sorted(positions)
    at = np.array([positions[n] for n in names], float).reshape(-1, 3)
    at = at / np.linalg.norm(at, axis=1, keepdims=True)
    known = F.col(dim).isin(names)
    x = F.when(~F.isnan("x"), F.col("x").cast("double"))
    samples = cube.where(known).groupBy(*step).agg(*(F.max(F.when(F.col(dim) == n, x)).alias(f"_c{k}") for k, n in enumerate(names)))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in samples.select(*step).schema)
    s = len(step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[bytes, np.ndarray] = {}
        for batch in batches:
            v = np.stack([batch.column(s + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(names))], 1) if batch.num_rows else np.zeros((0, len(names)))
            missing = np.isnan(v)
            patterns, of = np.unique(missing, axis=0, return_inverse=True)
            for k, pattern in enumerate(patterns):
                if pattern.any() and not pattern.all():
                    w = remembered.get(pattern.tobytes())
                    if w is None:
                        if len(remembered) >= 10_000:
                            remembered.clear()
                        w = remembered[pattern.tobytes()] = weights(at[~pattern], at[pattern], ridge)
                    rows = np.flatnonzero(of.ravel() == k)
                    v[np.ix_(rows, pattern)] = v[np.ix_(rows, ~pattern)] @ w.T
            take = pa.array(np.repeat(np.arange(batch.num_rows), len(names)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(s)), pa.array(names * batch.num_rows, pa.string()), pa.array(v.ravel(), from_pandas=True)], [*step, dim, "x"])

    done = samples.mapInArrow(run, f"{kinds}`{dim}` string, x double").select(*cube.columns)
    return done.where("x IS NOT NULL").unionByName(cube.where(~F.coalesce(known, F.lit(False))).withColumn("x", F.col("x").cast("double")))
