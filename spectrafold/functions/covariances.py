"""Distances of symmetric positive matrices to a few given ones, in Arrow batches.

A matrix is an array of its rows, one after the other. The given ones are few and travel with the tasks; all others stay where
they are. A matrix that is null, of another size, or holds a null or NaN, has null distances; so has one without
positive directions, or (log product) that isn't positive. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spectrafold.operators import wide


def _log_determinants(m: np.ndarray) -> np.ndarray:
    """By Cholesky's factors; NaN where a matrix isn't positive."""
    out = np.full(len(m), np.nan)
    try:
        return 2 * np.log(np.diagonal(np.linalg.cholesky(m), axis1=1, axis2=2)).sum(1)
    except np.linalg.LinAlgError:
        for k, one in enumerate(m):
            sign, value = np.linalg.slogdet(one)
            out[k] = value if sign > 0 and np.linalg.eigvalsh(one).min() > 0 else np.nan
    return out


def log_product(x: np.ndarray, given: np.ndarray, order: float = 0.5) -> np.ndarray:
    """order (log|X| / 2 + log|Z| / 2 - log|(X + Z) / 2|): 0 for equal ones, else below."""
    own, other = _log_determinants(x), _log_determinants(given)
    both = np.stack([_log_determinants((x + z) / 2) for z in given], 1)
    return order * (own[:, None] / 2 + other / 2 - both)


def _whiteners(m: np.ndarray, least: float = 1e-10) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    good = values > least
    return np.where(good[:, None], vectors / np.sqrt(np.where(good, values, 1))[:, None], 0)


def logarithms(x: np.ndarray, given: np.ndarray, norm: float = 2.0) -> np.ndarray:
    """The norm of the logarithms of X^-1 Z's eigenvalues: the way from one to the other."""
    root = _whiteners(x)
    out = np.empty((len(x), len(given)))
    for k, z in enumerate(given):
        values = np.linalg.eigvalsh(root.transpose(0, 2, 1) @ z @ root)
        logs = np.abs(np.log(np.where(values > 1e-10, values, 1)))
        out[:, k] = (logs**norm).sum(1) ** (1 / norm)
    out[~root.any((1, 2))] = np.nan
    return out


def traces(x: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Half of trace(X^-1 Z) + trace(Z^-1 X)."""
    inverse = lambda m: (w := _whiteners(m)) @ w.transpose(0, 2, 1)
    own, other = inverse(x), inverse(given)
    out = (np.einsum("nij,kji->nk", own, given) + np.einsum("kij,nji->nk", other, x)) / 2
    out[~own.any((1, 2))] = np.nan
    return out


KINDS = {"log_product": log_product, "logarithms": logarithms, "traces": traces}


def distances(rows: DataFrame, matrix: str, size: int, given: np.ndarray, how: str, ridge: float = 0.0, name: str = "distance", **more) -> DataFrame:
    """Adds an array: the distance to each given matrix. ridge is added to every diagonal."""
    names = rows.columns
    picked = rows.withColumn("_m", rows[matrix].cast("array<double>")).withColumn("_good", wide.whole(matrix, size * size))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    others = np.asarray(given, float) + ridge * np.eye(size)
    step = max(1, (1 << 20) // (size * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                good = batch.column(len(names) + 1).fill_null(False).to_numpy(zero_copy_only=False)
                full = batch.column(len(names)).filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size)
                out = np.full((batch.num_rows, len(others)), np.nan)
                if len(full):
                    out[good] = KINDS[how](full + ridge * np.eye(size), others, **more)
                ends = pa.array(np.arange(batch.num_rows + 1) * len(others), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(out.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), lists], [*names, name])

    return picked.mapInArrow(run, f"{kinds}, `{name}` array<double>")
