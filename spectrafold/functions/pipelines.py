"""Pipelines of fitted transforms over folds, from one pass over the rows.

Every stage here is fitted from sums and products: centring, scaling, whitening, components, ridge and lasso regression. The sums of
products of (1, features, target) add up over rows, so what all folds but one give is the total less the fold's own; a
stage maps such sums to a matrix, and the sums after the stage follow from those before it. So a whole pipeline is fitted
for all folds without reading the rows again, and ends in one weight vector a fold in the first features' own space.

Rows of a null fold, or whose vector or target holds a null, teach nothing; a null fold's rows get a null value. A fold that
alone has rows, and an empty table, give null values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.operators import wide
from spectrafold.operators.spatial import whitener

#: Stands for a null fold.
NO_FOLD = -(1 << 62)
#: From sums of products of (1, features, target) to a matrix by which (1, features, target) is multiplied.
Stage = Callable[[np.ndarray], np.ndarray]


def _moments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the features."""
    mean = sums[0, 1:-1] / sums[0, 0]
    return mean, sums[1:-1, 1:-1] / sums[0, 0] - np.outer(mean, mean)


def _affine(offset: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(features - offset) weights, with the one and the target as they are."""
    d, k = weights.shape
    out = np.zeros((d + 2, k + 2))
    out[0, 0] = out[-1, -1] = 1
    out[1:-1, 1:-1] = weights
    out[0, 1:-1] = -offset @ weights
    return out


def centred(sums: np.ndarray) -> np.ndarray:
    mean, _ = _moments(sums)
    return _affine(mean, np.eye(len(mean)))


def standardised(sums: np.ndarray) -> np.ndarray:
    """Less the mean, by the spread; features without spread stay as they are."""
    mean, covariance = _moments(sums)
    spread = np.sqrt(np.maximum(np.diag(covariance), 0))
    return _affine(mean, np.diag(1 / np.where(spread > 1e-12, spread, 1)))


def whitened(sums: np.ndarray) -> np.ndarray:
    mean, covariance = _moments(sums)
    return _affine(mean, whitener(covariance))


def components(count: int) -> Stage:
    """The directions of largest variance."""

    def fit(sums: np.ndarray) -> np.ndarray:
        mean, covariance = _moments(sums)
        return _affine(mean, np.linalg.eigh(covariance)[1][:, ::-1][:, :count])

    return fit


def ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Offset and weights of the target on the features; the offset has no penalty."""
    gram = sums[:-1, :-1] + np.diag([0.0] + [penalty] * (len(sums) - 2))
    return np.linalg.lstsq(gram, sums[:-1, -1], rcond=None)[0]


def lasso(sums: np.ndarray, penalty: float, rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """Offset and weights that make half the mean square error, plus the penalty times the sum of absolute weights, least.

    Coordinate by coordinate from the sums alone, so no round reads a row.
    """
    mean, covariance = _moments(sums)
    target = sums[0, -1] / sums[0, 0]
    shared, w = sums[1:-1, -1] / sums[0, 0] - mean * target, np.zeros(len(mean))
    for _ in range(rounds):
        before = w.copy()
        for k in np.flatnonzero(np.diag(covariance) > 1e-300):
            left = shared[k] - covariance[k] @ w + covariance[k, k] * w[k]
            w[k] = np.sign(left) * max(abs(left) - penalty, 0) / covariance[k, k]
        if np.abs(w - before).max(initial=0) <= tolerance * max(np.abs(w).max(initial=0), 1e-300):
            break
    return np.r_[target - w @ mean, w]


def fitted(sums: np.ndarray, stages: list[Stage], penalty: float, last: Callable[[np.ndarray, float], np.ndarray] = ridge) -> np.ndarray:
    """Offset and weights in the first features' own space; last is ridge or lasso."""
    way = np.eye(len(sums))
    for stage in stages:
        step = stage(sums)
        way, sums = way @ step, step.T @ sums @ step
    return way[:-1, :-1] @ last(sums, penalty)


def fold_weights(rows: DataFrame, fold: str, vector: str, target: str, dimension: int, stages: list[Stage], penalties: list[float], last: Callable[[np.ndarray, float], np.ndarray] = ridge) -> dict[tuple[int, float], np.ndarray]:
    """Of each fold and penalty the offset and weights that all other folds give. Folds are whole numbers."""
    joined = rows.where(F.col(target).isNotNull()).select(fold, F.concat(F.array(F.lit(1.0)), F.col(vector).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("_m"))
    own = wide.gathered(wide.outer_sums(joined, F.col(fold), "_m", dimension + 2), dimension + 2, dimension + 2)
    total = sum(own.values()) if own else np.zeros((1, 1))
    return {(f, p): fitted(total - m, stages, p, last) for f, m in own.items() for p in penalties if total[0, 0] - m[0, 0] > 0.5}


def fold_values(rows: DataFrame, fold: str, vector: str, weights: dict[tuple[int, float], np.ndarray], penalties: list[float]) -> DataFrame:
    """rows with penalty and dv, once for each penalty: the value by the weights that did not see the row's fold."""
    dimension = len(next(iter(weights.values()))) - 1 if weights else 0
    names, kept = rows.columns, rows.withColumn("_v", F.when(wide.whole(vector, dimension), F.col(vector).cast("array<double>"))).withColumn("_f", F.col(fold).cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            good, ids = np.array(batch.column(len(names)).is_valid()), np.array([NO_FOLD if f is None else f for f in batch.column(len(names) + 1).to_pylist()])
            v = np.zeros((n, dimension))
            v[good] = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension) if dimension else v[good]
            for p in penalties:
                dv = np.full(n, np.nan)
                for f in np.unique(ids):
                    if (int(f), p) in weights:
                        w, at = weights[int(f), p], (ids == f) & good
                        dv[at] = v[at] @ w[1:] + w[0]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array([p] * n, pa.float64()), pa.array(dv, from_pandas=True)], [*names, "penalty", "dv"])

    return kept.mapInArrow(run, f"{kinds}, penalty double, dv double")


def nested(rows: DataFrame, outer: str, inner: str, vector: str, target: str, dimension: int, stages: list[Stage], penalties: list[float]) -> tuple[dict[int, float], dict[tuple[int, float], np.ndarray]]:
    """Of each outer fold the penalty that its inner folds find best, and its weights: folds within folds, from the same sums.

    The inner value is the mean square error over the inner folds, which follows from sums alone; the smaller penalty of equal ones.
    """
    joined = rows.where(F.col(target).isNotNull()).select((F.col(outer).cast("long") * 1_000_003 + F.col(inner).cast("long")).alias("_g"), F.concat(F.array(F.lit(1.0)), F.col(vector).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("_m"))
    own = wide.gathered(wide.outer_sums(joined, F.col("_g"), "_m", dimension + 2), dimension + 2, dimension + 2)
    total = sum(own.values()) if own else np.zeros((1, 1))
    best, weights = {}, {}
    for f in sorted({g // 1_000_003 for g in own}):
        train = total - sum(m for g, m in own.items() if g // 1_000_003 == f)
        if train[0, 0] < 0.5:
            continue
        errors = dict.fromkeys(sorted(penalties), 0.0)
        for k in sorted({g % 1_000_003 for g in own}):
            held = sum((m for g, m in own.items() if g // 1_000_003 != f and g % 1_000_003 == k), np.zeros_like(train))
            if 0.5 < held[0, 0] < train[0, 0] - 0.5:
                for p in errors:
                    w = np.append(fitted(train - held, stages, p), -1.0)
                    errors[p] += w @ held @ w
        best[f] = min(errors, key=lambda p: (errors[p], p))
        weights[f, best[f]] = fitted(train, stages, best[f])
    return best, weights
