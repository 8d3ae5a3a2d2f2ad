"""Second moments of vectors, and what follows from them: whitening, common spatial patterns, ridge regression.

One pass over the rows sums outer products in each task; only matrices, as large as the vectors' dimension squared, are summed over
the cluster, row by row, and come to the driver.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.operators import wide

#: Above this dimension a matrix is too large for the driver; use kernels of landmarks.
MAX_DIMENSION = 2048


def second_moments(rows: DataFrame, group: str, vector: str, dimension: int) -> dict[int, np.ndarray]:
    """Of each group (integer) the sum of outer products. Rows of a null group, or whose vector is null, of another length or holds a null, are left out."""
    if dimension > MAX_DIMENSION:
        raise ValueError(f"dimension {dimension} is above {MAX_DIMENSION}")

    return wide.gathered(wide.outer_sums(rows, F.col(group), vector, dimension), dimension, dimension)


def project(vector: str, weights: np.ndarray) -> Column:
    """The vector times each column of a matrix, as an array; stays in the JVM."""
    terms = [F.array(*(F.lit(float(w)) for w in column)) for column in weights.T]
    one = lambda w: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.transform(F.array(*terms), one)


def whitener(covariance: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Symmetric inverse root; directions with less than the tolerance of the largest variance go."""
    values, vectors = np.linalg.eigh(covariance)
    good = values > tolerance * values.max()
    return (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T


def common_patterns(first: np.ndarray, second: np.ndarray, pairs: int) -> np.ndarray:
    """Filters whose variance differs most between two covariances: so many from either end, as columns."""
    w = whitener(first + second)
    _, vectors = np.linalg.eigh(w @ first @ w)
    return w @ np.hstack([vectors[:, :pairs], vectors[:, ::-1][:, :pairs]])


def ridge_folds(rows: DataFrame, fold: str, vector: str, y: str, dimension: int, penalty: float) -> dict[int, np.ndarray]:
    """Of each fold the weights and offset (last) learnt from all others: one pass gives every fold's normal equations."""
    joined = rows.where(F.col(y).isNotNull()).select(fold, F.concat(F.col(vector).cast("array<double>"), F.array(F.lit(1.0), F.col(y).cast("double"))).alias("v"))
    sums = second_moments(joined, fold, "v", dimension + 2)
    total = sum(sums.values())
    ridge = np.diag([penalty] * dimension + [0.0])
    return {f: np.linalg.lstsq((total - own)[:-1, :-1] + ridge, (total - own)[:-1, -1], rcond=None)[0] for f, own in sums.items()}


def decision_values(rows: DataFrame, fold: str, vector: str, weights: dict[int, np.ndarray]) -> DataFrame:
    """Adds dv: of each row by the weights of its fold; null without weights of it."""
    if not weights:
        return rows.withColumn("dv", F.lit(None).cast("double"))
    table = F.create_map(*(c for f, w in weights.items() for c in (F.lit(f), F.array(*(F.lit(float(v)) for v in w)))))
    terms = F.zip_with(F.concat(F.col(vector).cast("array<double>"), F.array(F.lit(1.0))), F.element_at(table, F.col(fold)), lambda a, b: a * b)
    return rows.withColumn("dv", F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))
