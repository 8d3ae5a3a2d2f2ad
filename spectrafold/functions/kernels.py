"""Distances and kernels of rows to a set of landmarks, in long form: one row a feature.

Landmarks (class means, centres of a Nystrom map) are few; where they are small Spark broadcasts them by its own statistics.
"""

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrafold.operators import wide
from spectrafold.operators.tensor import contract


def square_distances(rows: DataFrame, landmarks: DataFrame, feat: str = "feat") -> DataFrame:
    """Sum of squared differences over the features that both have."""
    keep = [c for c in (*rows.columns, *landmarks.columns) if c not in (feat, "x")]
    joined = rows.join(landmarks.withColumnRenamed("x", "_z"), feat)
    return joined.groupBy(*keep).agg(F.sum(F.pow(F.col("x") - F.col("_z"), 2)).alias("x"))


def kernel(rows: DataFrame, landmarks: DataFrame, kind: str = "linear", scale: float = 1.0, order: int = 2, feat: str = "feat") -> DataFrame:
    """linear, poly (xz + scale)^order, rbf exp(-d2 / 2 scale) or distance exp(-d / scale)."""
    if kind in ("linear", "poly"):
        base = contract(rows, landmarks, [feat])
        return base if kind == "linear" else base.withColumn("x", F.pow(F.col("x") + scale, F.lit(order)))
    base = square_distances(rows, landmarks, feat)
    how: dict[str, Column] = {"rbf": F.exp(-0.5 * F.col("x") / scale), "distance": F.exp(-F.sqrt("x") / scale)}
    return base.withColumn("x", how[kind])


def mixed(rows: DataFrame, landmarks: DataFrame, weights: dict[str, float], scale: float = 1.0, feat: str = "feat") -> DataFrame:
    """Weighted sums of kernels, all from one pass over products and distances."""
    keep = [c for c in (*rows.columns, *landmarks.columns) if c not in (feat, "x")]
    joined = rows.join(landmarks.withColumnRenamed("x", "_z"), feat)
    both = joined.groupBy(*keep).agg(F.sum(F.col("x") * F.col("_z")).alias("_p"), F.sum(F.pow(F.col("x") - F.col("_z"), 2)).alias("_d"))
    p, d = F.col("_p"), F.col("_d")
    how = {"linear": p, "poly": F.pow(p + scale, F.lit(2)), "rbf": F.exp(-0.5 * d / scale), "distance": F.exp(-F.sqrt(d) / scale)}
    return both.withColumn("x", sum(w * how[k] for k, w in weights.items())).drop("_p", "_d")


def centred(matrix: DataFrame, row: str, column: str) -> DataFrame:
    """Less the means of rows and columns, plus that of all; the column means are one row a landmark."""
    means = matrix.groupBy(column).agg(F.avg("x").alias("_c"))
    total = matrix.agg(F.avg("x").alias("_m"))
    joined = matrix.join(means, column).crossJoin(F.broadcast(total))
    return joined.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy(row)) - F.col("_c") + F.col("_m")).drop("_c", "_m")


def between(x: np.ndarray, z: np.ndarray, kind: str = "linear", scale: float = 1.0, order: int = 2) -> np.ndarray:
    """The kernels of kernel() between the rows of two matrices."""
    if kind == "linear":
        return x @ z.T
    if kind == "poly":
        return (x @ z.T + scale) ** order
    d = np.maximum((x * x).sum(1)[:, None] + (z * z).sum(1) - 2 * x @ z.T, 0)
    return np.exp(-0.5 * d / scale) if kind == "rbf" else np.exp(-np.sqrt(d) / scale)


def feature_map(landmarks: np.ndarray, kind: str, scale: float, order: int) -> Callable[[np.ndarray], np.ndarray]:
    """Features whose products are the kernel as far as the landmarks span it: K(x, landmarks) K(landmarks, landmarks)^-1/2."""
    values, vectors = np.linalg.eigh(between(landmarks, landmarks, kind, scale, order))
    good = values > 1e-10 * max(values.max(), 1e-300)
    root = vectors[:, good] / np.sqrt(values[good])
    return lambda x: between(x, landmarks, kind, scale, order) @ root


def landmarks(rows: DataFrame, vector: str, dimension: int, count: int, passes: int = 4, kind: str = "linear", scale: float = 1.0, order: int = 2, seed: int = 7) -> tuple[np.ndarray, float]:
    """count vectors (fewer if there are fewer that differ), and the mean error of the kernel's diagonal that they leave.

    Each pass draws its share by weight: vectors that those drawn so far represent badly are the likelier ones. A draw is
    the head of an order by an exponential variable of a hash, divided by the weight, so it is one top-k and reruns agree.
    """
    found = np.zeros((0, dimension))
    kept = rows.where(wide.whole(vector, dimension)).select(F.col(vector).cast("array<double>").alias("v"))

    def left(found: np.ndarray) -> DataFrame:
        change = feature_map(found, kind, scale, order) if len(found) else None

        def errors(v: np.ndarray) -> np.ndarray:
            whole = (v * v).sum(1) if kind == "linear" else ((v * v).sum(1) + scale) ** order if kind == "poly" else np.ones(len(v))
            rest = np.maximum(whole - ((change(v) ** 2).sum(1) if change else 0), 0)
            return np.c_[np.where(rest > 1e-9 * np.maximum(whole, 1e-300), rest, 0)]

        return wide.mapped(kept.withColumn("_e", F.col("v")), "_e", dimension, errors).withColumn("_e", F.col("_e")[0])

    for k in range(passes):
        share = -(-(count - len(found)) // (passes - k))
        if share <= 0:
            break
        unit = (F.pmod(F.xxhash64(F.col("v"), F.lit(seed + k)), F.lit(1 << 53)) + 1) / F.lit(float(1 << 53))
        drawn = left(found).where("_e > 0").select("v", (-F.log(unit) / F.col("_e")).alias("_key")).orderBy("_key", "v").limit(share).collect()
        # Equal vectors draw equal keys and lie side by side.
        new = np.unique(np.array([r["v"] for r in drawn]).reshape(-1, dimension), axis=0)
        found = np.vstack([found, new])
    error = left(found).agg(F.avg("_e")).first()[0] if len(found) else None
    return found, float(error or 0.0)


def nystrom(rows: DataFrame, vector: str, dimension: int, chosen: np.ndarray, kind: str = "linear", scale: float = 1.0, order: int = 2) -> DataFrame:
    """rows with the vector's features by landmarks: their products are about the kernel, and exact between landmarks."""
    return wide.mapped(rows, vector, dimension, feature_map(chosen, kind, scale, order))
