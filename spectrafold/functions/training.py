"""Linear classifiers over folds and penalties: logistic regression and support vectors by pyspark.ml, discriminants from second moments.

A fit reads its training rows from the cluster; what reaches the driver is weights, as many as there are features.
Rows of null label or vector are left out; a fold whose training rows are of one class gives that class's side, 1 or -1, one
without training rows null values, and an empty table an empty one.
"""

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.operators.spatial import second_moments


def logistic(rows: DataFrame, vector: str, label: str, penalty: float, l1_share: float = 0.0, multinomial: bool = False, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Weights (one row a class, or one of all) and offsets of labels 0, 1, ..; l1_share is the lasso's part of the penalty."""
    kept = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    if kept.isEmpty():
        return np.zeros((1, 0)), np.zeros(1)
    fitted = LogisticRegression(regParam=penalty, elasticNetParam=l1_share, maxIter=rounds, tol=1e-8, standardization=False, family="multinomial" if multinomial else "binomial").fit(kept)
    offset = np.array(fitted.interceptVector.toArray())
    # Labels of one class have an infinite offset: their side, instead.
    return fitted.coefficientMatrix.toArray(), np.where(np.isinf(offset), np.sign(offset), offset)


def support_vectors(rows: DataFrame, vector: str, label: str, penalty: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear support vector machine on labels 0 and 1: mean hinge loss plus half the penalty times the squared weights.

    Labels of one class give that class's side; no row, no weights.
    """
    kept = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    # Two labels at most, and a vector to know the length by.
    sides = sorted(r[0] for r in kept.select("label").distinct().limit(3).collect())
    if not sides:
        return np.zeros(0), 0.0
    if len(sides) == 1:
        return np.zeros(kept.first()["features"].size), 1.0 if sides[0] > 0 else -1.0
    fitted = LinearSVC(regParam=penalty, maxIter=rounds, tol=1e-9, standardization=False).fit(kept)
    return np.array(fitted.coefficients.toArray()), float(fitted.intercept)


def discriminant(rows: DataFrame, vector: str, side: str, dimension: int, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and offset of the linear discriminant between sides 1 and 0: class means by the pooled covariance, from one pass."""
    joined = rows.select(side, F.concat(F.col(vector).cast("array<double>"), F.array(F.lit(1.0))).alias("v"))
    sums = second_moments(joined, side, "v", dimension + 1)
    if 0 not in sums or 1 not in sums:
        return np.zeros(dimension), 0.0 if not sums else (1.0 if 1 in sums else -1.0)
    mean = {s: m[:-1, -1] / m[-1, -1] for s, m in sums.items()}
    within = sum(m[:-1, :-1] - m[-1, -1] * np.outer(mean[s], mean[s]) for s, m in sums.items()) / sum(m[-1, -1] for m in sums.values())
    w = np.linalg.solve(within + ridge * np.trace(within) / dimension * np.eye(dimension), mean[1] - mean[0])
    return w, float(-w @ (mean[0] + mean[1]) / 2)


def scored(rows: DataFrame, vector: str, weights: np.ndarray, offset: float, name: str = "dv") -> DataFrame:
    """Adds the decision value, all in the JVM."""
    w = F.array(*(F.lit(float(v)) for v in weights))
    terms = F.zip_with(F.col(vector).cast("array<double>"), w, lambda a, b: a * b)
    return rows.withColumn(name, F.aggregate(terms, F.lit(float(offset)), lambda a, b: a + b))


def over_folds(rows: DataFrame, vector: str, label: str, fold: str, folds: list[int], penalties: list[float], l1_share: float = 0.0) -> DataFrame:
    """rows with penalty and dv: each row by the models that did not see its fold, one for each penalty."""
    out = None
    for penalty in penalties:
        for k in folds:
            train, test = rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)
            w, b = logistic(train, vector, label, penalty, l1_share)
            part = (scored(test, vector, w[0], b[0]) if w.shape[1] else test.withColumn("dv", F.lit(None).cast("double"))).withColumn("penalty", F.lit(float(penalty)))
            out = part if out is None else out.unionByName(part)
    return out


def best_penalty(values: DataFrame, y: str, fold: str = "fold") -> DataFrame:
    """penalty, rate, se: the mean rate over the folds, best first, the larger penalty of equal ones."""
    right = (F.signum("dv") == F.signum(F.col(y))).cast("double")
    by_fold = values.groupBy("penalty", fold).agg(F.avg(right).alias("r"))
    return by_fold.groupBy("penalty").agg(F.avg("r").alias("rate"), (F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("se")).orderBy(F.desc("rate"), F.desc("penalty"))
