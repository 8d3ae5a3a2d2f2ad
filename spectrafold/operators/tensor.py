"""Broadcasting operators and tensor contraction between long-form cubes."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b),
    "^": F.pow,
    "min": F.least,
    "max": F.greatest,
    "==": lambda a, b: (a == b).cast("double"),
    "~=": lambda a, b: (a != b).cast("double"),
    "<": lambda a, b: (a < b).cast("double"),
    ">": lambda a, b: (a > b).cast("double"),
    "<=": lambda a, b: (a <= b).cast("double"),
    ">=": lambda a, b: (a >= b).cast("double"),
}


def broadcasting(x: DataFrame, op: str, y: DataFrame) -> DataFrame:
    """x op y, matched on the dimensions that both have; y is repeated along those that it lacks."""
    shared = [c for c in x.columns if c in y.columns and c != "x"]
    other = y.withColumnRenamed("x", "_y")
    joined = x.join(other, shared) if shared else x.crossJoin(other)
    return joined.withColumn("x", OPERATORS[op](F.col("x"), F.col("_y"))).drop("_y")


def contract(x: DataFrame, y: DataFrame, inner: list[str], aligned: list[str] = ()) -> DataFrame:
    """Sum over the inner dimensions of x * y; aligned dimensions are matched and kept, all others are outer."""
    keys = [*inner, *aligned]
    outer_x = [c for c in x.columns if c not in keys and c != "x"]
    outer_y = [c for c in y.columns if c not in keys and c != "x"]
    joined = x.join(y.withColumnRenamed("x", "_y"), keys)
    return joined.groupBy(*aligned, *outer_x, *outer_y).agg(F.sum(F.col("x") * F.col("_y")).alias("x"))


def covariance(cube: DataFrame, dim: str, over: str, step: list[str]) -> DataFrame:
    """Uncentred covariance of a dimension per step: sums of products over the other, by the number of samples."""
    twin = cube.withColumnRenamed(dim, f"{dim}2")
    sums = contract(cube, twin, [over], step)
    n = cube.groupBy(*step).agg(F.count_distinct(over).alias("n"))
    return sums.join(n, step).withColumn("x", F.col("x") / F.col("n")).drop("n")
