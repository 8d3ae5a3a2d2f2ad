"""Selection by value, union, upsert, and changes of dimensions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retain(cube: DataFrame, predicate: Column) -> DataFrame:
    return cube.where(predicate)


def reject(cube: DataFrame, predicate: Column) -> DataFrame:
    return cube.where(~F.coalesce(predicate, F.lit(False)))


def retain_nearest(cube: DataFrame, dim: str, values: list[float]) -> DataFrame:
    """The slices whose coordinate is nearest to one of the values, the lower of two equally near."""
    near = cube.agg(*(F.min(F.struct(F.abs(F.col(dim) - v).alias("d"), F.col(dim).alias("at"))).alias(f"v{i}") for i, v in enumerate(values)))
    chosen = near.select(F.explode(F.array(*(F.col(f"v{i}.at") for i in range(len(values))))).alias(dim)).distinct()
    return cube.join(F.broadcast(chosen), dim, "left_semi")


def concatenate(*cubes: DataFrame) -> DataFrame:
    """All rows of all, with src, the number of the cube, from 1."""
    first, *rest = (c.withColumn("src", F.lit(i)) for i, c in enumerate(cubes, 1))
    for c in rest:
        first = first.unionByName(c, allowMissingColumns=True)
    return first


def merge(old: DataFrame, new: DataFrame, dims: list[str], value: str = "x") -> DataFrame:
    """Cells of both; where both have one, the new."""
    a, b = old.select(*dims, F.col(value).alias("_old")), new.select(*dims, F.col(value).alias("_new"), F.lit(True).alias("_has"))
    return a.join(b, dims, "full").select(*dims, F.when(F.col("_has"), F.col("_new")).otherwise(F.col("_old")).alias(value))


def compress(cube: DataFrame, dims: list[str], name: str) -> DataFrame:
    """Several dimensions as one, values joined by `_`."""
    return cube.withColumn(name, F.concat_ws("_", *(F.col(d).cast("string") for d in dims))).drop(*dims)


def upper_triangle(matrix: DataFrame, row: str, column: str) -> DataFrame:
    """The upper half of a symmetric matrix, doubled off the diagonal."""
    return matrix.where(F.col(row) <= F.col(column)).withColumn("x", F.when(F.col(row) == F.col(column), F.col("x")).otherwise(2 * F.col("x")))


def diagonal(matrix: DataFrame, row: str, column: str) -> DataFrame:
    return matrix.where(F.col(row) == F.col(column)).drop(column)


def split_runs(rows: DataFrame, group: list[str], order: list[str], value: str, length: int) -> DataFrame:
    """Runs of equal value cut into sequences of the length; what is left of a run goes. Adds run, seq, at."""
    w = Window.partitionBy(*group).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = rows.withColumn("_edge", changed).withColumn("run", F.sum("_edge").over(w))
    inside = Window.partitionBy(*group, "run")
    numbered = runs.withColumn("_n", F.row_number().over(inside.orderBy(*order)) - 1).withColumn("_all", F.count("*").over(inside))
    return numbered.withColumn("seq", F.floor(F.col("_n") / length)).withColumn("at", F.col("_n") % length).where((F.col("seq") + 1) * length <= F.col("_all")).drop("_edge", "_n", "_all")
