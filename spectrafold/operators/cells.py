"""Changes of cells and dimensions, one row at a time or by one window: no join unless a table is joined."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import small
from .statistics import met


def signed_root(x: Column) -> Column:
    """x by the root of its size; 0 stays 0."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * F.sqrt(F.abs(x)))


def log_values(x: Column, db: bool = False) -> Column:
    """The natural logarithm, ten times it with db; null where x is not above 0."""
    value = F.log(F.when(x > 0, x))
    return 10 * value if db else value


def unit_length(cube: DataFrame, over: list[str]) -> DataFrame:
    """Each vector along the dimensions by its length; a vector of zeros becomes null."""
    keep = [c for c in cube.columns if c not in over and c != "x"]
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*keep)))
    return cube.withColumn("x", F.try_divide(F.col("x"), length))


def largest_difference(a: DataFrame, b: DataFrame, dims: list[str]) -> DataFrame:
    """One row: the largest absolute difference of cells that both have."""
    return a.join(b.withColumnRenamed("x", "_y"), dims).agg(F.max(F.abs(F.col("x") - F.col("_y"))).alias("x"))


def to_integers(cube: DataFrame, per: list[str], bits: int) -> DataFrame:
    """i, gain, offset: x scaled to whole numbers of so many bits within each group; a group of one value has gain 1."""
    top = float(2**bits - 1)
    scale = cube.groupBy(*per).agg(F.min("x").alias("offset"), F.max("x").alias("_most"))
    gain = F.when(F.col("_most") == F.col("offset"), 1.0).otherwise((F.col("_most") - F.col("offset")) / top)
    met_ = met(cube, scale, per).withColumn("gain", gain)
    return met_.withColumn("i", F.round((F.col("x") - F.col("offset")) / F.col("gain")).cast("long")).drop("_most", "x")


def from_integers(coded: DataFrame) -> DataFrame:
    return coded.withColumn("x", F.col("i") * F.col("gain") + F.col("offset")).drop("i", "gain", "offset")


def reweighted(cube: DataFrame, dim: str, weight: Column) -> DataFrame:
    """Times a weight by the dimension's value, the weights of all its values summing to 1."""
    values = cube.select(dim).distinct().withColumn("_w", weight)
    total = values.agg(F.sum("_w").alias("_all"))
    return met(cube, values, [dim]).crossJoin(F.broadcast(total)).withColumn("x", F.col("x") * F.col("_w") / F.col("_all")).drop("_w", "_all")


def deflated(cube: DataFrame, direction: DataFrame, dim: str) -> DataFrame:
    """Less what lies along a direction (dim, x) of the dimension, over the cells that are there."""
    keep = [c for c in cube.columns if c not in (dim, "x")]
    joined = met(cube, direction.withColumnRenamed("x", "_p"), [dim])
    series = Window.partitionBy(*keep)
    share = F.try_divide(F.sum(F.col("x") * F.col("_p")).over(series), F.sum(F.col("_p") * F.col("_p")).over(series))
    return joined.withColumn("x", F.col("x") - F.col("_p") * F.coalesce(share, F.lit(0.0))).drop("_p")


def complex_parts(rows: DataFrame, re: str = "re", im: str = "im") -> DataFrame:
    """A dimension `part` of real and imag in place of two columns."""
    parts = F.explode(F.array(*(F.struct(F.lit(n).alias("part"), F.col(c).alias("x")) for n, c in (("real", re), ("imag", im)))))
    return rows.withColumn("_p", parts).select(*(c for c in rows.columns if c not in (re, im)), "_p.part", "_p.x")


def squeezed(cube: DataFrame, dims: list[str]) -> DataFrame:
    """Without dimensions of one value; an error if one has several."""
    several = cube.agg(*(F.count_distinct(d).alias(d) for d in dims)).first().asDict()
    if wide := [d for d, n in several.items() if n > 1]:
        raise ValueError(f"dimensions of several values: {', '.join(wide)}")
    return cube.drop(*dims)


def dimension_sizes(cube: DataFrame, dims: list[str]) -> DataFrame:
    return cube.agg(*(F.count_distinct(d).alias(d) for d in dims))


def lag_features(cube: DataFrame, lags: int, along: str = "time") -> DataFrame:
    """A dimension `lag` from 0: each series beside itself so many cells earlier, 0 before its start."""
    keep = [c for c in cube.columns if c not in (along, "x")]
    w = Window.partitionBy(*keep).orderBy(along)
    cells = F.array(*(F.struct(F.lit(k).alias("lag"), (F.col("x") if k == 0 else F.lag("x", k, 0.0).over(w)).alias("x")) for k in range(lags + 1)))
    return cube.withColumn("_c", cells).withColumn("_c", F.explode("_c")).select(*(c for c in cube.columns if c != "x"), "_c.lag", "_c.x")


def convolved(cube: DataFrame, weights: list[float], along: str = "time") -> DataFrame:
    """Each series filtered by weights of its last cells, the present one first; 0 before its start. One sort, no join."""
    keep = [c for c in cube.columns if c not in (along, "x")]
    w = Window.partitionBy(*keep).orderBy(along)
    terms = [F.lit(float(g)) * (F.col("x") if k == 0 else F.lag("x", k, 0.0).over(w)) for k, g in enumerate(weights)]
    return cube.withColumn("x", sum(terms[1:], terms[0]))


def response_matrix(events: DataFrame, at: str, length: int) -> DataFrame:
    """The rows of a convolution matrix: each event at its own and the following length - 1 samples, as tau from 0."""
    return events.withColumn("tau", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn(at, F.col(at) + F.col("tau"))


def upsampled(cube: DataFrame, times: int, how: str = "nearest", along: str = "time") -> DataFrame:
    """times cells in place of one, along * times + 0, 1, ..: nearest (the same), linear (to the series' next cell) or zero (0 but the first)."""
    keep = [c for c in cube.columns if c not in (along, "x")]
    following = F.lead("x").over(Window.partitionBy(*keep).orderBy(along))
    k = F.col("_k")
    value = {"nearest": F.col("x"), "zero": F.when(k == 0, F.col("x")).otherwise(0.0), "linear": F.col("x") + (F.coalesce("_n", "x") - F.col("x")) * k / times}[how]
    wide = cube.withColumn("_n", following).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return wide.withColumn("x", value).withColumn(along, F.col(along) * times + k).drop("_n", "_k")


def positions(channels: DataFrame, cap: DataFrame, name: str = "ch") -> DataFrame:
    """Channels with x2, y2 (flat) and x3, y3, z3 (on the sphere) from a cap's lat and long in radians, and iseeg: whether the cap has them."""
    lat, long = F.col("lat"), F.col("long")
    joined = channels.join(small(cap), name, "left")
    return joined.withColumns({"x2": lat * F.cos(long), "y2": lat * F.sin(long), "x3": F.sin(lat) * F.cos(long), "y3": F.sin(lat) * F.sin(long), "z3": F.cos(lat), "iseeg": lat.isNotNull()})


def latitude(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of flat positions."""
    return F.sqrt(x * x + y * y), F.atan2(y, x)


def linear_index(sizes: list[int], *subscripts: Column) -> Column:
    """From 0, the first subscript running fastest."""
    out, stride = F.lit(0).cast("long"), 1
    for size, s in zip(sizes, subscripts, strict=True):
        out, stride = out + s * stride, stride * size
    return out


def subscripts(sizes: list[int], index: Column) -> list[Column]:
    out, stride = [], 1
    for size in sizes:
        out.append(F.floor(index / stride) % size)
        stride *= size
    return out


def kth_diagonal(matrix: DataFrame, row: str, column: str, k: int = 0) -> DataFrame:
    return matrix.where(F.col(column) - F.col(row) == k)


def folded(cube: DataFrame, dim: str, along: str, size: int, number: Column) -> DataFrame:
    """Without a dimension, its values following each other along another of a known size."""
    return cube.withColumn(along, F.col(along) + number * size).drop(dim)


def dimension_table(*cubes: DataFrame, dim: str) -> DataFrame:
    """Values of a dimension in all cubes, with src: val, src (the cube's number, from 1)."""
    first, *rest = (c.select(F.col(dim).cast("string").alias("val")).distinct().withColumn("src", F.lit(i)) for i, c in enumerate(cubes, 1))
    for r in rest:
        first = first.unionByName(r)
    return first
