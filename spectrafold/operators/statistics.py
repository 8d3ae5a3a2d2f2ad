"""Reductions, references, normalisation, trends and outliers."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_STD = 1e-5


def met(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys in which nulls meet nulls. The other columns of the two have no name in common."""
    right = table.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in table.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return (rows.join(right, on) if keys else rows.crossJoin(F.broadcast(right))).drop(*(f"_k{i}" for i in range(len(keys))))


#: mean, sum, power (mean of squares), logpower, median, var or std (population).
KINDS = {
    "mean": F.avg,
    "sum": F.sum,
    "power": lambda x: F.avg(x * x),
    "logpower": lambda x: F.log(F.avg(x * x)),
    "median": F.median,
    "var": F.var_pop,
    "std": F.stddev_pop,
}


def reduced(cube: DataFrame, over: list[str], how: str = "mean") -> DataFrame:
    """One of KINDS over dimensions; nulls count for none, and a group of only nulls gives null."""
    return cube.groupBy(*(c for c in cube.columns if c not in over and c != "x")).agg(KINDS[how](F.col("x")).alias("x"))


def summary(cube: DataFrame, over: list[str]) -> DataFrame:
    """mu and sigma, population, with 1 for no or no finite spread and at least MIN_STD else."""
    std = F.stddev_pop("x")
    keep = [c for c in cube.columns if c not in over and c != "x"]
    return cube.groupBy(*keep).agg(F.avg("x").alias("mu"), F.when(F.isnan(std) | (std == 0), 1.0).otherwise(F.greatest(std, F.lit(MIN_STD))).alias("sigma"))


def rereference(cube: DataFrame, over: str, among=None) -> DataFrame:
    """Less the mean over a dimension, of the cells that a predicate names, all by default."""
    keep = [c for c in cube.columns if c not in (over, "x")]
    chosen = F.col("x") if among is None else F.when(among, F.col("x"))
    return cube.withColumn("x", F.col("x") - F.coalesce(F.avg(chosen).over(Window.partitionBy(*keep)), F.lit(0.0)))


def standardised(cube: DataFrame, per: list[str]) -> DataFrame:
    """Less the mean and by the spread of the cells that agree in `per`, null among its values; a null x stays null."""
    s = summary(cube, [c for c in cube.columns if c not in per]).withColumnsRenamed({"mu": "_mu", "sigma": "_sigma"})
    return met(cube, s, per).withColumn("x", (F.col("x") - F.col("_mu")) / F.col("_sigma")).drop("_mu", "_sigma")


def normalised(cube: DataFrame, per: list[str]) -> DataFrame:
    """By the root of the mean square; 1 for none."""
    power = cube.groupBy(*per).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("_rms"))
    rms = F.when(F.col("_rms") == 0, 1.0).otherwise(F.greatest("_rms", F.lit(MIN_STD)))
    return met(cube, power, per).withColumn("x", F.col("x") / rms).drop("_rms")


def detrended(cube: DataFrame, along: str) -> DataFrame:
    """Less the least-squares line along a dimension, which counts from each series' first value; one shuffle."""
    series = Window.partitionBy(*(c for c in cube.columns if c not in (along, "x")))
    t, x = F.col("_t"), F.col("x")
    slope = F.coalesce(F.try_divide(F.covar_pop(t, x).over(series), F.var_pop(t).over(series)), F.lit(0.0))
    line = F.avg(x).over(series) + slope * (t - F.avg(t).over(series))
    timed = cube.withColumn("_t", (F.col(along) - F.min(along).over(series)).cast("double"))
    return timed.withColumn("x", x - line).drop("_t")


def outliers(features: DataFrame, group: list[str], threshold: float = 3.5, rounds: int = 6, below: float | None = None) -> DataFrame:
    """Adds bad: above the median by so many root mean squares of the distance to it, over those not yet bad, again and again.

    The mean square about the median follows from mean and variance, so a round is one aggregate; what a round
    hands on is each group's bounds. A null x is never bad; below tests the other side, too.
    """
    inside = (F.col("x") <= F.col("_top")) & (F.col("x") >= F.col("_low"))
    bounds = features.groupBy(*group).agg(F.lit(float("inf")).alias("_top"), F.lit(float("-inf")).alias("_low"))
    for _ in range(rounds):
        good = F.when(inside, F.col("x"))
        middle = F.median(good)
        scale = F.sqrt(F.var_pop(good) + F.pow(F.avg(good) - middle, 2))
        low = F.lit(float("-inf")) if below is None else F.coalesce(middle - below * scale, F.lit(float("-inf")))
        found = met(features, bounds, group).groupBy(*group).agg(F.least(F.first("_top"), middle + threshold * scale).alias("_top"), F.greatest(F.first("_low"), low).alias("_low"))
        bounds = found
    return met(features, bounds, group).withColumn("bad", F.coalesce(~inside, F.lit(False))).drop("_top", "_low")


def clipped(cube: DataFrame, per: list[str], threshold: float = 2.75) -> DataFrame:
    """Within the median and so many median absolute deviations."""
    middle = cube.groupBy(*per).agg(F.median("x").alias("_med"))
    scale = met(cube, middle, per).groupBy(*per).agg(F.first("_med").alias("_med"), F.median(F.abs(F.col("x") - F.col("_med"))).alias("_mad"))
    reach = threshold * F.col("_mad")
    return met(cube, scale, per).withColumn("x", F.greatest(F.least("x", F.col("_med") + reach), F.col("_med") - reach)).drop("_med", "_mad")


def bin_averaged(cube: DataFrame, along: str, width: int) -> DataFrame:
    return cube.withColumn(along, F.floor(F.col(along) / width) * width).groupBy(*(c for c in cube.columns if c != "x")).agg(F.avg("x").alias("x"))


def rereference_by(cube: DataFrame, keep: list[str], how: str) -> DataFrame:
    """Less one of KINDS of the cells that agree in `keep`."""
    return cube.withColumn("x", F.col("x") - KINDS[how](F.col("x")).over(Window.partitionBy(*keep)))


def regressed_out(cube: DataFrame, artefact: str, dim: str = "ch", along: str = "time") -> DataFrame:
    """The other channels less what they share with one: its cells times each series' least-squares weight, without offset.

    Where the artefact has no cell, nothing is taken off.
    """
    step = [c for c in cube.columns if c not in (dim, along, "x")]
    other = cube.where(F.col(dim) == artefact).select(*step, along, F.col("x").alias("_a"))
    joined = cube.where(F.col(dim) != artefact).join(other, [*step, along], "left")
    series = Window.partitionBy(dim, *step)
    weight = F.try_divide(F.sum(F.col("x") * F.col("_a")).over(series), F.sum(F.col("_a") * F.col("_a")).over(series))
    return joined.withColumn("x", F.col("x") - F.coalesce(weight * F.col("_a"), F.lit(0.0))).select(*cube.columns)


def fractional_bins(cube: DataFrame, along: str, width: float, origin: float = 0.0) -> DataFrame:
    """Means over bins of a width that need not be whole: bin, x and weight (what of the bin its cells cover).

    A cell at t lasts from t to t + 1 and counts in each bin by what it has in common with it. Null cells count for none; null
    places are left out. bin k lasts from origin + k width on.
    """
    keep = [c for c in cube.columns if c not in (along, "x")]
    t = F.col(along) - F.lit(float(origin))
    cells = cube.where(F.col(along).isNotNull()).withColumn("bin", F.explode(F.sequence(F.floor(t / width), F.ceil((t + 1) / width) - 1)))
    part = F.when(F.col("x").isNotNull(), F.least(t + 1, (F.col("bin") + 1) * width) - F.greatest(t, F.col("bin") * width))
    return cells.groupBy(*keep, "bin").agg((F.sum(part * F.col("x")) / F.sum(part)).alias("x"), F.coalesce(F.sum(part), F.lit(0.0)).alias("weight"))
