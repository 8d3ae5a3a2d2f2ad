"""Second moments with lags, shrinkage and robust scales, in long form."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .statistics import met


def extremes(cube: DataFrame, over: list[str], how: str = "max") -> DataFrame:
    """The largest (or smallest) cell over dimensions, and where it is: dimension values as at_<name>, the least of equal ones."""
    keep = [c for c in cube.columns if c not in over and c != "x"]
    best = F.min(F.struct((-F.col("x") if how == "max" else F.col("x")).alias("s"), *over, "x")).alias("_b")
    found = cube.where("x is not null").groupBy(*keep).agg(best)
    return found.select(*keep, F.col("_b.x").alias("x"), *(F.col(f"_b.{d}").alias(f"at_{d}") for d in over))


def weighted_moments(cube: DataFrame, over: list[str], weight: Column) -> DataFrame:
    """mu and var over dimensions, each cell by its weight; null where the weights sum to 0."""
    keep = [c for c in cube.columns if c not in over and c != "x"]
    w, x = weight, F.col("x")
    sums = cube.where("x is not null").groupBy(*keep).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"))
    mu = F.try_divide("wx", "w")
    return sums.select(*keep, mu.alias("mu"), (F.try_divide("wxx", "w") - mu * mu).alias("var"))


def column_summary(cube: DataFrame, keep: list[str]) -> DataFrame:
    """least, mu, most and var (of the sample, by n - 1)."""
    return cube.groupBy(*keep).agg(F.min("x").alias("least"), F.avg("x").alias("mu"), F.max("x").alias("most"), F.var_samp("x").alias("var"))


def lagged_covariance(cube: DataFrame, lags: list[int], normalise: str = "none", dim: str = "ch", along: str = "time") -> DataFrame:
    """Per lag and series step the sums of x(i, t) * x(j, t + lag): i, j, lag. What lies beyond the end counts as 0.

    normalise: none, mean (by the number of samples) or unbiased (by that less the lag). Each cell is copied once a lag; the join
    is by equality on step and time.
    """
    step = [c for c in cube.columns if c not in (dim, along, "x")]
    early = cube.select(*step, F.col(dim).alias("i"), F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(along).alias("_t"), F.col("x").alias("_x")).withColumn("_at", F.col("_t") + F.col("lag"))
    late = cube.select(*step, F.col(dim).alias("j"), F.col(along).alias("_at"), F.col("x").alias("_y"))
    sums = early.join(late, [*step, "_at"]).groupBy(*step, "lag", "i", "j").agg(F.sum(F.col("_x") * F.col("_y")).alias("x"))
    if normalise == "none":
        return sums
    n = cube.groupBy(*step).agg(F.count_distinct(along).alias("_n"))
    by = F.col("_n") if normalise == "mean" else F.greatest(F.col("_n") - F.col("lag"), F.lit(1))
    return met(sums, n, step).withColumn("x", F.col("x") / by).drop("_n")


def cross_covariance(cube: DataFrame, stimuli: DataFrame, lags: list[int], along: str = "time") -> DataFrame:
    """Sums of x(t + lag) * w over the stimuli (key columns shared with the cube, along, code, w), by lag and code."""
    step = [c for c in cube.columns if c in stimuli.columns and c not in (along, "x")]
    keep = [c for c in cube.columns if c not in (*step, along, "x")]
    moved = stimuli.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn(along, F.col(along) + F.col("lag"))
    return cube.join(moved, [*step, along]).groupBy(*keep, "code", "lag").agg(F.sum(F.col("x") * F.col("w")).alias("x"), F.count("*").alias("n"))


def lagged_average(cube: DataFrame, stimuli: DataFrame, lags: list[int], along: str = "time") -> DataFrame:
    """The mean cell at each lag after the stimuli of a code: the time-locked response."""
    sums = cross_covariance(cube, stimuli.withColumn("w", F.lit(1.0)), lags, along)
    return sums.withColumn("x", F.col("x") / F.col("n"))


def shrunk_to_diagonal(cube: DataFrame, dim: str = "ch", sample: list[str] = ("time", "epoch")) -> DataFrame:
    """i, j, x, shrinkage: the centred covariance of complete samples, shrunk to its diagonal as far as its own noise says.

    Complete samples are written once; products and their squares come from one self-join on them.
    """
    sample = list(sample)
    whole = cube.groupBy(*sample).agg(F.count("*").alias("_k"))
    channels = cube.select(dim).distinct().agg(F.count("*").alias("_all"))
    full = whole.crossJoin(F.broadcast(channels)).where("_k = _all").select(*sample)
    kept = written(cube.join(full, sample).select(*sample, dim, "x"), "complete")
    means = kept.groupBy(dim).agg(F.avg("x").alias("_mu"))
    centred = met(kept, means, [dim]).select(*sample, dim, (F.col("x") - F.col("_mu")).alias("x"))
    twin = centred.select(*sample, F.col(dim).alias("j"), F.col("x").alias("_y"))
    product = F.col("x") * F.col("_y")
    pairs = written(centred.withColumnRenamed(dim, "i").join(twin, sample).groupBy("i", "j").agg(F.count("*").alias("t"), F.avg(product).alias("s"), F.avg(product * product).alias("q")), "pairs")
    noise, off = F.col("q") - F.col("s") * F.col("s"), F.col("i") != F.col("j")
    kappa = F.try_divide(F.sum(F.when(off, noise).otherwise(0.0)), F.sum(F.when(off, F.col("s") * F.col("s")).otherwise(0.0)))
    amount = pairs.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), kappa / F.max("t"))).alias("shrinkage"))
    return pairs.crossJoin(F.broadcast(amount)).select("i", "j", F.when(off, (1 - F.col("shrinkage")) * F.col("s")).otherwise(F.col("s")).alias("x"), "shrinkage")


def robust_variance(features: DataFrame, group: list[str], threshold: float = 4.0) -> DataFrame:
    """Mean of the powers (x) that are no more than so many root mean squares above the group's median."""
    middle = F.median("x")
    bound = features.groupBy(*group).agg((middle + threshold * F.sqrt(F.var_pop("x") + F.pow(F.avg("x") - middle, 2))).alias("_top"))
    return met(features, bound, group).where("x <= _top").groupBy(*group).agg(F.avg("x").alias("x"), F.count("*").alias("n"))


def mean_trace(covariances: DataFrame, row: str, column: str, step: list[str]) -> DataFrame:
    """Mean over the steps of the sum of the absolute diagonal: one row."""
    traces = covariances.where(F.col(row) == F.col(column)).groupBy(*step).agg(F.sum(F.abs("x")).alias("x"))
    return traces.agg(F.avg("x").alias("x"))


def signed_ranks(rows: DataFrame, group: list[str], difference: Column, order: list[str], least: float = 0.0) -> DataFrame:
    """w, n, z: the absolute sum of signed ranks of the differences, those up to `least` left out; equal ones rank in order.

    z is (w - 0.5) by the root of n (n + 1) (2 n + 1) / 6. One sort per group.
    """
    from pyspark.sql import Window

    d = rows.withColumn("_d", difference).where(F.abs("_d") > least)
    ranked = d.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.abs("_d"), *order)))
    n = F.col("n").cast("double")
    return ranked.groupBy(*group).agg(F.abs(F.sum(F.signum("_d") * F.col("_r"))).alias("w"), F.count("*").alias("n")).withColumn("z", (F.col("w") - 0.5) / F.sqrt(n * (n + 1) * (2 * n + 1) / 6))


def lag_blocks(lagged: DataFrame, n: int) -> DataFrame:
    """The block matrix of n lags of covariances by lag (lag from 0, i, j): lag_i, lag_j, i, j; below the diagonal i and j change places."""
    places = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(n) for q in range(n)))
    wide = lagged.withColumn("_b", F.explode(F.filter(places, lambda b: F.abs(b["p"] - b["q"]) == F.col("lag"))))
    upper = F.col("_b.q") >= F.col("_b.p")
    return wide.select(F.col("_b.p").alias("lag_i"), F.col("_b.q").alias("lag_j"), F.when(upper, F.col("i")).otherwise(F.col("j")).alias("i"), F.when(upper, F.col("j")).otherwise(F.col("i")).alias("j"), "x")


def products_by_dimension(cube: DataFrame, dims: list[str], step: list[str]) -> DataFrame:
    """dim, step, i, j, x: of each dimension named the sums of products over all others, per step."""
    out = None
    for dim in dims:
        over = [c for c in cube.columns if c not in (dim, "x", *step)]
        left = cube.select(*step, *over, F.col(dim).cast("string").alias("i"), F.col("x"))
        right = cube.select(*step, *over, F.col(dim).cast("string").alias("j"), F.col("x").alias("_y"))
        sums = left.join(right, [*step, *over]).groupBy(*step, "i", "j").agg(F.sum(F.col("x") * F.col("_y")).alias("x")).withColumn("dim", F.lit(dim))
        out = sums if out is None else out.unionByName(sums)
    return out
