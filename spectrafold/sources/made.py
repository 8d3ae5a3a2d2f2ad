"""Made cubes: every cell is an expression of its place, so any size comes from a range and no row is shipped."""

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sine(frequency: float, rate: float, phase: float = 0.0) -> Column:
    return F.sin(2 * pi * frequency * F.col("time") / rate + phase)


def peak(at: float, width: float) -> Column:
    return F.exp(-F.pow((F.col("time") - at) / width, F.lit(2)) / 2)


def noise(seed: int) -> Column:
    """Uniform in [-1, 1), the same for a cell whenever it is made."""
    return F.pmod(F.xxhash64(F.lit(seed), "ch", "time", "epoch"), F.lit(1 << 30)) / float(1 << 29) - 1


def toy_cube(spark: SparkSession, channels: int, samples: int, epochs: int, x: Column) -> DataFrame:
    """ch, time, epoch from 0 and x, which reads them."""
    i = F.col("id")
    return spark.range(channels * samples * epochs).select((i % channels).alias("ch"), (F.floor(i / channels) % samples).alias("time"), F.floor(i / (channels * samples)).alias("epoch")).withColumn("x", x)


def mixed(cube: DataFrame, signal: Column, share: float = 1.0) -> DataFrame:
    """A made signal, which reads the cells' places, added to a cube's cells."""
    return cube.withColumn("x", F.col("x") + share * signal)


def even_noise(*place: str | Column) -> Column:
    """Uniform in [-1, 1), from the first 32 bits of the digest of a place as text: engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *place).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 31) - 1


def coloured_noise(rows: DataFrame, keys: list[str], order: list[str], poles: list[float]) -> DataFrame:
    """keys, order, x: noise along each series that leans on its own past, x(t) = noise(t) + poles[0] x(t-1) + .., of any length."""
    from spectrafold.operators.recursive import equation, filtered

    places = rows.select(*keys, *order).withColumn("x", even_noise(*(F.col(c).cast("string") for c in (*keys, *order))))
    return filtered(places, keys, order, equation([1.0], [1.0, *(-p for p in poles)]))
