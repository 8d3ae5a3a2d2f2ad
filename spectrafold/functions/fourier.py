"""Fourier transforms of series as joins with sines: every step is a DataFrame operation.

A series of `length` cells takes length / 2 + 1 sums a cell, so this is for windows of a few dozen cells; absent cells count as 0.
"""

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.functions.spectra import coefficients_of, fourier
from spectrafold.operators.windows import sliding


def transform(cube: DataFrame, along: str, length: int, positive: bool = True) -> DataFrame:
    """re, im of each coefficient k, the positive ones or all."""
    return fourier(cube, along, length, list(range(length // 2 + 1 if positive else length)))


def inverse(coefficients: DataFrame, along: str, length: int, positive: bool = True) -> DataFrame:
    """The series, at 0 to length - 1, of coefficients k, re, im; positive ones stand for their mirror images, too."""
    keep = [c for c in coefficients.columns if c not in ("k", "re", "im")]
    return _series(coefficients.groupBy(*keep).agg(F.collect_list(F.struct("k", "re", "im")).alias("_c")), along, length, positive)


def _series(rows: DataFrame, along: str, length: int, positive: bool = True) -> DataFrame:
    """The same of rows with all coefficients of a series in _c: each row by itself, so nothing is grouped again."""
    wide = rows.withColumn(along, F.explode(F.sequence(F.lit(0), F.lit(length - 1))))

    def term(c: Column) -> Column:
        angle = 2 * pi * c["k"] * F.col(along) / length
        twice = F.when((c["k"] == 0) | (2 * c["k"] == length), 1.0).otherwise(2.0) if positive else F.lit(1.0)
        return twice * (c["re"] * F.cos(angle) - c["im"] * F.sin(angle))

    known = F.filter(F.transform("_c", term), lambda x: x.isNotNull())
    return wide.withColumn("x", F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / length)).drop("_c")


def filtered(cube: DataFrame, along: str, length: int, gain: Column) -> DataFrame:
    """Each series with its coefficients k times a gain; cells at 0 to length - 1."""
    return filter_bank(cube, along, length, {"": gain}).drop("band")


def filter_bank(cube: DataFrame, along: str, length: int, bands: dict[str, Column]) -> DataFrame:
    """filtered() by each of the gains, all from one transform; adds band."""
    orders = list(range(length // 2 + 1))
    wide = coefficients_of(cube, along, length, orders)
    keep = [c for c in wide.columns if c != "_c"]
    # Gains read k.
    for k in orders:
        wide = wide.withColumn("k", F.lit(k)).withColumn(f"_g{k}", F.array(*(g.cast("double") for g in bands.values())))
    scaled = [F.struct(F.lit(n).alias("band"), F.array(*(F.struct(F.lit(k).alias("k"), *((F.col("_c")[k][c] * F.col(f"_g{k}")[i]).alias(c) for c in ("re", "im"))) for k in orders)).alias("_c")) for i, n in enumerate(bands)]
    return _series(wide.select(*keep, F.inline(F.array(*scaled))), along, length)


def spectrogram(cube: DataFrame, along: str, width: int, step: int, taper: Column, total: float) -> DataFrame:
    """Amplitudes of each window's positive coefficients, by root 2 over the taper's sum: window, k, x. taper reads _i, the place in the window."""
    cells = sliding(cube, along, width, step).withColumn("_i", F.col(along) - F.col("window"))
    weighted = cells.withColumn("x", F.col("x") * taper).drop(along)
    sums = transform(weighted, "_i", width)
    scale = 2**0.5 / total
    return sums.withColumn("x", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) * scale).drop("re", "im")


def flattened(coefficients: DataFrame) -> DataFrame:
    """Coefficients by the mean amplitude that all series have at their k."""
    from spectrafold.operators.statistics import met

    mean = coefficients.groupBy("k").agg(F.avg(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("_m"))
    return met(coefficients, mean, ["k"]).withColumns({c: F.try_divide(F.col(c), F.col("_m")) for c in ("re", "im")}).drop("_m")
