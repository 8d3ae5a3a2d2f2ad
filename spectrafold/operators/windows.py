"""Windows, epochs, edges and nearest joins over an ordered dimension."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding(cube: DataFrame, along: str, width: int, step: int) -> DataFrame:
    """Each cell once for every window [k * step, k * step + width) that holds it; adds window, its start."""
    t = F.col(along)
    first = F.floor((t - width) / step) + 1
    return cube.withColumn("window", F.explode(F.transform(F.sequence(first, F.floor(t / step)), lambda k: k * step)))


def moving_average(cube: DataFrame, along: str, length: int) -> DataFrame:
    """Of the last cells, fewer at the start."""
    keep = [c for c in cube.columns if c not in (along, "x")]
    return cube.withColumn("x", F.avg("x").over(Window.partitionBy(*keep).orderBy(along).rowsBetween(1 - length, 0)))


def edges(rows: DataFrame, group: list[str], order: list[str], status: str, value) -> DataFrame:
    """Rows at which the status rises to or falls from the value; a group's first row is never one. Adds edge."""
    before = F.lag(status).over(Window.partitionBy(*group).orderBy(*order))
    edge = F.when((F.col(status) == value) & (before != value), 1).when((F.col(status) != value) & (before == value), -1)
    return rows.withColumn("edge", edge).where("edge is not null")


def epochs(events: DataFrame, key: str, at: str, start: Column, before: int, after: int, bin_width: int | None = None) -> DataFrame:
    """Rows within [start - before, start + after) of each start event of their key.

    A range join on bins as wide as the range: each start meets two or three bins of its key, so the join is by equality.
    """
    width = bin_width or before + after
    starts = events.where(start).select(key, F.col("event_id").alias("epoch"), F.col(at).alias("start"))
    starts = starts.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - before) / width), F.floor((F.col("start") + after) / width))))
    samples = events.withColumn("bin", F.floor(F.col(at) / width))
    return samples.join(starts, [key, "bin"]).where((F.col(at) >= F.col("start") - before) & (F.col(at) < F.col("start") + after)).drop("bin").withColumn("offset", F.col(at) - F.col("start"))


def next_match(rows: DataFrame, key: str, at: str, left: Column, right: Column) -> DataFrame:
    """For each left row the time of the first right row of its key at or after it; null if none. Forward as-of by one sort."""
    # From the last row back, so the frame only grows.
    w = Window.partitionBy(key).orderBy(F.col(at).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("next_at", F.min(F.when(right, F.col(at))).over(w)).where(left)


def nearest_match(rows: DataFrame, key: str, at: str, left: Column, right: Column) -> DataFrame:
    """For each left row the nearest time of a right row of its key, the earlier of two equally near. As-of in both directions by one sort."""
    grown = lambda order: Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.when(right, F.col(at))
    before = F.max(hit).over(grown(F.col(at).asc()))
    after = F.min(hit).over(grown(F.col(at).desc()))
    found = rows.withColumn("_b", before).withColumn("_a", after).where(left)
    nearer = F.when(F.col("_b").isNull() | (F.col("_a") - F.col(at) < F.col(at) - F.col("_b")), F.col("_a")).otherwise(F.col("_b"))
    return found.withColumn("nearest_at", nearer).drop("_b", "_a")


def percentile_filtered(cube: DataFrame, along: str, length: int, share: float) -> DataFrame:
    """x less the ceil(share * n)-th smallest of the last n cells, n being length at most."""
    keep = [c for c in cube.columns if c not in (along, "x")]
    last = F.collect_list("x").over(Window.partitionBy(*keep).orderBy(along).rowsBetween(1 - length, 0))
    at = F.greatest(F.ceil(F.lit(share) * F.size("_last")), F.lit(1)).cast("int")
    return cube.withColumn("_last", last).withColumn("x", F.col("x") - F.element_at(F.array_sort("_last"), at)).drop("_last")


def smoothed_to_first(cube: DataFrame, along: str, factor: float) -> DataFrame:
    """Each cell blended with its series' first."""
    keep = [c for c in cube.columns if c not in (along, "x")]
    return cube.withColumn("x", factor * F.first("x").over(Window.partitionBy(*keep).orderBy(along)) + (1 - factor) * F.col("x"))


def interpolated(cube: DataFrame, along: str) -> DataFrame:
    """Null cells between two others on the line between them; those outside stay null."""
    keep = [c for c in cube.columns if c not in (along, "x")]
    w = lambda order: Window.partitionBy(*keep).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cell = F.when(F.col("x").isNotNull(), F.struct(F.col(along).alias("t"), "x"))
    low = F.last(cell, ignorenulls=True).over(w(F.col(along).asc()))
    high = F.last(cell, ignorenulls=True).over(w(F.col(along).desc()))
    line = F.col("_l.x") + (F.col("_h.x") - F.col("_l.x")) * (F.col(along) - F.col("_l.t")) / (F.col("_h.t") - F.col("_l.t"))
    return cube.withColumn("_l", low).withColumn("_h", high).withColumn("x", F.coalesce("x", line)).drop("_l", "_h")


def block_numbers(rows: DataFrame, group: list[str], order: list[str], at: str, gap: float) -> DataFrame:
    """Adds block, from 1: a new one starts where the step to the row before is above the gap."""
    w = Window.partitionBy(*group).orderBy(*order)
    opens = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_o", opens).withColumn("block", F.sum("_o").over(w)).drop("_o")


def sample_rate(cube: DataFrame, along: str) -> DataFrame:
    """One over the mean step, of each series of two cells or more."""
    keep = [c for c in cube.columns if c not in (along, "x")]
    t = F.col(along)
    return cube.groupBy(*keep).agg(F.try_divide(F.count(t) - 1, F.max(t) - F.min(t)).alias("x")).where("x is not null")


def given_epochs(cube: DataFrame, spans: DataFrame, along: str) -> DataFrame:
    """Cells within spans [lo, hi) that are given, each once for every span.

    A span lies in every bin that it touches, bins being as wide as the mean span, so cells meet spans by equality.
    """
    width = max(float(spans.agg(F.avg(F.col("hi") - F.col("lo"))).first()[0] or 1), 1e-9)
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    joined = cube.withColumn("_bin", F.floor(F.col(along) / width)).join(binned, "_bin")
    return joined.where((F.col(along) >= F.col("lo")) & (F.col(along) < F.col("hi"))).drop("_bin", "lo", "hi")
