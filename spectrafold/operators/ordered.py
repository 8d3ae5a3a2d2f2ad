"""Numbers and running sums along an order, however long one key's rows are.

Rows are dealt by ranges of key and order, so a key with many rows lies on many tasks, one part of it on each. A part's own
sums come from its rows, what lies before it from the sums of the parts, of which a key has as many as there are tasks.
Nulls are keys and places in the order like other values and come first. Equal places are told apart by no rule: name
columns enough.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrafold.operators.statistics import met
from spectrafold.plans.lineage import written


def placed(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """rows in order, written once, with _part (the range) and _place (consecutive in a range)."""
    by = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    return written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "placed")


def _before(parts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of each part the sums of the parts before it."""
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns({c: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in columns})


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "number") -> DataFrame:
    """Adds the row's number among those of its key, from 1."""
    there = placed(rows, keys, order)
    parts = there.groupBy(*keys, "_part").agg(F.min("_place").alias("_first_place"), F.count("*").alias("_rows_before"))
    found = met(there, _before(parts, keys, ["_rows_before"]), [*keys, "_part"])
    return found.withColumn("_number", F.col("_rows_before") + F.col("_place") - F.col("_first_place") + 1).drop("_rows_before", "_first_place", "_part", "_place").withColumnRenamed("_number", name)


def running_sums(rows: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column], total: bool = False) -> DataFrame:
    """Adds sums over the key's rows up to and with each; with total also <name>_all over all of them. Nulls add nothing."""
    there = placed(rows.withColumns({f"_s_{n}": c for n, c in sums.items()}), keys, order)
    own = [f"_s_{n}" for n in sums]
    parts = there.groupBy(*keys, "_part").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_b") for c in own))
    whole = parts.withColumns({f"{c}_all": F.sum(f"{c}_b").over(Window.partitionBy(*keys)) for c in own}) if total else parts
    before = _before(whole, keys, [f"{c}_b" for c in own])
    upto = Window.partitionBy(*keys, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    out = met(there, before, [*keys, "_part"]).withColumns({n: F.coalesce(F.sum(f"_s_{n}").over(upto), F.lit(0)) + F.col(f"_s_{n}_b") for n in sums})
    out = out.withColumnsRenamed({f"_s_{n}_all": f"{n}_all" for n in sums}) if total else out
    return out.drop("_part", "_place", *own, *(f"{c}_b" for c in own))


def followed(rows: DataFrame, keys: list[str], order: list[str | Column], column: str, name: str) -> DataFrame:
    """Adds the column's value in the row that follows among those of the key; null for the last."""
    there = placed(rows, keys, order)
    heads = there.groupBy(*keys, "_part").agg(F.min_by(F.struct(F.col(column).alias("v")), "_place").alias("_head"))
    later = heads.withColumn("_head", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_part")))
    inside = F.lead(F.struct(F.col(column).alias("v"))).over(Window.partitionBy(*keys, "_part").orderBy("_place"))
    return met(there, later, [*keys, "_part"]).withColumn("_in", inside).withColumn(name, F.coalesce("_in", "_head")["v"]).drop("_part", "_place", "_head", "_in")
