"""Mixing sources to target weights by weighted fair queueing.

Documents of a source come in a shuffled order (by the MD5 of their doc_id), repeated up to
REPEATS times. A copy's virtual finish time is the words of its source up to and with it, divided by
the source's target; all copies are ordered by it and taken until the total budget is full, the
last one in part. Order is by (finish time, source, words so far); the copy in which the budget ends is found by
narrowing in on it with sums over a fixed number of ranges, so no global sort is needed to truncate.

Defined results: a null text has no words; a source of no words has target 0; null is a source of
its own and comes last; repeated rows are separate rows; rows with null doc_id come first in their
source; an empty table gives an empty result; only doc_id, source and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, row_key, text_of, words_of

#: By rank of source in code point order, repeating.
WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Ranges of the finish time; so many sums reach the driver at once.
BINS = 16_384
#: A range of so many rows is sorted as it is.
EDGE = 50_000


def _src() -> Column:
    """The source as text that is never null, other for null than for any text."""
    return F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))


def sizes(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.select("doc_id", "source", _src().alias("src"), F.coalesce("doc_id", F.lit(0)).alias("_id"), row_key().alias("_key"), F.size(words_of(text_of(docs))).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place"))


def targets(sized: DataFrame) -> DataFrame:
    """src, source_size, target: shares by weight of all words, none above REPEATS times its source.

    In ascending order of the level at which a source is full, a source is full if its level is no
    higher than the level that the sources from it on would share.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("level", "src")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(1))
    by_source = sized.groupBy("src", "source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight).withColumn("most", REPEATS * F.col("source_size")).withColumn("level", F.col("most") / F.col("weight"))
    shared = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    full = by_source.withColumn("full", F.col("level") <= shared)
    left = F.sum("source_size").over(everything) - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    return full.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * left / open_weight)).select("src", "source_size", "target")


def queue(sized: DataFrame, by_source: DataFrame) -> DataFrame:
    """Adds source_size, target, and so_far: words of the source up to and with the row, in shuffled order.

    Rows are numbered within (source, first three digits of the place), so a large source is spread
    over 4096 parts; the parts' sums give the rest.
    """
    rows = sized.withColumn("part", F.substring("place", 1, 3))
    parts = rows.groupBy("src", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(by_source, "src")
    within = Window.partitionBy("src", "part").orderBy("place", "doc_id", "size", "_key").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("so_far", F.sum("size").over(within)).join(parts, ["src", "part"]).withColumn("so_far", F.col("so_far") + F.col("before")).drop("before", "part")


def _cut_row(copies: DataFrame, budget: int):
    """The copy in which the budget ends and the words of it that still fit, or None if all fit.

    The unit interval of finish / (1 + finish) is cut into BINS ranges, then the range in which the
    budget ends into BINS again, until it holds few rows: only sums of ranges reach the driver, and
    only the last range is sorted. Copies of equal finish are of different sources.
    """
    low, width, room = 0.0, 1.0, budget
    at = F.col("finish") / (1 + F.col("finish"))
    while True:
        inside = copies.where((at >= low) & (at < low + width))
        sums = inside.groupBy(F.floor((at - low) / width * BINS).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
        for r in sorted(sums):
            if r["words"] > room:
                break
            room -= r["words"]
        else:
            return None
        low, width = low + r["bin"] * width / BINS, width / BINS
        if r["rows"] <= EDGE or width < 1e-14:
            break
    # The range's own sum may differ by a row whose finish is rounded across its edge: count what lies below.
    room = budget - copies.where(at < low).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    order = Window.orderBy("finish", "src", "so_far").rowsBetween(Window.unboundedPreceding, 0)
    near = copies.where((at >= low) & (at < low + 2 * width))
    edge = near.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") > room).orderBy("upto").first()
    return edge and (edge, room - (edge["upto"] - edge["size"]))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, src, _id, _key, size, source_size, target, taken of each document."""
    sized = cut(sizes(docs), "sizes")
    queued = cut(queue(sized, cut(targets(sized), "targets")), "queue")
    copy = lambda k: (k * F.col("source_size") + F.col("so_far")) / F.col("target")
    copies = queued.where("size > 0").select("src", "so_far", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(REPEATS - 1)), copy)).alias("finish"))
    budget = queued.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    taken, found = F.lit(REPEATS) * F.col("size"), _cut_row(copies, budget)
    if found:
        edge, rest = found
        taken = F.lit(0).cast("long")
        for k in range(REPEATS):
            finish, src, so_far, at = copy(F.lit(k)), F.col("src"), F.col("so_far"), edge["finish"]
            earlier = (finish < at) | (finish == at) & ((src < edge["src"]) | (src == edge["src"]) & (so_far < edge["so_far"]))
            same = (finish == at) & (src == edge["src"]) & (so_far == edge["so_far"])
            taken = taken + F.when(F.col("size") == 0, 0).when(earlier, F.col("size")).when(same, rest).otherwise(0)
    return queued.select("doc_id", "source", "src", "_id", "_key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, all columns: each document as often as it is taken whole, and once with its first words where it is taken in part."""
    key = ["_id", "_key", "src"]
    # Rows that agree in all of these are alike, so any of them may have any's share.
    number = F.row_number().over(Window.partitionBy(*key).orderBy("_id")).alias("number")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").select("_row", F.coalesce("doc_id", F.lit(0)).alias("_id"), row_key().alias("_key"), _src().alias("src")).select("*", number)
    shares = cut(mix(docs), "shares").where("taken > 0").select(*key, "size", "taken", number)
    whole = (F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") % F.col("size")).cast("int")
    copies = rows.join(shares, [*key, "number"]).withColumn("words", F.explode(F.concat(F.array_repeat(F.lit(None).cast("int"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))))
    first_words = F.array_join(F.slice(words_of(F.coalesce(F.col("_row.text").cast("string"), F.lit(""))), 1, F.col("words")), " ")
    return copies.withColumn("_row", F.col("_row").withField("text", F.when(F.col("words").isNull(), F.col("_row.text")).otherwise(first_words))).select("_row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
