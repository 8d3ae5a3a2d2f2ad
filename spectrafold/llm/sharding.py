"""Sharding: minimax contiguous partition of atomic groups of equal texts over a fixed number of shards.

Law `bytes`: every copy of a text stays in one shard, and the largest shard is as small as that
allows. Groups are gathered into UNITS units by the hash of their text; equal texts share a unit.
Units in descending order of size are the ordered atomic sizes: units above an even share get a
shard of their own, then a binary search finds the smallest capacity for which a greedy pass
needs no more shards than are left, and the greedy pass at that capacity makes the cuts. The
driver sees UNITS sums at most, whatever the number of documents.

Defined results: a null text has no bytes and the checksum of the empty text, and is grouped with
empty texts; repeated rows are placed as separate rows beside each other; rows with a null doc_id
are placed too; an empty table gives an empty result; other columns are kept by shard().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, text_of

SHARDS = 40
#: Bound of what reaches the driver, and of the table that is broadcast: so many units.
UNITS = 65_536
#: Parts of a shard within which rows are numbered; offsets of SHARDS * PARTS parts make them gapless.
PARTS = 512
OVERHEAD = 16


def _needed(sizes: list[int], capacity: int) -> int:
    """Shards that a greedy pass fills."""
    shards, room = 0, 0
    for size in sizes:
        if size > room:
            shards, room = shards + 1, capacity
        room -= size
    return shards


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """The shard of each of the ordered sizes, numbered from 0."""
    out, alone = [], 0
    total = sum(sizes)
    while alone < len(sizes) and alone < shards - 1 and sizes[alone] * (shards - alone) > total:
        total -= sizes[alone]
        out.append(alone)
        alone += 1
    rest, left = sizes[alone:], shards - alone
    low, high = max([1, *rest, -(-total // left)]), max(1, total)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _needed(rest, middle) <= left else (middle + 1, high)
    shard, room = alone, low
    for size in rest:
        if size > room:
            shard, room = shard + 1, low
        room -= size
        out.append(shard)
    return out


def digest(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(F.xxhash64(text), F.lit(UNITS)).cast("int").alias("unit"))


def place(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds shard and slot to rows that have doc_id, size, text_crc32 and unit."""
    spark = rows.sparkSession
    units = sorted(((r["size"], r["unit"]) for r in rows.groupBy("unit").agg(F.sum("size").alias("size")).collect()), key=lambda u: (-u[0], u[1]))
    cuts = minimax_cuts([size for size, _ in units], shards)
    plan = spark.createDataFrame([(unit, shard) for (_, unit), shard in zip(units, cuts, strict=True)], "unit int, shard int")
    placed = rows.join(F.broadcast(plan), "unit").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(PARTS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return placed.withColumn("slot", F.row_number().over(within)).join(F.broadcast(offsets), ["shard", "part"]).withColumn("slot", F.col("offset") + F.col("slot") - 1).drop("offset", "part")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    placed = place(cut(digest(docs), "digest"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
