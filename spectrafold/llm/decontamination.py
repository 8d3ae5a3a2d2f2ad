"""Benchmark decontamination by spaced seeds.

A mask picks some words of a run and ignores the others. The hashes of what the masks pick, at
every word of every document and of every benchmark item, are joined; a hit names a document, an
item and their alignment. Around a hit the overlap is verified word by word: some PASSAGE
consecutive words of the item must agree with the document's, aligned, up to the allowed substitutions.
Every two substitutions in 13 words leave one of the two masks a place free of them. An item of fewer
words than PASSAGE has masks of its own length: with s substitutions allowed, its words are dealt over
s + 2 parts and each mask picks two of them, as two are always free of substitutions (all its words, if
none is allowed). So no passage within the limits is missed. Words are compared in lower case. Documents
are probed only with the masks of lengths that the benchmark has.

All is built of Spark expressions. The item side is broadcast only if it is measured to be small,
and so is the list of documents that were hit.

Defined results: null, empty and blank texts have no words and match nothing; an item of fewer
words than PASSAGE is compared as a whole; words that would lie beyond a document's ends count as substituted, so
start may be negative; several rows of one item_id are several items; repeated rows of documents give equal pairs once; null doc_ids
are reported as null; an empty table gives an empty result; remove_leaks() keeps all columns.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, keyed, with_small, words_of

MASKS = ("11010111", "111001011")
PASSAGE = 13
#: Of the passage's words, in percent, as many must agree.
AGREE = 80


def _words(text: str) -> Column:
    return words_of(F.lower(F.coalesce(F.col(text), F.lit(""))))


def short_masks(length: int) -> list[str]:
    """Masks of an item of so many words, fewer than PASSAGE: one picks no word that is substituted, whichever are."""
    allowed = _allowed(length)
    if not allowed:
        return ["1" * length]
    part = [i * (allowed + 2) // length for i in range(length)]
    return ["".join("01"[p in two] for p in part) for two in combinations(range(allowed + 2), 2)]


def _allowed(length: int) -> int:
    return length * (100 - AGREE) // 100


def _masked(words: str, mask: str, salt: str, low: Column, last: Column) -> Column:
    """(position, hash) of what the mask picks at the positions from low to last."""
    picked = [i for i, bit in enumerate(mask) if bit == "1"]
    at = lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(salt), *(F.get(words, i + k) for k in picked)).alias("seed"))
    return F.when(last >= low, F.transform(F.sequence(low, last), at)).otherwise(F.array().cast("array<struct<at:int,seed:bigint>>"))


def _long_seeds(words: str) -> list[Column]:
    """All (position, hash) pairs of an array column, mask by mask."""
    return [_masked(words, m, m, F.lit(0), F.size(words) - len(m)) for m in MASKS]


def _short_seeds(words: str, length: int, over: int) -> list[Column]:
    """The same by the masks of items of so many words, from over words before the first to over after the last."""
    return [_masked(words, m, f"{length} {m}", F.lit(-over), F.size(words) - length + over) for m in short_masks(length)]


def _item_seeds(words: str) -> Column:
    none = F.array().cast("array<struct<at:int,seed:bigint>>")
    short = [F.when(F.size(words) == n, F.concat(*_short_seeds(words, n, 0))).otherwise(none) for n in range(1, PASSAGE)]
    return F.concat(F.when(F.size(words) >= PASSAGE, F.concat(*_long_seeds(words))).otherwise(none), *short)


def _document_seeds(words: str, lengths: list[int]) -> Column:
    """Those that items of the lengths, PASSAGE for it and more, may share."""
    return F.concat(*(s for n in lengths for s in (_short_seeds(words, n, _allowed(n)) if n < PASSAGE else _long_seeds(words))))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, _id, _key, item_id, agreed (words of the best passage), passage (its length), start (its place in the document)."""
    rows = keyed(docs).select("doc_id", "_id", "_key", "text").withColumn("words", _words("text")).drop("text")
    items = cut(benchmark.select("item_id", F.col("text").cast("string").alias("text")).withColumn("item_words", _words("text")).select(F.monotonically_increasing_id().alias("item"), "item_id", "item_words"), "items")
    item_seeds = cut(items.select("item", F.explode(_item_seeds("item_words")).alias("s")).select("item", F.col("s.at").alias("item_at"), F.col("s.seed").alias("seed")), "item-seeds")
    lengths = sorted(r["n"] for r in items.select(F.least(F.size("item_words"), F.lit(PASSAGE)).alias("n")).where("n > 0").distinct().collect()) or [PASSAGE]
    placed = rows.select("_id", "_key", F.explode(_document_seeds("words", lengths)).alias("s")).select("_id", "_key", F.col("s.at").alias("at"), F.col("s.seed").alias("seed"))
    hits = with_small(placed, item_seeds, ["seed"], 48).select("_id", "_key", "item", (F.col("at") - F.col("item_at")).alias("shift"))
    hits = cut(hits.groupBy("_id", "_key").agg(F.collect_set(F.struct("item", "shift")).alias("hits")), "hits")
    found = with_small(rows, hits, ["_id", "_key"], F.size("hits") * 24 + 64).withColumn("hit", F.explode("hits")).select("doc_id", "_id", "_key", "words", "hit.item", "hit.shift")
    aligned = with_small(found, items, ["item"], F.size("item_words") * 24 + 64)
    length = F.least(F.size("item_words"), F.lit(PASSAGE))
    agrees = F.transform("item_words", lambda w, i: F.coalesce(F.when(i + F.col("shift") >= 0, (F.get("words", i + F.col("shift")) == w).cast("int")), F.lit(0)))
    passages = F.transform(F.sequence(F.lit(1), F.size("item_words") - F.col("passage") + 1), lambda s: F.struct(F.aggregate(F.slice("agrees", s, F.col("passage")), F.lit(0), lambda a, b: a + b).alias("agreed"), (-s).alias("at")))
    best = aligned.withColumn("passage", length).withColumn("agrees", agrees).withColumn("best", F.array_max(passages)).where(100 * F.col("best.agreed") >= AGREE * F.col("passage"))
    each = best.select("doc_id", "_id", "_key", "item_id", "passage", F.struct(F.col("best.agreed").alias("agreed"), (F.col("shift") - F.col("best.at") - 1).alias("start")).alias("found"))
    once = each.groupBy("doc_id", "_id", "_key", "item_id").agg(F.max("found").alias("found"), F.max("passage").alias("passage"))
    return once.select("doc_id", "_id", "_key", "item_id", "found.agreed", "passage", "found.start")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that hold no passage of the benchmark."""
    found = cut(leaks(docs, benchmark).select("_id", "_key").distinct(), "leaks")
    return with_small(keyed(docs).select("_row", "_id", "_key"), found, ["_id", "_key"], 64, "left_anti").select("_row.*")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, benchmark).select("doc_id", "item_id", F.col("agreed").cast("long").alias("agreed"), F.col("start").cast("long").alias("start"))
