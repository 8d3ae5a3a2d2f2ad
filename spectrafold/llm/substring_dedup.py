"""Substring dedup: a relative Lempel-Ziv parse of each document against the indexed corpus.

The corpus is indexed in blocks by seed. Of the SEED-word runs within a window of WINDOW words the
one of least hash, the first of equals, is the window's seed, so equal windows have equal seeds
wherever they are, and about one position in thirteen is a seed. Seeds found once can hold no
repeated window and are left out. At each other place of a seed, its windows form a stretch of
consecutive starts. A stretch found more than once is known by one hash, whatever its copies; of
stretches that differ under one seed, one copy of each is told apart window by window. So every
block knows of every window whether it also starts elsewhere and at which place first.

A document is then parsed greedily: from a word where a repeated window starts, the factor grows as
long as the windows go on at the same source, and the next one is sought from its end. Each factor is WINDOW words at
least and becomes a duplicate span. At its end the index is asked for windows that begin in the factor and reach beyond it,
as they may be found at another source: what they cover is added to the span, so one of two sources leaves no gap.
What the spans cover is removed.

Windows are told apart by 128 bits, their seed's hash and their own; both are made of the same 64-bit hashes of words.

Defined results: a null, empty or blank text has no words and keeps the empty text; fewer than
WINDOW words keep all; repeated rows count as separate places, so all are removed where long enough;
null doc_ids are kept apart by text; an empty table gives an empty result; parse() keeps all
columns in _row, clashing names included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, cut, keyed, mix64, slices, utf8_words, window_hashes, with_small

WINDOW, SEED = 35, 12
#: Windows that a batch of results holds at least, unless its input ends.
BATCH = 500_000
OWN_BASE = 0xD6E8FEB86659FD93


def stretches(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the stretches of windows that share a seed's place, those seeds, and the number of windows."""
    grams, width = window_hashes(words, seed), window - seed + 1
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    place = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(n)
    start = np.flatnonzero(np.append(True, np.diff(place) > 0))
    return start, grams[place[start]], np.diff(np.append(start, n))


def index_seeds(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """_id, _key, seeds of each document that is as long as a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            ids, keys, found = [], [], []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())):
                words = utf8_words(text.as_py())
                if len(words) >= window:
                    ids.append(doc)
                    keys.append(key)
                    found.append(stretches(hashes.of(words, len(words)), window, seed)[1].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["_id", "_key", "seeds"])

    return rows.select("_id", "_key", "text").mapInArrow(run, "_id long, _key long, seeds array<long>")


def index_stretches(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """_id, _key, start, windows (their number), seed, own (hash of all), hashes (of each) where the seed is among the row's seeds."""
    names = ["_id", "_key", "start", "windows", "seed", "own", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        factor = np.cumprod(np.full(window, OWN_BASE, np.uint64))

        def done(parts: list) -> pa.RecordBatch:
            *plain, each = (np.concatenate(c) for c in zip(*parts))
            offsets = np.append(0, np.cumsum(plain[3])).astype(np.int32)
            return pa.RecordBatch.from_arrays([*map(pa.array, plain), pa.ListArray.from_arrays(offsets, each)], names)

        for batch in slices(batches):
            parts, held, repeated = [], 0, batch.column(3)
            for i, (doc, key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()))):
                words = utf8_words(text.as_py())
                ids = hashes.of(words, len(words))
                start, seeds, n = stretches(ids, window, seed)
                own = window_hashes(ids, window, OWN_BASE)
                within = np.arange(len(own)) - np.repeat(start, n)
                whole = mix64(np.add.reduceat(own * factor[within], start) + n.astype(np.uint64))
                hit = np.isin(seeds.view(np.int64), repeated[i].values.to_numpy(zero_copy_only=False))
                each = own[np.repeat(hit, n)].view(np.int64)
                k = int(hit.sum())
                parts.append((np.full(k, doc), np.full(k, key), start[hit].astype(np.int32), n[hit].astype(np.int32), seeds[hit].view(np.int64), whole[hit].view(np.int64), each))
                held += len(each)
                if held > BATCH:
                    yield done(parts)
                    parts, held = [], 0
            if parts:
                yield done(parts)

    return rows.select("_id", "_key", "text", "seeds").mapInArrow(run, "_id long, _key long, start int, windows int, seed long, own long, hashes array<long>")


def repeated_windows(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """_id, _key, start, windows, and source (its id, key and start): runs of repeated windows, each going on at its source."""
    indexed = cut(index_seeds(rows, window, seed), "seeds")
    more = indexed.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    places = indexed.select("_id", "_key", F.explode(F.array_distinct("seeds")).alias("seed"))
    hit = cut(places.join(more, "seed").groupBy("_id", "_key").agg(F.collect_list("seed").alias("seeds")), "hits")
    found = with_small(rows, hit, ["_id", "_key"], F.size("seeds") * 8 + 64)
    found = cut(index_stretches(found, window, seed), "stretches")
    place = F.struct(F.col("_id").alias("id"), F.col("_key").alias("key"), F.col("start").alias("at"))
    known = cut(found.groupBy("seed", "own").agg(F.count("*").alias("n"), F.min(place).alias("source"), F.first("hashes").alias("hashes")), "known")
    whole = found.drop("hashes").join(known.where("n > 1").select("seed", "own", "source"), ["seed", "own"]).select("_id", "_key", "start", "windows", "source")
    mixed = known.groupBy("seed").agg(F.count("*").alias("kinds")).where("kinds > 1").select("seed")
    window_place = F.struct("source.id", "source.key", (F.col("source.at") + F.col("pos")).alias("at")).alias("place")
    single = cut(known.join(mixed, "seed").select("seed", "n", "source", F.posexplode("hashes").alias("pos", "hash")).select("seed", "hash", "n", window_place), "windows")
    first = single.groupBy("seed", "hash").agg(F.count("*").alias("c"), F.min("place").alias("source")).where("c > 1").drop("c")
    part = single.where("n = 1").join(first, ["seed", "hash"]).select(F.col("place.id").alias("_id"), F.col("place.key").alias("_key"), F.col("place.at").alias("start"), F.lit(1).alias("windows"), "source")
    return whole.unionByName(part)


def greedy(runs: np.ndarray, window: int) -> tuple[list[dict], list[dict]]:
    """Factors of the greedy parse and the duplicate spans that they make. runs: rows of start, windows, source id, key and start, by start.

    Stretches follow each other without a gap, so runs that go on at the same source are one.
    """
    start, n, at = runs[:, 0], runs[:, 1], runs[:, 4]
    goes_on = (start[1:] == start[:-1] + n[:-1]) & (runs[1:, 2] == runs[:-1, 2]) & (runs[1:, 3] == runs[:-1, 3]) & (at[1:] == at[:-1] + n[:-1])
    first = np.append(0, np.flatnonzero(~goes_on) + 1)
    last = np.append(first[1:] - 1, len(runs) - 1)
    factors, spans, free = [], [], 0

    def duplicate(begin: int, end: int) -> None:
        if spans and begin <= spans[-1]["end"]:
            spans[-1]["end"] = max(end, spans[-1]["end"])
        else:
            spans.append({"start": begin, "end": end})

    for i, begin, final in zip(first, start[first].tolist(), (start[last] + n[last] - 1).tolist()):
        if begin < free:
            # At the boundary of the factor before: windows that begin in it.
            duplicate(begin, min(final, free - 1) + window)
        if final >= free:
            skipped = max(0, free - begin)
            factors.append({"start": begin + skipped, "length": final - begin - skipped + window, "source_id": int(runs[i, 2]), "source_start": int(at[i]) + skipped})
            free = factors[-1]["start"] + factors[-1]["length"]
            duplicate(factors[-1]["start"], free)
    return factors, spans


FACTORS, SPANS = "array<struct<start:int,length:int,source_id:long,source_start:int>>", "array<struct<start:int,end:int>>"


def factorised(runs: DataFrame, window: int) -> DataFrame:
    """_id, _key, factors, spans of each document that has any."""
    listed = runs.groupBy("_id", "_key").agg(F.sort_array(F.collect_list(F.struct("start", "windows", "source.id", "source.key", "source.at"))).alias("runs"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    factor = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            factors, spans = [], []
            for own in batch.column(2):
                table = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in own.values.flatten()], axis=1)
                # Equal rows give each place twice.
                f, s = greedy(table[np.append(True, np.diff(table[:, 0]) > 0)], window)
                factors.append(f)
                spans.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(factors, factor), pa.array(spans, span)], ["_id", "_key", "factors", "spans"])

    return listed.mapInArrow(run, f"_id long, _key long, factors {FACTORS}, spans {SPANS}")


def parse(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """_row, doc_id, n_words, n_removed, kept (text), factors, spans of each document."""
    rows = keyed(docs)
    found = cut(factorised(repeated_windows(rows, window, seed), window), "factors")
    joined = with_small(rows, found, ["_id", "_key"], F.size("factors") * 32 + F.size("spans") * 16 + 96, "left").select("_row", "doc_id", "factors", "spans", "text")
    names = ["_row", "doc_id", "factors", "spans", "n_words", "n_removed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            for spans, text in zip(batch.column(3), batch.column(4).cast(pa.large_binary())):
                words, out, at = utf8_words(text.as_py()), [], 0
                for span in spans.as_py() or ():
                    out += words[at : span["start"]]
                    at = span["end"]
                out += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(out))
                kept.append(b" ".join(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names)

    return joined.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, doc_id long, factors {FACTORS}, spans {SPANS}, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return parse(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
