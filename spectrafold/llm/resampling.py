"""Importance resampling towards a target corpus: hashed word runs, counted by an external sort, gains gathered by document.

Each task packs the buckets of its documents' features, one after the other, into a file of unsigned 16-bit numbers with the
documents' offsets behind them, sorts the stream of a block and run-length encodes it; the runs' lengths, summed by bucket,
are the corpus counts. A bucket's gain is a function of the counts of both corpora, and the table of gains has as many entries
as there are buckets. A second pass maps the files, takes the gain of each feature and adds them up between offsets.
The draw is the head of a global range sort by falling score and doc_id; a row's rank is its place in its range and
the number of rows in the ranges before.

A task names its file after itself and its attempt and returns the name with the counts; what it returned, written as a table,
is the manifest, so files of failed or repeated attempts are never read.

Defined results: a null or empty text has no features, the weight 0 and no rank; a null doc_id counts as the empty text in the
noise and comes first among equal scores; repeated rows are drawn apart, beside each other; with an empty target every bucket's
t is 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, new_folder, open_shared, slices

BUCKETS = 10_000
#: A document takes part in the draw with so many words.
LEAST_WORDS = 20
SEED = 7
#: Percent of the documents that take part.
DRAWN = 25
#: Features of a file; the next one is begun beyond.
FILE_FEATURES = 1 << 26
#: Features that are sorted at a time.
BLOCK_FEATURES = 1 << 22

#: A-Z become a-z, digits and a-z stay, every other ASCII byte parts words, and so the bytes of other code points stay as well.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def features(text: bytes | None, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The bucket of each run of one or two words, uint16, and the number of words."""
    words = text.translate(WORD_BYTES).split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint16), 0
    found = np.empty(2 * n - 1, np.uint32)
    single = list(map(zlib.crc32, words))
    found[:n] = single
    # The checksum of a pair goes on from that of its first word.
    found[n:] = list(map(zlib.crc32, [b" " + w for w in words[1:]], single))
    return (found % buckets).astype(np.uint16), n


class BucketFile:
    """A packed stream of buckets, and behind it where each document's begin: (place, features, words) as int64, then their number."""

    def __init__(self, out):
        self.out, self.rows, self.at, self.held, self.block = out, [], 0, [], 0
        self.counts = np.zeros(BUCKETS, np.int64)

    def add(self, buckets: np.ndarray, n_words: int) -> None:
        self.rows.append((self.at, len(buckets), n_words))
        self.at += len(buckets)
        self.block += len(buckets)
        self.held.append(buckets)
        if self.block >= BLOCK_FEATURES:
            self.flush()

    def flush(self) -> None:
        """One sorted run: its values and the lengths between its changes."""
        if not self.held:
            return
        stream = np.concatenate(self.held)
        self.out.write(stream.astype("<u2").tobytes())
        if len(stream):
            stream.sort(kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], stream[1:] != stream[:-1])))
            self.counts[stream[starts]] += np.diff(np.append(starts, len(stream)))
        self.held, self.block = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(np.array(self.rows, "<i8").tobytes() + struct.pack("<q", len(self.rows)))
        self.out.close()


def write_streams(docs: DataFrame, folder: str) -> DataFrame:
    """The manifest: path, ids of its documents in order, counts by bucket (one row a file)."""
    names, types = ["path", "ids", "buckets", "counts"], (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None

        def done() -> pa.RecordBatch:
            out.close()
            some = np.flatnonzero(out.counts)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, ids, some, out.counts[some]), types)], names)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    path, ids = f"{folder}/buckets-{uuid.uuid4().hex}.u16", []
                    out = BucketFile(open_shared(path, "wb"))
                # The text's buffer, without decoding.
                out.add(*features(text.as_buffer().to_pybytes() if text.is_valid else None))
                ids.append(doc_id)
                if out.at >= FILE_FEATURES or len(ids) >= 1 << 20:
                    yield done()
                    out = None
        if out:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return cut(rows.mapInArrow(run, "path string, ids array<long>, buckets array<int>, counts array<long>"), "streams")


def counts(manifest: DataFrame) -> np.ndarray:
    """Features by bucket; what reaches the driver has as many rows as there are buckets."""
    found = np.zeros(BUCKETS, np.int64)
    each = manifest.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n"))
    for bucket, n in each.collect():
        found[bucket] = n
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weights(manifest: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document, from the files."""
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                with open_shared(path, "rb") as source:
                    end = source.seek(0, 2) - 8
                    source.seek(end)
                    n = struct.unpack("<q", source.read(8))[0]
                    source.seek(end - 24 * n)
                    at, size, words = np.frombuffer(source.read(24 * n), "<i8").reshape(n, 3).T
                    weight, first = np.zeros(n, np.int64), 0
                    while first < n:
                        # Whole documents of about a block.
                        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_FEATURES)))
                        source.seek(2 * int(at[first]))
                        stream = np.frombuffer(source.read(2 * int(size[first:last].sum())), "<u2")
                        full = first + np.flatnonzero(size[first:last])
                        if len(full):
                            weight[full] = np.floor_divide(np.add.reduceat(gain[stream], at[full] - at[first]), size[full])
                        first = last
                for k in range(0, n, 10_000):
                    yield pa.RecordBatch.from_arrays([ids.values.slice(k, min(10_000, n - k)), *(pa.array(x[k : k + 10_000]) for x in (words, size, weight))], names)

    return manifest.select("path", "ids").repartition(max(1, manifest.count()), "path").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null where it isn't drawn. target: its text."""
    spark = docs.sparkSession
    folder = new_folder(spark, "buckets")
    manifest = write_streams(docs, folder)
    wanted = write_streams(target.select(F.lit(0).alias("doc_id"), "text"), folder)
    unit = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    score = (F.col("weight") + F.floor(-1000 * F.log(-F.log(unit)))).cast("long")
    scored = cut(weights(manifest, gains(counts(manifest), counts(wanted))).withColumn("score", score), "scored")
    fits = scored.where(F.col("n_words") >= LEAST_WORDS)
    drawn = DRAWN * fits.count() // 100
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("n_words")]
    # The number within its partition is in the low 33 bits, the partition's above.
    placed = cut(fits.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)
    # One row for each partition.
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    before, so_far = [], 0
    for p, n in sorted(sizes):
        before.append((p, so_far))
        so_far += n
    offsets = spark.createDataFrame(before, "part long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < LEAST_WORDS).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
