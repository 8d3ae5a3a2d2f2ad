"""The shared folder, cut lineage, and the word expression that the operators have in common."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: space and \t \n \v \f \r.
BLANK = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names one.

    Only where it is unset, as in tests on one machine, a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder once and read it back, so lost executors cost no recomputation.

    What comes after reads the files, so the shuffle files that made them are removed.
    """
    spark = df.sparkSession
    path, was = new_folder(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    found = spark.read.schema(df.schema).parquet(path)
    found.cut_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Remove tables that cut() wrote and that nothing reads any more: what was made of them is written itself."""
    for table in tables:
        if written := getattr(table, "cut_path", None):
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's setting by which a join on several keys deals both sides by all of them, though they lie together by fewer.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def joins_as_dealt(spark: SparkSession) -> Iterator[None]:
    """Within, joins of tables dealt alike by some of the keys leave them where they are."""
    was = spark.conf.get(ALL_KEYS, "true")
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, was)


def open_shared(path: str, mode: str):
    """A binary file in the shared folder, opened on the driver or an executor."""
    if re.match(r"file:|/", path):
        local = re.sub(r"^file:/*", "/", path)
        if "w" in mode:
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_output_stream(at) if "w" in mode else store.open_input_file(at)


#: A side of a join is broadcast only if its rows, of so many bytes each at most, stay within this.
BROADCAST_BYTES = 32 << 20


def with_small(big: DataFrame, small: DataFrame, on: list[str], row_bytes: Column | int, how: str = "inner") -> DataFrame:
    """A join that spares big a shuffle if small, which is measured, may be broadcast; else Spark chooses."""
    measured = small.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return big.join(F.broadcast(small) if measured <= BROADCAST_BYTES else small, on, how)


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text that isn't null."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


#: Tells rows of one doc_id apart by text, null doc_ids and null texts included.
def row_key() -> Column:
    return F.xxhash64("text", F.isnull("text"), F.isnull("doc_id"))


def keyed(docs: DataFrame) -> DataFrame:
    """_row (all columns of docs), doc_id, text, and _id, _key that are never null: equal for equal rows only."""
    return docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_key": row_key()})


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that what a task makes of a part stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8_words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text in UTF-8: bytes split at ASCII white space alone."""
    return text.split() if text else []


def lower_utf8_words(text: bytes | None) -> list[bytes]:
    """The same with A-Z lowered and nothing else."""
    return text.lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words; emptied when it holds MOST words, so memory is bounded."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Iterable[bytes], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of each run of length words, from 64-bit word hashes: a polynomial, doubled up, then mixed."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, done, total, at = np.uint64(base | 1), 0, np.zeros(n, np.uint64), words
    span, factor = 1, power
    with np.errstate(over="ignore"):
        while True:
            if length & span:
                total = total * factor + at[done : done + n]
                done += span
            if span * 2 > length:
                break
            at = at[: len(at) - span] * factor + at[span:]
            span, factor = span * 2, factor * factor
        return mix64(total)
