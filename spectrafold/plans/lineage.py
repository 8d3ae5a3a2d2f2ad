"""Tables written in the folder that driver and executors share, so that what comes after is computed from files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table is broadcast only if its rows, counted, keep to this.
BROADCAST_BYTES = 32 << 20


def small(table: DataFrame, row_bytes: int = 128) -> DataFrame:
    """The table, marked for broadcast if it is small, by its number of rows of so many bytes at most; else Spark chooses."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


#: Spark's setting by which an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back. The folder is spark.checkpoint.dir; a temporary one only where that is unset and one machine does all."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    path, was = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, "false")
    # What comes after reads the files, so the shuffle files that made them may go.
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)
