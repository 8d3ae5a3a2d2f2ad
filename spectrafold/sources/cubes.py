"""Adapters: tables as cubes in long form, one row a cell: ch, time, epoch, x. Absent cells are missing."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: ch = type, time = day, epoch = user, x = mean value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "user_id", "ts", "value")
    day = F.date_diff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return events.groupBy(F.col("event_type").alias("ch"), day.alias("time"), F.col("user_id").alias("epoch")).agg(F.avg("value").alias("x"))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: feat = position, epoch = vec_id, x, y = 1 for an even label else -1."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    y = F.when(F.col("label") % 2 == 0, 1).otherwise(-1).alias("y")
    return rows.select(F.col("vec_id").alias("epoch"), "label", y, F.posexplode("embedding").alias("feat", "v")).select("epoch", "label", "y", "feat", F.col("v").cast("double").alias("x"))
