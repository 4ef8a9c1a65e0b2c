"""Streams of observations: hourly sums and sessions, bounded by watermarks.

An addition: the batch operators have no streaming counterpart to match. A stream gives the same hourly
sums that the pivot of a batch would, for rows that come in time, and sessions that end after a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly_signals(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """h3_res3, timestamp (hour), measurement_type, signal (sum), n: rows later than `late` are left out."""
    marked = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    sums = marked.groupBy("h3_res3", F.window("timestamp", "1 hour"), "measurement_type").agg(F.sum("signal_weight").alias("signal"), F.count(F.lit(1)).alias("n"))
    return sums.select("h3_res3", F.col("window.start").alias("timestamp"), "measurement_type", "signal", "n")


def sessions(stream: DataFrame, gap: str = "2 hours", late: str = "2 hours") -> DataFrame:
    """h3_cell, start, end, n: runs of rows of a cell with gaps under `gap`."""
    marked = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    runs = marked.groupBy("h3_cell", F.session_window("timestamp", gap)).agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("end"))
    return runs.select("h3_cell", F.col("session_window.start").alias("start"), "end", "n")
