"""Parquet inputs: folders, single cells, and prediction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.scalars import parse_time_strict
from lodeweave.sources.schemas import PREDICTIONS


def scan(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """Parquet files below one or more folders."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.option("recursiveFileLookup", recursive).parquet(*paths)


def cell(spark: SparkSession, path: str, cell_id: str, folder: str = "h3") -> DataFrame:
    """One cell's rows of a table in folders by cell: a filter on the partition column, so only that folder is read."""
    return spark.read.parquet(path).where(F.col(folder) == cell_id)


def schema_of(spark: SparkSession, sample: str):
    """The schema of one sample file."""
    return spark.read.parquet(sample).schema


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def predictions(spark: SparkSession, path: str, parse: bool = False) -> DataFrame:
    """The four columns of a prediction file. parse: the timestamp is text."""
    return as_predictions(spark.read.parquet(path), parse)


def as_predictions(df: DataFrame, parse: bool = False) -> DataFrame:
    rows = require(df, PREDICTIONS).select(*PREDICTIONS)
    time = parse_time_strict(F.col("timestamp")) if parse else F.col("timestamp").cast("timestamp_ntz")
    return rows.withColumn("timestamp", time)
