"""The run that a settings file describes: XML of all its folders to partitioned flat Parquet and a table log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeweave.operators import flatten, layout
from lodeweave.sources import config, xml

KEYS = {"category": "unknown"}


def run(spark: SparkSession, settings: config.EtlConfig, target: str, keys: dict[str, str | int] = KEYS) -> DataFrame:
    """Read the XML files (gzipped ones too) of every folder in data_dirs, flatten, write by key; the table's files.

    All folders are one scan: the scheduler runs as many files at once as there are task slots, whatever folder they are in.
    """
    rows = flatten.partial_cartesian(xml.read_xml(spark, settings.data_dirs))
    layout.write_partitioned(rows, target, keys)
    return layout.create_log(spark, target, tuple(keys))
