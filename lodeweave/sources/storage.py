"""Files in any store that Spark reaches: shared folders, small texts, and file systems for Arrow writers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

_kept_until_exit: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master, as in
    tests, gets a temporary one; on a cluster it must be set, as a folder of one machine would lose rows."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.match(r"local($|\[)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodeweave-"))
    return context.getCheckpointDir().rstrip("/")


def located(spark: SparkSession, path: str):
    """The Hadoop file system and path of a path or URI."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    system, found = located(spark, path)
    system.delete(found, True)


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Delete a folder when the driver's JVM ends; lazy frames may read it until then."""
    if folder not in _kept_until_exit:
        _kept_until_exit.add(folder)
        system, found = located(spark, folder)
        system.mkdirs(found)
        system.deleteOnExit(found)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's name below the shared one; the folder goes when the driver's JVM ends."""
    folder = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    return folder


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file."""
    system, found = located(spark, path)
    out = system.create(found, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a URI, for writers and readers on executors."""
    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")
