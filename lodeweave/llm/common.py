"""Reading tables, content keys, lineage cuts and storage shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.sources.storage import remove, remove_at_exit, shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to a table in the shared folder and read again: lineage ends here, and later plans know the size.

    Its files go with `release`, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    folder = f"{shared_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    remove_at_exit(spark, folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out.folder = folder
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Like `cut`, dealt by a hash of the key to as many buckets as shuffles have partitions: joins on the key move only the other side."""
    spark = df.sparkSession
    name = f"lodeweave_{uuid.uuid4().hex}"
    folder = f"{shared_root(spark)}/{name}"
    df.write.bucketBy(partitions(spark), key).option("path", folder).saveAsTable(name, format="parquet")
    remove_at_exit(spark, folder)
    out = spark.table(name)
    out.folder, out.table_name = folder, name
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a frame from `cut` or `bucketed` that nothing will read again."""
    if hasattr(df, "table_name"):
        df.sparkSession.sql(f"DROP TABLE {df.table_name}")
    remove(df.sparkSession, df.folder)


def spare(*wanted: str, taken: list[str]) -> list[str]:
    """Names for helper columns that no column in `taken` has (in any case): each wanted one, with underscores added as needed."""
    held, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def text_bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def text_key(text: Column) -> Column:
    """First 16 bytes of SHA-256 of the text (null: empty). Rows of equal text share it."""
    return F.substring(F.unhex(F.sha2(text_bytes(text), 256)), 1, 16)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id has the fold of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
