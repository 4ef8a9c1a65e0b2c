"""Partitioned and Z-ordered Parquet, manifests of files, and tables over existing files."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.scalars import hex_to_long, morton, path_pairs
from lodeweave.sources.storage import located, open_store, remove

GEO_KEYS = {"category": "unknown", "tag": "unknown", "country_code": "unknown", "h3_cell": "unknown"}
DATE_KEYS = {"year": 0, "month": 0, "day": 0, "h3_cell": "unknown"}
FILE_KEYS = {"id": "unknown", "name": "unknown", "category": "unknown", "value": "unknown"}
FLUSH_ROWS = 2_000_000


def keyed(df: DataFrame, keys: dict[str, str | int]) -> DataFrame:
    """df with nulls of the keys replaced by their sentinels; a literal sentinel and null are one key. Text sentinels make the key text."""
    return df.withColumns({k: F.coalesce(F.col(k).cast("string") if isinstance(v, str) else F.col(k), F.lit(v)) for k, v in keys.items()})


def partition_counts(df: DataFrame, keys: dict[str, str | int]) -> DataFrame:
    """Rows of each partition key."""
    return keyed(df.select(*keys), keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def partitioned(df: DataFrame, keys: dict[str, str | int], salts: int = 1) -> DataFrame:
    """df with its keys filled, dealt by key; a hot key goes to `salts` tasks."""
    out = keyed(df, keys)
    return out.repartition(*keys, *([F.pmod(F.xxhash64(*df.columns), F.lit(salts))] if salts > 1 else []))


def write_parquet(df: DataFrame, path: str, version: str = "v1", mode: str = "overwrite") -> None:
    """Snappy Parquet; version v2 writes pages and encodings of format 2."""
    df.write.mode(mode).option("compression", "snappy").option("parquet.writer.version", version).parquet(path)


def write_partitioned(df: DataFrame, path: str, keys: dict[str, str | int], max_rows: int = FLUSH_ROWS, keep_keys: bool = False, salts: int = 1, mode: str = "overwrite") -> None:
    """Hive-style folders by key, files of at most max_rows rows. keep_keys: the files hold the key columns too, under `{key}_col`."""
    out = partitioned(df, keys, salts)
    if keep_keys:
        out = out.withColumns({f"{k}_col": F.col(k) for k in keys})
    out.write.mode(mode).option("compression", "snappy").option("maxRecordsPerFile", max_rows).partitionBy(*keys).parquet(path)


def write_cells(df: DataFrame, path: str, cell: str = "h3_res3", folder: str = "h3", mode: str = "overwrite") -> None:
    """One folder per cell in one job; the cell stays a column of the files."""
    df.withColumn(folder, F.col(cell)).repartition(folder).write.mode(mode).partitionBy(folder).parquet(path)


def write_key_files(df: DataFrame, base: str, keys: dict[str, str | int]) -> DataFrame:
    """One file for each key, at `partition_path`; return a frame of path and rows of all files.

    Rows are dealt and sorted by key and streamed into Parquet of pages v2 with statistics, so a key of any size
    is never gathered. A file gets its name once it is whole: a repeated or lost attempt changes nothing.
    """
    rows = df.withColumn("_path", partition_path(keys))
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_store(base)
        now = writer = part = None
        n, made = 0, []

        def close():
            if writer is not None:
                writer.close()
                system.move(part, f"{root}/{now}")
                made.append((now, n))

        for batch in batches:
            paths = batch.column(len(columns)).to_pylist()
            own = batch.select(columns)
            at = 0
            while at < len(paths):
                upto = at
                while upto < len(paths) and paths[upto] == paths[at]:
                    upto += 1
                if paths[at] != now:
                    close()
                    now, n = paths[at], 0
                    system.create_dir(f"{root}/{now.rpartition('/')[0]}", recursive=True)
                    part = f"{root}/{now}.{uuid.uuid4().hex}"
                    writer = pq.ParquetWriter(part, own.schema, filesystem=system, compression="snappy", version="2.6", data_page_version="2.0", write_statistics=True)
                writer.write_batch(own.slice(at, upto - at))
                n += upto - at
                at = upto
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["path", "rows"])

    listed = f"{base.rstrip('/')}/_files"
    rows.repartition("_path").sortWithinPartitions("_path").mapInArrow(run, "path string, rows long").write.mode("overwrite").parquet(listed)
    return df.sparkSession.read.parquet(listed)


def partition_path(keys: dict[str, str | int]) -> Column:
    """The path of a row's file below the base: folders of all keys but the last, whose value is the file's name."""
    *folders, last = keys
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit(str(keys[k])))) for k in folders]
    return F.concat_ws("/", *parts, F.concat(F.lit(f"{last}="), F.coalesce(F.col(last).cast("string"), F.lit(str(keys[last]))), F.lit(".parquet")))


def cell_bits(cell: Column, high: bool = True) -> Column:
    """16 bits of a cell's index: base cell and three digits (high), or the lowest (which are constant at resolution 3).

    Text that is no index gives the low bits of its hash.
    """
    index = hex_to_long(cell)
    bits = F.shiftright(index, 36) if high else index
    return F.coalesce(bits, F.xxhash64(cell)).bitwiseAND(F.lit(0xFFFF))


def morton_ref(cell: Column, date_id: Column) -> Column:
    """Morton key of the low bits of the cell's index and of date_id; 16 bits of each count."""
    return morton(date_id, cell_bits(cell, high=False))


def morton_cell(cell: Column, day: Column) -> Column:
    """Morton key of the cell's leading bits and the days since 1970: tells cells of resolution 3 and days apart."""
    return morton(F.unix_date(day.cast("date")), cell_bits(cell))


def zorder(df: DataFrame, key: Column, partitions: int | None = None) -> DataFrame:
    """df with z_key, in ranges of it, each sorted. A range's minima and maxima let readers skip files."""
    out = df.withColumn("z_key", key)
    out = out.repartitionByRange(partitions, "z_key") if partitions else out.repartitionByRange("z_key")
    return out.sortWithinPartitions("z_key")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, partition_values (map), modification_time (ms), data_change (false) of the Parquet files below path.

    Folders that start with _ or . are passed over; contents are not read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    hidden = F.col("path").rlike(r"/[_.][^/]*/")
    return found.where(~hidden).select("path", F.col("length").alias("size"), path_pairs(F.col("path")).alias("partition_values"), F.unix_millis("modificationTime").alias("modification_time"), F.lit(False).alias("data_change"))


def zorder_rewrite(spark: SparkSession, source: str, target: str, cell: str = "h3_res3", day: str = "date_id", partitions: int | None = None) -> dict[str, int]:
    """Write source's rows to target along the Z-order; the numbers of files read and written."""
    df = spark.read.parquet(source)
    zorder(df, morton_cell(F.col(cell), F.col(day)), partitions).drop("z_key").write.mode("overwrite").parquet(target)
    return {"files_removed": files(spark, source).count(), "files_added": files(spark, target).count()}


def create_log(spark: SparkSession, path: str, keys: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Version 0 of a transaction log over existing Parquet files: protocol, metadata with the schema of the files and
    their folders, and an Add action for each file. Return the Add actions.

    The log is one file by its format; its actions are made by Spark and written by one task as a stream.
    """
    root = path.rstrip("/")
    schema = spark.read.option("basePath", root).parquet(root).schema
    missing = sorted(set(keys) - set(schema.names))
    if missing:
        raise ValueError(f"not among the folders: {', '.join(missing)}")
    system, where = located(spark, root)
    prefix = system.makeQualified(where).toString() + "/"
    listed = files(spark, root)
    relative = F.regexp_replace(F.regexp_replace("path", r"^([a-z0-9]+):/+", "$1:/"), "^" + re.escape(re.sub(r"^([a-z0-9]+):/+", r"\1:/", prefix)), "")
    held = F.map_filter("partition_values", lambda k, _: k.isin(*keys)) if keys else F.create_map().cast("map<string,string>")
    adds = listed.select(relative.alias("path"), held.alias("partitionValues"), "size", F.col("modification_time").alias("modificationTime"), F.col("data_change").alias("dataChange"))
    head = [
        {"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}},
        {"metaData": {"id": str(uuid.uuid4()), **({"name": name} if name else {}), "format": {"provider": "parquet", "options": {}}, "schemaString": schema.json(), "partitionColumns": list(keys), "configuration": {}}},
    ]
    lines = adds.select(F.lit(1).alias("part"), F.to_json(F.struct(F.struct(*adds.columns).alias("add"))).alias("value"))
    first = spark.createDataFrame([(0, json.dumps(h)) for h in head], "part int, value string")
    made = f"{root}/_delta_log/_made-{uuid.uuid4().hex}"
    first.unionByName(lines).coalesce(1).sortWithinPartitions("part").select("value").write.text(made)
    system, _ = located(spark, made)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    (part,) = [f.getPath() for f in system.listStatus(path_of(made)) if f.getPath().getName().startswith("part-")]
    target = path_of(f"{root}/_delta_log/{0:020d}.json")
    if system.exists(target):
        remove(spark, made)
        raise FileExistsError(f"{target} is there already")
    system.rename(part, target)
    remove(spark, made)
    return spark.read.json(target.toString()).where("add IS NOT NULL").select("add.*")


def create_table(spark: SparkSession, name: str, path: str, keys: Sequence[str] = ()) -> None:
    """A table over existing Parquet files: by the Delta package where it is installed, else an external one with its
    partitions and, as version 0 of its log, `create_log`'s."""
    try:
        import delta  # noqa: F401
    except ImportError:
        schema = spark.read.parquet(path).schema
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({kinds}) USING parquet {f'PARTITIONED BY ({", ".join(keys)})' if keys else ''} LOCATION '{path}'")
        if keys:
            spark.sql(f"MSCK REPAIR TABLE {name}")
        create_log(spark, path, keys, name)
    else:
        kinds = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema.fields}
        spark.sql(f"CONVERT TO DELTA parquet.`{path}` {f'PARTITIONED BY ({", ".join(f"{k} {kinds[k]}" for k in keys)})' if keys else ''}")
        spark.sql(f"CREATE TABLE {name} USING delta LOCATION '{path}'")
