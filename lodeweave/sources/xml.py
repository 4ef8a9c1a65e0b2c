"""Nested records from XML, typed.

All leaves are read as arrays of strings and cast afterwards: a number that does not parse vanishes
from its list and spoils nothing else. Repeated wrapper blocks are concatenated. Of repeated children of
a reading the last (that parses) wins. Records and readings with nothing in them go unless `keep_empty`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.scalars import to_double, to_int
from lodeweave.sources.schemas import RECORD_XML


def read_xml(spark: SparkSession, path: str | list[str], mode: str = "PERMISSIVE", keep_empty: bool = False) -> DataFrame:
    """Records of XML files, gzipped ones and whole folders too. mode FAILFAST: malformed XML is an error.

    A gzipped file is one task; spread the records with repartition() before costly steps.
    """
    raw = spark.read.format("xml").option("rowTag", "record").option("mode", mode).option("ignoreSurroundingSpaces", "true").schema(RECORD_XML).load(path)
    return normalised(raw, keep_empty)


def parse_xml(df: DataFrame, column: str, keep_empty: bool = False) -> DataFrame:
    """Records of a column with one `<record>` document a row; other columns stay."""
    parsed = F.from_xml(F.col(column), RECORD_XML, {"rowTag": "record"})
    return normalised(df.select(*[c for c in df.columns if c != column], _once(parsed)), keep_empty)


def _once(struct: Column) -> Column:
    """The fields of a struct as columns. A generator stands between it and what uses them, so that it is computed once a row."""
    return F.inline(F.array(struct))


def _texts(array: Column) -> Column:
    return F.filter(F.transform(array, lambda x: F.trim(x)), lambda x: x.isNotNull())


def _parsed(array: Column, parse) -> Column:
    return F.filter(F.transform(array, lambda x: parse(x)), lambda x: x.isNotNull())


def _inside(wrapper: str, leaf: str) -> Column:
    """All leaves of all wrapper blocks, in order; null without a block."""
    blocks = F.filter(F.col(wrapper), lambda b: b.isNotNull() & b[leaf].isNotNull())
    return F.flatten(F.transform(blocks, lambda b: b[leaf]))


def _last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def _or_null(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def normalised(raw: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Typed columns of RECORD from the string arrays of RECORD_XML."""
    readings = F.transform(
        _inside("readings", "reading"),
        lambda r: F.struct(_last(_texts(r["timestamp"])).alias("timestamp"), _last(_texts(r["sensor"])).alias("sensor"), _last(_parsed(r["value"], to_double)).alias("value")),
    )
    if not keep_empty:
        readings = F.filter(readings, lambda r: r["timestamp"].isNotNull() | r["sensor"].isNotNull() | r["value"].isNotNull())
    own = {
        "id": _parsed(F.col("id"), to_int),
        "name": _texts(F.col("name")),
        "value": _parsed(F.col("value"), to_double),
        "category": _texts(F.col("category")),
        "tags": _texts(_inside("tags", "tag")),
        "meta_created": _texts(_inside("meta", "created")),
        "meta_updated": _texts(_inside("meta", "updated")),
        "readings": readings,
    }
    rest = [c for c in raw.columns if c not in own and c != "meta"]
    record = F.array(F.struct(*[_or_null(v).alias(k) for k, v in own.items()]))
    if not keep_empty:
        record = F.filter(record, lambda r: reduce(Column.__or__, [r[k].isNotNull() for k in own]))
    return raw.select(*rest, F.inline(record))


def record_xml(df: DataFrame, into: str = "xml") -> DataFrame:
    """One `<record>` document a row from columns of RECORD's names (arrays of strings as in RECORD_XML)."""
    names = [c for c in ("id", "name", "value", "category", "tags", "readings", "meta") if c in df.columns]
    return df.withColumn(into, F.to_xml(F.struct(*names), {"rowTag": "record"})).drop(*names)
