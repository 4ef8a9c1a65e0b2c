"""Synthetic records, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the generators.
SUBJECTS = ("science", "engineering", "mathematics")
TAGS = ("red", "blue", "green", "fast", "slow", "new", "old", "rare")


def _chance(i: Column, seed: int, what: str) -> Column:
    """A number in [0, 1) from the row, the seed and the purpose."""
    return F.pmod(F.xxhash64(i, F.lit(seed), F.lit(what)), F.lit(1 << 30)) / float(1 << 30)


def _maybe(i: Column, seed: int, what: str, p: float, value: Column) -> Column:
    return F.when(_chance(i, seed, what) < p, F.array(value))


def records(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Columns of RECORD_XML, with fields present by chance: the input of xml.record_xml."""
    i = F.col("i")
    number = i.cast("string")
    n_tags = F.floor(_chance(i, seed, "tags") * 5).cast("int")
    n_readings = F.floor(_chance(i, seed, "readings") * 3).cast("int") + 1
    tag = lambda k: F.element_at(F.array(*map(F.lit, TAGS)), F.pmod(F.xxhash64(i, F.lit(seed), k), F.lit(8)).cast("int") + 1)
    reading = lambda k: F.struct(F.array(F.concat(F.lit("2025-01-01T0"), k.cast("string"), F.lit(":00:00"))).alias("timestamp"), F.array(F.concat(F.lit("S"), k.cast("string"))).alias("sensor"), F.array((i + k * 0.5).cast("string")).alias("value"))
    two = F.when(_chance(i, seed, "ids") < 0.7, F.array((i + 1000).cast("string"), (i + 2000).cast("string"))).otherwise(F.array((i + 1000).cast("string")))
    return spark.range(n).toDF("i").select(
        two.alias("id"),
        _maybe(i, seed, "name", 0.9, F.concat(F.lit("Alpha"), number)).alias("name"),
        _maybe(i, seed, "value", 0.85, F.round(F.lit(40.0) + i * 0.1, 1).cast("string")).alias("value"),
        _maybe(i, seed, "category", 0.8, F.element_at(F.array(*map(F.lit, SUBJECTS)), (i % 3).cast("int") + 1)).alias("category"),
        F.when(n_tags > 0, F.array(F.struct(F.transform(F.sequence(F.lit(1), n_tags), tag).alias("tag")))).alias("tags"),
        F.when(_chance(i, seed, "block") < 0.8, F.array(F.struct(F.transform(F.sequence(F.lit(1), n_readings), reading).alias("reading")))).alias("readings"),
        F.array(F.struct(_maybe(i, seed, "created", 0.9, F.lit("2025-01-01")).alias("created"), _maybe(i, seed, "updated", 0.8, F.lit("2025-02-01")).alias("updated"))).alias("meta"),
    )


def nested(spark: SparkSession, n: int = 50_000) -> DataFrame:
    """Equal records of NESTED: 15 readings, 15 x 2 methods, 15 locations, 15 statistics of 3 + 2 + 2 leaves, 3 tags."""
    times = lambda k, make: F.transform(F.sequence(F.lit(1), F.lit(k)), make)
    named = lambda **v: F.struct(*[c.alias(k) for k, c in v.items()])
    text, real = (lambda c, p: F.concat(F.lit(p), c.cast("string"))), (lambda c: c.cast("double"))
    method = lambda j: named(max=j * 10, min=j, hash=real(j))
    region = lambda j: named(h3_cell=F.lit("831c6ffffffffff"), country_code=F.lit("US"), region_ID=F.array(named(region_hash=text(j, "h"), region_id=text(j, "r"))))
    return spark.range(n).select(
        F.array(F.lit(1)).alias("id"), F.array(F.lit("name")).alias("name"), F.array(F.lit(1.0)).alias("value"), F.array(F.lit("category")).alias("category"),
        F.array(*map(F.lit, ("t1", "t2", "t3"))).alias("tags"), F.array(F.lit("c")).alias("meta_created"), F.array(F.lit("u")).alias("meta_updated"),
        times(15, lambda k: named(timestamp=text(k, "2025-01-01T00:00:"), sensor=text(k, "S"), value=real(k))).alias("readings"),
        times(15, lambda k: named(type=text(k, "type"), data=text(k, "data"), method=times(2, lambda j: method(j.cast("long"))))).alias("measurements"),
        times(15, lambda k: named(lat=real(k), lon=real(-k), region=F.array(region(k)))).alias("locations"),
        times(15, lambda k: named(
            mean=k.cast("long"), mode=k.cast("long"), range=k.cast("long"),
            physics=times(3, lambda j: named(velocity=real(j), acceleration=real(j), mass=real(j))),
            history=times(2, lambda j: named(previous=text(j, "p"), trend=text(j, "t"))),
            business=times(2, lambda j: named(revenue=real(j), outlook=text(j, "o"))),
        )).alias("statistics"),
    )
