"""Queries over nested records: parsing and the flatten shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.operators import flatten
from lodeweave.plans.registry import query
from lodeweave.plans.roles import RECORDS_SQL, orders_records, orders_xml, records, rounded, table
from lodeweave.sources import generate, xml
from lodeweave.sources.storage import scratch
from lodeweave.sources.schemas import FLAT31

_LINES = "lines AS (SELECT *, l_linenumber AS k, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _parsed(spark, sf_dir):
    return xml.parse_xml(orders_xml(spark, sf_dir), "xml")


@query(f"""WITH {RECORDS_SQL}
SELECT o_orderkey, CAST(CASE WHEN two THEN 2 WHEN has_id THEN 1 END AS INTEGER) AS n_ids, name, value IS NOT NULL AS has_value, CAST(CASE WHEN tagged THEN 2 END AS INTEGER) AS n_tags, CAST((SELECT CASE WHEN count(*) > 0 THEN count(*) END FROM lineitem WHERE l_orderkey = o_orderkey) AS INTEGER) AS n_readings FROM r""")
def src01_02_parse_xml(spark, sf_dir):
    """Typed records from XML: trimmed texts, dropped bad numbers, concatenated wrappers."""
    p = _parsed(spark, sf_dir)
    return p.select("o_orderkey", F.when(F.col("id").isNotNull(), F.size("id")).alias("n_ids"), F.col("name")[0].alias("name"), F.col("value").isNotNull().alias("has_value"), F.when(F.col("tags").isNotNull(), F.size("tags")).alias("n_tags"), F.when(F.col("readings").isNotNull(), F.size("readings")).alias("n_readings"))


@query(f"""WITH {RECORDS_SQL}
SELECT r.o_orderkey, id, name, round(CAST(value AS DOUBLE), 2) AS value, category, tag, CAST(NULL AS VARCHAR) AS meta_created, CAST(NULL AS VARCHAR) AS meta_updated, strftime(l_shipdate, '%Y-%m-%d') AS reading_timestamp, l_linestatus AS reading_sensor, l_quantity AS reading_value
FROM r JOIN ids USING (o_orderkey) JOIN tags USING (o_orderkey) LEFT JOIN lineitem ON l_orderkey = r.o_orderkey""")
def flt01_partial_cartesian(spark, sf_dir):
    """XML to flat rows: id x tag x reading."""
    return rounded(flatten.partial_cartesian(_parsed(spark, sf_dir), keep=("o_orderkey",)), 2)


@query(f"""WITH {RECORDS_SQL}
SELECT id, name, round(CAST(value AS DOUBLE), 2) AS value, category, tag, CAST(NULL AS VARCHAR) AS meta_created, CAST(NULL AS VARCHAR) AS meta_updated, strftime(l_shipdate, '%Y-%m-%d') AS reading_timestamp, l_linestatus AS reading_sensor, l_quantity AS reading_value
FROM r JOIN ids USING (o_orderkey) JOIN tags USING (o_orderkey) LEFT JOIN lineitem ON l_orderkey = r.o_orderkey""")
def src05_flat_of_gzip_files(spark, sf_dir):
    """A folder of gzipped XML files to flat rows."""
    folder = f"{scratch(spark, 'xml')}/files"
    orders_records(spark, sf_dir).select("record.*").write.format("xml").options(rootTag="records", rowTag="record", compression="gzip").save(folder)
    return rounded(flatten.partial_cartesian(xml.read_xml(spark, folder)), 2)


def _null(*skip: str) -> dict[str, str]:
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}
    return {c: f"CAST(NULL AS {kinds[t]})" for c, t in FLAT31.items() if c not in skip}


_HEAD = {"id": "CAST(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS INTEGER)", "name": "o_orderpriority", "value": "o_totalprice", "category": "o_orderstatus"}


def _branch(source: str, **values: str) -> str:
    own = _null() | _HEAD | values
    return f"SELECT o_orderkey, {', '.join(f'{own[c]} AS {c}' for c in FLAT31)} FROM {source}"


_STAT = {"stat_mean": "CAST(k AS BIGINT)", "stat_mode": "l_suppkey", "stat_range": "l_partkey"}
_BRANCHES = {
    "r": _branch("lines", reading_timestamp="day", reading_sensor="l_linestatus", reading_value="l_quantity"),
    "m": _branch("(SELECT * FROM lines LEFT JOIN (VALUES (1), (2)) v(j) ON l_partkey % 2 = 0 WHERE k <= 2)", measurement_type="l_returnflag", measurement_data="CAST(l_partkey AS VARCHAR)", method_max="CAST(l_partkey + j AS BIGINT)", method_min="CAST(j AS BIGINT)", method_hash="CASE WHEN j IS NOT NULL THEN l_quantity END"),
    "l": _branch("(SELECT * FROM lines WHERE k <= 2)", lat="CAST(l_suppkey AS DOUBLE)", lon="CAST(-l_suppkey AS DOUBLE)", h3_cell="CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_partkey AS VARCHAR) END", country_code="CASE WHEN l_suppkey % 2 = 0 THEN 'US' END", region_hash="CASE WHEN l_suppkey % 6 = 0 THEN 'h' END", region_id="CASE WHEN l_suppkey % 6 = 0 THEN CAST(l_suppkey AS VARCHAR) END"),
    "p": _branch("(SELECT * FROM lines WHERE k IN (1, 3, 5))", **_STAT, physics_velocity="l_quantity", physics_acceleration="CAST(1 AS DOUBLE)", physics_mass="CAST(2 AS DOUBLE)"),
    "h": _branch("(SELECT * FROM lines, (VALUES (1), (2)) v(j) WHERE k IN (1, 2, 5))", **_STAT, history_previous="CAST(j AS VARCHAR)", history_trend="l_linestatus"),
    "b": _branch("(SELECT * FROM lines WHERE k = 5)", **_STAT, business_revenue="l_quantity", business_outlook="'up'"),
    "t": _branch("(SELECT * FROM orders, (VALUES ('t1'), ('t2')) v(t) WHERE o_orderkey % 3 = 0)", tag="t"),
}
_ALONE = _branch("(SELECT * FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))")


@query(f"WITH {_LINES} {' UNION ALL '.join([*_BRANCHES.values(), _ALONE])}")
def flt02_union(spark, sf_dir):
    """All branches as rows of their own, in one pass over the records."""
    return flatten.union(records(spark, sf_dir), keep=("o_orderkey",))


@query(f"""WITH {_LINES}, n AS (SELECT o_orderkey, greatest(1, count(l_orderkey)) AS r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
m AS (SELECT o_orderkey, sum(CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE 1 END) AS m, count(*) AS l FROM lines WHERE k <= 2 GROUP BY 1),
s AS (SELECT o_orderkey, sum(CASE WHEN k % 3 <> 0 THEN 2 ELSE 1 END) AS s FROM lines WHERE k <= 3 OR k = 5 GROUP BY 1)
SELECT o_orderkey, CAST((CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END) * r * coalesce(m, 1) * coalesce(l, 1) * coalesce(s, 1) AS BIGINT) AS n_rows FROM n LEFT JOIN m USING (o_orderkey) LEFT JOIN s USING (o_orderkey)""")
def flt03_cartesian_counts(spark, sf_dir):
    """Rows of the full product of each record."""
    return flatten.cartesian(records(spark, sf_dir), keep=("o_orderkey",)).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_rows"))


_STAT_PRODUCT = """SELECT o_orderkey, CAST(k AS BIGINT) AS stat_mean, l_suppkey AS stat_mode, l_partkey AS stat_range, CASE WHEN k % 2 = 1 THEN l_quantity END AS physics_velocity, CASE WHEN k % 2 = 1 THEN CAST(1 AS DOUBLE) END AS physics_acceleration, CASE WHEN k % 2 = 1 THEN CAST(2 AS DOUBLE) END AS physics_mass,
CAST(j AS VARCHAR) AS history_previous, CASE WHEN j IS NOT NULL THEN l_linestatus END AS history_trend, CASE WHEN k = 5 THEN l_quantity END AS business_revenue, CASE WHEN k = 5 THEN 'up' END AS business_outlook
FROM (SELECT * FROM lines WHERE k <= 3 OR k = 5) LEFT JOIN (VALUES (1), (2)) v(j) ON k % 3 <> 0"""
_CHECKS = {
    "n_rows": "count(*)", "readings": "sum(reading_value)", "methods": "CAST(sum(method_max) AS BIGINT)", "places": "sum(lat)", "modes": "CAST(sum(stat_mode) AS BIGINT)",
    "velocities": "sum(physics_velocity)", "revenues": "sum(business_revenue)", "values_x_hashes": "sum(reading_value * method_hash)", "places_x_ranges": "sum(lon * stat_range)",
    "days_x_tags": "max(reading_timestamp || '/' || tag)", "ids_x_trends": "min(region_id || '/' || history_trend)", "cells_x_types": "max(h3_cell || '/' || measurement_type)", "codes": "count(country_code)",
}


@query(f"""WITH {_LINES}, r AS (SELECT o_orderkey, reading_timestamp, reading_value FROM ({_BRANCHES["r"]})), m AS (SELECT o_orderkey, measurement_type, method_max, method_hash FROM ({_BRANCHES["m"]})),
l AS (SELECT o_orderkey, lat, lon, h3_cell, country_code, region_id FROM ({_BRANCHES["l"]})), s AS ({_STAT_PRODUCT}), t AS (SELECT o_orderkey, tag FROM ({_BRANCHES["t"]}) UNION ALL SELECT o_orderkey, '' FROM orders WHERE o_orderkey % 3 <> 0)
SELECT o_orderkey, {", ".join(f"{f} AS {k}" for k, f in _CHECKS.items())} FROM t LEFT JOIN r USING (o_orderkey) LEFT JOIN m USING (o_orderkey) LEFT JOIN l USING (o_orderkey) LEFT JOIN s USING (o_orderkey) GROUP BY 1""")
def flt03_cartesian_values(spark, sf_dir):
    """The full product of each record: sums, and pairs across its lists, of all rows."""
    return flatten.cartesian(records(spark, sf_dir), keep=("o_orderkey",)).groupBy("o_orderkey").agg(*[F.expr(f).alias(k) for k, f in _CHECKS.items()])


def _rows(spark, sf_dir, of, columns):
    r = records(spark, sf_dir).select("o_orderkey", of.alias("rows")).select("o_orderkey", F.inline("rows"))
    return r.select("o_orderkey", *flatten.wide(columns))


_STATS = ("stat_mean", "stat_mode", "stat_range", "physics_velocity", "physics_acceleration", "physics_mass", "history_previous", "history_trend", "business_revenue", "business_outlook")
_PLACES = ("lat", "lon", "h3_cell", "country_code", "region_hash", "region_id")
_METHODS = ("measurement_type", "measurement_data", "method_max", "method_min", "method_hash")


def _part(columns, *branches: str) -> str:
    return f"WITH {_LINES}, u AS ({' UNION ALL '.join(_BRANCHES[b] for b in branches)}) SELECT o_orderkey, {', '.join(columns)} FROM u"


@query(_part(_STATS, "p", "h", "b"))
def flt04_stat_union(spark, sf_dir):
    """Leaves of statistics; one without any gives no row."""
    return _rows(spark, sf_dir, flatten.stat_rows(F.col("statistics")), _STATS)


@query(f"WITH {_LINES} {_STAT_PRODUCT}")
def flt05_stat_cartesian(spark, sf_dir):
    """Product of a statistic's leaves; one without any gives a row."""
    return _rows(spark, sf_dir, flatten.stat_rows_cartesian(F.col("statistics")), _STATS)


@query(_part(_PLACES, "l"))
def flt06_07_locations(spark, sf_dir):
    """Locations x regions x ids, parents without children kept."""
    return _rows(spark, sf_dir, flatten.location_rows(F.col("locations")), _PLACES)


@query(_part(_METHODS, "m"))
def flt08_measurements(spark, sf_dir):
    return _rows(spark, sf_dir, flatten.measurement_rows(F.col("measurements")), _METHODS)


@query(_part(("reading_timestamp", "reading_sensor", "reading_value"), "r"))
def flt09_readings(spark, sf_dir):
    return _rows(spark, sf_dir, flatten.reading_rows(F.col("readings")), ("reading_timestamp", "reading_sensor", "reading_value"))


@query("""SELECT p_brand AS color, p_partkey AS top_speed, p_retailprice AS price, CAST(j AS BIGINT) AS horsepower, CASE WHEN j IS NOT NULL THEN CAST(p_size AS BIGINT) END AS mpg, CASE WHEN j IS NOT NULL THEN CAST(j AS DOUBLE) END AS engine_price,
CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS interior_color, CASE WHEN p_partkey % 3 <> 0 THEN 'leather' END AS seat_material, CASE WHEN p_partkey % 3 <> 0 THEN true END AS heated_seats, CAST(i AS BIGINT) AS paint_id, CASE WHEN i IS NOT NULL THEN i = 1 END AS insured
FROM part LEFT JOIN (VALUES (1), (2)) v(j) ON p_partkey % 2 = 0 LEFT JOIN (VALUES (1), (2)) w(i) ON p_partkey % 5 <> 0""")
def flt10_cars(spark, sf_dir):
    """Engine x interior x exterior, each missing list one empty child."""
    k = F.col("p_partkey")
    two = lambda made: F.transform(F.sequence(F.lit(1), F.lit(2)), made)
    df = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("color"), k.alias("top_speed"), F.col("p_retailprice").alias("price"),
        F.when(k % 2 == 0, two(lambda j: F.struct(j.cast("long").alias("horsepower"), F.col("p_size").cast("long").alias("mpg"), j.cast("double").alias("engine_price")))).alias("engine"),
        F.when(k % 3 != 0, F.array(F.struct(F.col("p_type").alias("interior_color"), F.lit("leather").alias("seat_material"), F.lit(True).alias("heated_seats")))).alias("interior"),
        F.when(k % 5 != 0, two(lambda i: F.struct(i.cast("long").alias("paint_id"), (i == 1).alias("insured")))).alias("exterior"),
    )
    return flatten.cars(df)


@query(f"WITH {RECORDS_SQL} SELECT o_orderkey, id, tag FROM ids JOIN tags USING (o_orderkey)")
def flt12_generic_product(spark, sf_dir):
    """A product of lists given by their names and fields."""
    p = _parsed(spark, sf_dir).select("o_orderkey", F.transform(F.coalesce("id", F.array(F.lit(0))), lambda x: F.struct(x.alias("id"))).alias("ids"), F.transform(F.coalesce("tags", F.array(F.lit(""))), lambda x: F.struct(x.alias("tag"))).alias("tagged"))
    return flatten.product(p, ("o_orderkey",), {"ids": ("id",), "tagged": ("tag",)})


@query("SELECT o_orderkey, 'o_orderkey=' || o_orderkey || ', o_orderstatus=' || o_orderstatus AS line FROM orders")
def flt13_display(spark, sf_dir):
    from lodeweave.functions.scalars import line

    return table(spark, sf_dir, "orders").select("o_orderkey", line("o_orderkey", "o_orderstatus").alias("line"))


@query("SELECT CAST(168 AS BIGINT) AS n, CAST(500 AS BIGINT) AS records")
def src16_nested_generator(spark, sf_dir):
    """Rows that the union of each generated record gives: 168."""
    flat = flatten.union(generate.nested(spark, 500).withColumn("k", F.monotonically_increasing_id()), keep=("k",))
    return flat.groupBy("k").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT CAST(8400000 AS BIGINT) AS n_rows, CAST(750000 AS BIGINT) AS readings, CAST(1500000 AS BIGINT) AS methods, CAST(750000 AS BIGINT) AS places, CAST(5250000 AS BIGINT) AS leaves, CAST(150000 AS BIGINT) AS tags")
def api02_load_test(spark, sf_dir):
    """The load test: the union of 50,000 generated records of 168 rows each."""
    flat = flatten.union(generate.nested(spark, 50_000))
    counts = {"n_rows": F.lit(1), "readings": "reading_timestamp", "methods": "method_max", "places": "h3_cell", "leaves": "stat_mean", "tags": "tag"}
    return flat.agg(*[F.count(c).alias(k) for k, c in counts.items()])


@query("SELECT CAST(1000 AS BIGINT) AS records, CAST(1000 AS BIGINT) AS parsed")
def src15_xml_generator(spark, sf_dir):
    """Generated records written as XML and parsed again."""
    text = xml.record_xml(generate.records(spark, 1000))
    return text.agg(F.count(F.lit(1)).alias("records")).join(xml.parse_xml(text, "xml").agg(F.count(F.lit(1)).alias("parsed")))
