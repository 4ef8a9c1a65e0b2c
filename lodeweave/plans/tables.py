"""Queries over layout, geo, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions import scalars
from lodeweave.operators import geo, layout
from lodeweave.plans.registry import query
from lodeweave.plans.roles import rounded, table
from lodeweave.sources.schemas import FLAT31, FLAT_DATE31, conform
from lodeweave.sources.storage import scratch


def _keys(spark, sf_dir):
    """Orders with nullable keys for the layouts."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.when(k % 7 != 0, k % 50).alias("id"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("name"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("category"), F.when(k % 5 != 0, k % 9).alias("value"),
        F.when(k % 6 != 0, (k % 4).cast("string")).alias("tag"), F.when(k % 2 == 0, "US").alias("country_code"), F.when(k % 9 != 0, F.concat(F.lit("c"), (k % 5).cast("string"))).alias("h3_cell"),
        F.when(k % 8 != 0, F.year("o_orderdate")).alias("year"), F.when(k % 8 != 0, F.month("o_orderdate")).alias("month"), F.when(k % 8 != 0, F.dayofmonth("o_orderdate")).alias("day"),
    )


_KEYS = """WITH k AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 50 END AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS name, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS category, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 9 END AS value,
CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 4 AS VARCHAR) END AS tag, CASE WHEN o_orderkey % 2 = 0 THEN 'US' END AS country_code, CASE WHEN o_orderkey % 9 <> 0 THEN 'c' || o_orderkey % 5 END AS h3_cell,
CAST(CASE WHEN o_orderkey % 8 <> 0 THEN year(o_orderdate) END AS INTEGER) AS year, CAST(CASE WHEN o_orderkey % 8 <> 0 THEN month(o_orderdate) END AS INTEGER) AS month, CAST(CASE WHEN o_orderkey % 8 <> 0 THEN day(o_orderdate) END AS INTEGER) AS day FROM orders)"""


@query(f"{_KEYS} SELECT coalesce(category, 'unknown') AS category, coalesce(tag, 'unknown') AS tag, coalesce(country_code, 'unknown') AS country_code, coalesce(h3_cell, 'unknown') AS h3_cell, count(*) AS n_rows FROM k GROUP BY 1, 2, 3, 4")
def snk09_geo_partitions(spark, sf_dir):
    return layout.partition_counts(_keys(spark, sf_dir), layout.GEO_KEYS)


@query(f"{_KEYS} SELECT coalesce(year, 0) AS year, coalesce(month, 0) AS month, coalesce(day, 0) AS day, coalesce(h3_cell, 'unknown') AS h3_cell, count(*) AS n_rows FROM k GROUP BY 1, 2, 3, 4")
def snk10_date_partitions(spark, sf_dir):
    return layout.partition_counts(_keys(spark, sf_dir), layout.DATE_KEYS)


@query(f"{_KEYS} SELECT 'id=' || coalesce(CAST(id AS VARCHAR), 'unknown') || '/name=' || coalesce(name, 'unknown') || '/category=' || coalesce(category, 'unknown') || '/value=' || coalesce(CAST(value AS VARCHAR), 'unknown') || '.parquet' AS path, count(*) AS n_rows FROM k GROUP BY 1")
def snk06_file_paths(spark, sf_dir):
    return _keys(spark, sf_dir).groupBy(layout.partition_path(layout.FILE_KEYS).alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"{_KEYS} SELECT 'id=' || coalesce(CAST(id AS VARCHAR), 'unknown') || '/name=' || coalesce(name, 'unknown') || '/category=' || coalesce(category, 'unknown') AS folder, CAST(count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_files, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(value) AS BIGINT) AS total FROM k GROUP BY 1")
def snk05_06_key_files(spark, sf_dir):
    """Files by key, written and read again by their folders."""
    base = f"{scratch(spark, 'keys')}/files"
    listed = layout.write_key_files(_keys(spark, sf_dir), base, layout.FILE_KEYS)
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "value=*.parquet").parquet(base)
    held = rows.withColumn("folder", F.regexp_extract(F.input_file_name(), "(id=.*)/value=", 1))
    totals = held.groupBy(F.url_decode("folder").alias("folder")).agg(F.sum("value").alias("total"))
    counts = listed.groupBy(F.regexp_extract("path", "^(.*)/value=", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("rows").alias("n_rows"))
    return counts.join(totals, "folder").select("folder", "n_files", "n_rows", "total")


@query("SELECT o_orderstatus AS category, count(*) AS n_rows FROM orders GROUP BY 1")
def snk13_log_of_existing_files(spark, sf_dir):
    """A table log's Add actions over files in folders by key: each folder's rows, counted through the log."""
    base = f"{scratch(spark, 'table')}/files"
    layout.write_partitioned(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("category")), base, {"category": "unknown"})
    adds = layout.create_log(spark, base, ("category",))
    paths = [r["path"] for r in adds.select("path").collect()]  # of a few folders
    rows = spark.read.option("basePath", base).parquet(*[f"{base}/{p}" for p in paths])
    return rows.join(adds.select("partitionValues.category").distinct(), "category").groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"))


def _flat_sql(flat: dict[str, str]) -> str:
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}
    own = {"id": "CAST(o_orderkey AS INTEGER)", "name": "o_orderpriority", "value": "o_totalprice", "category": "o_orderstatus"}
    return f"SELECT {', '.join(f'{own.get(c, f"CAST(NULL AS {kinds[t]})")} AS {c}' for c, t in flat.items())} FROM orders"


def _flat(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("category"))


@query(_flat_sql(FLAT31))
def snk01_fixed_schema(spark, sf_dir):
    """The 31 columns in order, cast; missing ones null."""
    return conform(_flat(spark, sf_dir), FLAT31)


@query(_flat_sql(FLAT_DATE31))
def snk03_date_schema(spark, sf_dir):
    return conform(_flat(spark, sf_dir), FLAT_DATE31)


def spread_sql(x: str) -> str:
    return " + ".join(f"(((({x}) >> {k}) & 1) << {2 * k})" for k in range(16))


_CELLS = "WITH c AS (SELECT o_orderkey, CAST(o_orderkey % 16 AS BIGINT) AS d, o_orderdate FROM orders)"


def _cells(spark, sf_dir):
    """Cells of resolution 3 with a digit of their own, and a date number."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("831c"), F.lower(F.hex(k % 16)), F.lit("ffffffffff")).alias("h3_res3"), (20250000 + k % 365).alias("date_id"), "o_orderdate")


@query(f"SELECT o_orderkey, CAST((({spread_sql('CAST(65535 AS BIGINT)')}) << 1) + ({spread_sql('(20250000 + o_orderkey % 365) & 65535')}) AS BIGINT) AS z_key FROM orders")
def lay01_morton_ref(spark, sf_dir):
    return _cells(spark, sf_dir).select("o_orderkey", layout.morton_ref(F.col("h3_res3"), F.col("date_id")).alias("z_key"))


@query(f"{_CELLS} SELECT o_orderkey, '831c' || substr('0123456789abcdef', CAST(d + 1 AS INTEGER), 1) || 'ffffffffff' AS h3_res3, CAST((({spread_sql('(7183 + d * 16)')}) << 1) + ({spread_sql("date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) & 65535")}) AS BIGINT) AS z_key FROM c")
def lay02_zorder(spark, sf_dir):
    """Rows in ranges of a key that tells cells and days apart; sorted within each."""
    return layout.zorder(_cells(spark, sf_dir), layout.morton_cell(F.col("h3_res3"), F.col("o_orderdate"))).select("o_orderkey", "h3_res3", "z_key")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey AS BIGINT) AS hex_back, CAST(l_partkey & 255 AS BIGINT) AS low_bits FROM lineitem")
def str06_mth05_hex_and_bits(spark, sf_dir):
    """Hex text back to a number, and bits of it."""
    back = scalars.hex_to_long(F.lower(F.hex("l_partkey")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", back.alias("hex_back"), back.bitwiseAND(F.lit(255)).alias("low_bits"))


@query("SELECT o_orderkey, 'v' || o_orderkey % 10 AS a, 'w=x' AS b, CAST(2 AS INTEGER) AS n FROM orders")
def src11_path_pairs(spark, sf_dir):
    """key=value folders of paths, with either slash."""
    path = F.concat(F.lit("s3\\base/a=v"), (F.col("o_orderkey") % 10).cast("string"), F.lit("/b=w=x\\file.parquet"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.path_pairs(path).alias("m")).select("o_orderkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.size("m").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_partkey AS INTEGER) END AS i, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END AS d FROM lineitem")
def str01_02_guarded_numbers(spark, sf_dir):
    """Trimmed text to numbers; what is none is null."""
    i = F.concat(F.lit("  "), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, ".7").otherwise(" "))
    d = F.concat(F.col("l_quantity").cast("string"), F.when(F.col("l_linenumber") % 4 == 0, "d").otherwise(" "))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.to_int(i).alias("i"), scalars.to_double(d).alias("d"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS lenient, o_orderdate AS strict, o_orderdate + INTERVAL 1 HOUR AS ceiling, CAST(25 AS BIGINT) AS hours FROM orders")
def dat01_05_dates(spark, sf_dir):
    """Text to timestamps, rounding to hours, whole hours between."""
    text = F.col("o_orderdate").cast("string")
    late = (F.col("o_orderdate") + F.expr("INTERVAL 1 SECOND")).cast("timestamp_ntz")
    next_day = (F.col("o_orderdate") + F.expr("INTERVAL '25:59:59' HOUR TO SECOND")).cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.parse_time(F.when(F.col("o_orderkey") % 3 == 0, "none").otherwise(text)).alias("lenient"), scalars.parse_time_strict(text).alias("strict"), scalars.next_hour(late).alias("ceiling"), scalars.hours_between(F.col("o_orderdate"), next_day).cast("long").alias("hours"))


@query("SELECT s_suppkey, round(least(greatest(s_acctbal / 1000, CAST(-5 AS DOUBLE)), CAST(5 AS DOUBLE)), 6) AS clipped, round((exp(2 * (s_acctbal / 10000)) - 1) / (exp(2 * (s_acctbal / 10000)) + 1), 6) AS bounded, CAST(ceil(s_acctbal / 7) AS BIGINT) AS up, CASE WHEN s_nationkey <> 0 THEN round(s_acctbal / s_nationkey, 6) END AS share FROM supplier")
def mth02_08_math(spark, sf_dir):
    """Clipping, tanh, ceiling, guarded ratios."""
    b = F.col("s_acctbal")
    return rounded(table(spark, sf_dir, "supplier").select("s_suppkey", scalars.clip(b / 1000, -5.0, 5.0).alias("clipped"), F.tanh(b / 10000).alias("bounded"), F.ceil(b / 7).alias("up"), scalars.ratio(b, F.col("s_nationkey")).alias("share")))


@query("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def fil05_time_slice(spark, sf_dir):
    from lodeweave.operators.ml import time_slice

    return time_slice(table(spark, sf_dir, "events").select("event_id", "ts", "value"), "2024-01-05", "2024-01-12", "ts")


@query("SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL AND event_type = 'click' AND value IS NOT NULL")
def fil01_03_filters(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").isNotNull() & (F.col("event_type") == "click")).na.drop(subset=["value"]).select("event_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50)")
def fil04_is_in(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.join(e.where("event_type = 'purchase' AND value > 50").select("user_id"), "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT o_orderkey AS id, o_totalprice * 2 AS doubled, 'c' AS cell, CAST(0 AS DOUBLE) AS zero FROM orders")
def prj01_07_projections(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "id"}).withColumns({"doubled": F.col("o_totalprice") * 2, "cell": F.lit("c"), "zero": F.lit(0.0)})
    return o.drop("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _edges(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    ring = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 1) % 25).alias("dst"))
    return ring.unionByName(ring.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


_EDGES = "WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst FROM nation UNION ALL SELECT (n_nationkey + 1) % 25, n_nationkey FROM nation), ring AS (SELECT n_nationkey AS cell, 0 AS k FROM nation WHERE n_regionkey = 0 UNION SELECT dst, k + 1 FROM ring JOIN e ON src = cell WHERE k < 2)"


@query(f"{_EDGES} SELECT DISTINCT cell FROM ring")
def geo01_k_ring(spark, sf_dir):
    return geo.k_ring(table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("cell")), _edges(spark, sf_dir), 2)


@query(f"{_EDGES} SELECT DISTINCT cell FROM ring WHERE cell IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def api17_expand_and_restrict(spark, sf_dir):
    ring = geo.k_ring(table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("cell")), _edges(spark, sf_dir), 2)
    return geo.restrict(ring, table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("cell")))


@query("SELECT n_nationkey AS cell FROM nation UNION SELECT s_nationkey FROM supplier")
def set01_union(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return n.select(F.col("n_nationkey").alias("cell")).union(s.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS cell FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set02_intersect(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("cell")).intersect(s.select("s_nationkey"))


@query("SELECT event_id, name FROM events, (VALUES (0, 'a'), (1, 'b')) t(k, name) WHERE user_id % 2 = k")
def jon09_broadcast_truth(spark, sf_dir):
    """A small truth table, of two rows, sent to every task."""
    truth = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    return table(spark, sf_dir, "events").join(F.broadcast(truth), F.col("user_id") % 2 == F.col("k")).select("event_id", "name")


@query()
def src10_11_manifest(spark, sf_dir):
    """The Parquet files below a folder with their sizes; SQL has no listing of files with these columns."""
    return layout.files(spark, sf_dir).select(F.substring_index("path", "/", -1).alias("name"), "size", "partition_values", "modification_time", "data_change")
