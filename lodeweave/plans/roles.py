"""The test tables in the roles of the engine's inputs, as frames and as the same relations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.scalars import hour

TYPES = ("click", "error", "purchase", "signup", "view")
CELLS = 12
#: Of predictions: of so many digits that rounded results don't tie.
SCALE = 0.0003719351


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits at which two engines' sums agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def cell_of(user, k: int):
    return F.concat(F.lit("c"), F.lpad(F.pmod(user + k, F.lit(CELLS)).cast("string"), 2, "0"))


def observations(spark: SparkSession, sf_dir: str, hourly: bool = False) -> DataFrame:
    """Two candidate cells and one measurement for each event, on rows of their own as in a flat table."""
    e = table(spark, sf_dir, "events")
    ts = hour(F.col("ts")) if hourly else F.col("ts")
    place = F.inline(F.array(*[F.struct(cell_of(F.col("user_id"), k).alias("h3_res3"), F.lit(w).alias("location_weight"), F.lit(float(k)).alias("location_lat")) for k, w in ((0, 0.75), (1, 0.25))]))
    rows = e.select(F.col("event_id").alias("obs_id"), ts.alias("timestamp"), "event_type", "value", place)
    loc = rows.select("obs_id", "timestamp", "h3_res3", "location_weight", "location_lat", F.lit(0.0).alias("location_lon"), F.lit(None).cast("string").alias("measurement_type"), F.lit(None).cast("double").alias("measurement_weight"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("h3_res3", "string"), ("location_weight", "double"), ("location_lat", "double"), ("location_lon", "double"))]
    meas = e.select(F.col("event_id").alias("obs_id"), ts.alias("timestamp"), *none, F.col("event_type").alias("measurement_type"), F.col("value").alias("measurement_weight"))
    return loc.unionByName(meas)


OBS_SQL = f"""
loc AS (SELECT event_id AS obs_id, ts AS timestamp, 'c' || lpad(CAST((user_id + k) % {CELLS} AS VARCHAR), 2, '0') AS h3_res3, w AS location_weight, CAST(k AS DOUBLE) AS location_lat
        FROM events, (VALUES (0, CAST(0.75 AS DOUBLE)), (1, CAST(0.25 AS DOUBLE))) v(k, w)),
meas AS (SELECT event_id AS obs_id, ts AS timestamp, event_type AS measurement_type, value AS measurement_weight FROM events)"""

ATOMIC_SQL = f"""{OBS_SQL},
atomic AS (SELECT DISTINCT h3_res3, date_trunc('hour', loc.timestamp) AS timestamp, measurement_type, location_weight * measurement_weight AS signal_weight
           FROM (SELECT DISTINCT * FROM loc) loc JOIN (SELECT DISTINCT obs_id, measurement_type, measurement_weight FROM meas) m USING (obs_id))"""

GRID_SQL = """
grid AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), CASE WHEN date_trunc('hour', max(ts)) = max(ts) THEN max(ts) ELSE date_trunc('hour', max(ts)) + INTERVAL 1 HOUR END - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS timestamp FROM events)"""

WIDE_SQL = "wide AS (SELECT h3_res3, timestamp, " + ", ".join(f"sum(CAST(signal_weight AS DECIMAL(28,10))) FILTER (measurement_type = '{t}') AS {t}" for t in TYPES) + " FROM atomic GROUP BY ALL)"
DENSE_SQL = "dense AS (SELECT g.timestamp, c.h3_res3, " + ", ".join(f"coalesce(w.{t}, 0) AS {t}" for t in TYPES) + " FROM (SELECT DISTINCT h3_res3 FROM wide) c CROSS JOIN grid g LEFT JOIN wide w ON w.h3_res3 = c.h3_res3 AND w.timestamp = g.timestamp)"


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """h3_res3, timestamp, label of the events of type error."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(cell_of(F.col("user_id"), 0).alias("h3_res3"), F.col("ts").alias("timestamp"), F.lit(1).alias("label"))


EVENTS_SQL = f"""{GRID_SQL},
happened AS (SELECT 'c' || lpad(CAST(user_id % {CELLS} AS VARCHAR), 2, '0') AS h3_res3, date_trunc('hour', ts) AS timestamp, 1 AS event FROM events WHERE event_type = 'error' GROUP BY ALL),
hourly AS (SELECT c.h3_res3, g.timestamp, coalesce(h.event, 0) AS event FROM (SELECT DISTINCT h3_res3 FROM happened) c CROSS JOIN grid g LEFT JOIN happened h ON h.h3_res3 = c.h3_res3 AND h.timestamp = g.timestamp)"""


def horizons(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three horizons' predictions by cell and hour, each of other rows, so that joins and gaps occur."""
    e = table(spark, sf_dir, "events")
    base = e.groupBy(cell_of(F.col("user_id"), 0).alias("h3_cell"), hour(F.col("ts")).alias("timestamp")).agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") * SCALE).alias("p"), F.max((F.col("event_type") == "error").cast("int")).alias("label"), F.min("event_id").alias("m"))
    prediction = {"1hr": F.col("p"), "6hr": F.col("p") * 0.5, "12hr": F.lit(0.25) + F.col("p") * 0.25}
    rows = {"1hr": F.col("m") % 5 != 0, "6hr": F.col("m") % 3 != 0, "12hr": F.col("m") % 2 == 0}
    return {h: base.where(rows[h]).select("h3_cell", "timestamp", F.col("label").cast("double").alias("label"), prediction[h].alias("prediction")) for h in prediction}


HORIZON_SQL = f"""
base AS (SELECT 'c' || lpad(CAST(user_id % {CELLS} AS VARCHAR), 2, '0') AS h3_cell, date_trunc('hour', ts) AS timestamp, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) * CAST({SCALE} AS DOUBLE) AS p, max(CAST(event_type = 'error' AS INTEGER)) AS label, min(event_id) AS m FROM events GROUP BY 1, 2),
p1 AS (SELECT h3_cell, timestamp, CAST(label AS DOUBLE) AS label_1hr, p AS pred_1hr FROM base WHERE m % 5 <> 0),
p6 AS (SELECT h3_cell, timestamp, CAST(label AS DOUBLE) AS label_6hr, p * 0.5 AS pred_6hr FROM base WHERE m % 3 <> 0),
p12 AS (SELECT h3_cell, timestamp, CAST(label AS DOUBLE) AS label_12hr, CAST(0.25 AS DOUBLE) + p * 0.25 AS pred_12hr FROM base WHERE m % 2 = 0),
joined AS (SELECT h3_cell, timestamp, coalesce(label_1hr, 0) AS label_1hr, coalesce(pred_1hr, 0) AS pred_1hr, coalesce(label_6hr, 0) AS label_6hr, coalesce(pred_6hr, 0) AS pred_6hr, coalesce(label_12hr, 0) AS label_12hr, coalesce(pred_12hr, 0) AS pred_12hr
           FROM p1 FULL JOIN p6 USING (h3_cell, timestamp) FULL JOIN p12 USING (h3_cell, timestamp)),
gaps AS (SELECT *, CAST(date_diff('microsecond', lag(timestamp) OVER (PARTITION BY h3_cell ORDER BY timestamp), timestamp) // 3600000000 AS BIGINT) AS dt_hours FROM joined),
marked AS (SELECT *, CASE WHEN dt_hours IS NULL OR dt_hours > 1 THEN 1 ELSE 0 END AS new_seg FROM gaps),
islands AS (SELECT *, CAST(sum(new_seg) OVER (PARTITION BY h3_cell ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_id FROM marked),
seg AS (SELECT *, CAST(row_number() OVER (PARTITION BY h3_cell, seg_id ORDER BY timestamp) - 1 AS INTEGER) AS seg_pos, count(*) OVER (PARTITION BY h3_cell, seg_id) AS seg_len FROM islands)"""


def orders_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and record: one for each order with its lines as readings, in the shape of its XML."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_shipdate", "l_linestatus", "l_quantity", "l_partkey"))).alias("lines"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = lambda c: c.cast("string")
    key = F.col("o_orderkey")
    return o.select(
        key,
        F.struct(
            F.when(key % 7 == 0, F.array(text(key), F.lit("x"), text(key + 1))).when(key % 5 != 0, F.array(text(key))).alias("id"),
            F.array(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))).alias("name"),
            F.array(F.when(key % 11 == 0, F.lit("5d")).otherwise(text(F.col("o_totalprice").cast("decimal(18,2)")))).alias("value"),
            F.array(F.col("o_orderstatus")).alias("category"),
            F.when(key % 3 == 0, F.array(F.struct(F.array(F.lit("t1")).alias("tag")), F.struct(F.array(F.lit("t2")).alias("tag")))).alias("tags"),
            F.when(F.col("lines").isNotNull(), F.array(F.struct(F.transform("lines", lambda r: F.struct(F.array(F.date_format(r["l_shipdate"], "yyyy-MM-dd")).alias("timestamp"), F.array(r["l_linestatus"]).alias("sensor"), F.array(text(r["l_quantity"].cast("decimal(10,1)"))).alias("value"))).alias("reading")))).alias("readings"),
        ).alias("record"),
    )


def orders_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and xml: one `<record>` document for each order."""
    return orders_records(spark, sf_dir).select("o_orderkey", F.to_xml("record", {"rowTag": "record"}).alias("xml"))


RECORDS_SQL = """
r AS (SELECT o_orderkey, o_orderkey % 7 = 0 AS two, o_orderkey % 5 <> 0 OR o_orderkey % 7 = 0 AS has_id, o_orderpriority AS name, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS value, o_orderstatus AS category, o_orderkey % 3 = 0 AS tagged FROM orders),
ids AS (SELECT o_orderkey, CAST(CASE WHEN has_id THEN o_orderkey ELSE 0 END AS INTEGER) AS id FROM r UNION ALL SELECT o_orderkey, CAST(o_orderkey + 1 AS INTEGER) FROM r WHERE two),
tags AS (SELECT o_orderkey, CASE WHEN tagged THEN 't1' ELSE '' END AS tag FROM r UNION ALL SELECT o_orderkey, 't2' FROM r WHERE tagged)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records of NESTED: orders with lines as readings, parts as measurements, and ship places and prices below."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_linestatus", "l_returnflag"))).alias("lines"))
    rows = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    lines = F.col("lines")
    key = F.col("o_orderkey")
    day = lambda r: F.date_format(r["l_shipdate"], "yyyy-MM-dd")
    few = lambda r, n, made: F.transform(F.sequence(F.lit(1), F.lit(n)), made)
    reading = lambda r: F.struct(day(r).alias("timestamp"), r["l_linestatus"].alias("sensor"), r["l_quantity"].alias("value"))
    method = lambda r: F.when(r["l_partkey"] % 2 == 0, few(r, 2, lambda j: F.struct((r["l_partkey"] + j).alias("max"), j.cast("bigint").alias("min"), r["l_quantity"].alias("hash"))))
    measurement = lambda r: F.struct(r["l_returnflag"].alias("type"), r["l_partkey"].cast("string").alias("data"), method(r).alias("method"))
    ids = lambda r: F.when(r["l_suppkey"] % 3 == 0, F.array(F.struct(F.lit("h").alias("region_hash"), r["l_suppkey"].cast("string").alias("region_id"))))
    region = lambda r: F.when(r["l_suppkey"] % 2 == 0, F.array(F.struct(r["l_partkey"].cast("string").alias("h3_cell"), F.lit("US").alias("country_code"), ids(r).alias("region_ID"))))
    place = lambda r: F.struct(r["l_suppkey"].cast("double").alias("lat"), (-r["l_suppkey"]).cast("double").alias("lon"), region(r).alias("region"))
    physics = lambda r: F.when(r["l_linenumber"] % 2 == 1, F.array(F.struct(r["l_quantity"].alias("velocity"), F.lit(1.0).alias("acceleration"), F.lit(2.0).alias("mass"))))
    history = lambda r: F.when(r["l_linenumber"] % 3 != 0, few(r, 2, lambda j: F.struct(j.cast("string").alias("previous"), r["l_linestatus"].alias("trend"))))
    business = lambda r: F.when(r["l_linenumber"] == 5, F.array(F.struct(r["l_quantity"].alias("revenue"), F.lit("up").alias("outlook"))))
    stat = lambda r: F.struct(r["l_linenumber"].cast("bigint").alias("mean"), r["l_suppkey"].alias("mode"), r["l_partkey"].alias("range"), physics(r).alias("physics"), history(r).alias("history"), business(r).alias("business"))
    return rows.select(
        key,
        F.when(key % 5 != 0, F.array(key.cast("int"))).alias("id"), F.array("o_orderpriority").alias("name"), F.array("o_totalprice").alias("value"), F.array("o_orderstatus").alias("category"),
        F.when(key % 3 == 0, F.array(F.lit("t1"), F.lit("t2"))).alias("tags"), F.lit(None).cast("array<string>").alias("meta_created"), F.lit(None).cast("array<string>").alias("meta_updated"),
        F.transform(lines, reading).alias("readings"), F.transform(F.filter(lines, lambda r: r["l_linenumber"] <= 2), measurement).alias("measurements"),
        F.transform(F.filter(lines, lambda r: r["l_linenumber"] <= 2), place).alias("locations"), F.transform(F.filter(lines, lambda r: (r["l_linenumber"] <= 3) | (r["l_linenumber"] == 5)), stat).alias("statistics"),
    )
