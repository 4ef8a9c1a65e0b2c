"""Queries over observations and events: features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions.scalars import hour
from lodeweave.operators import features, labels
from lodeweave.plans.registry import query
from lodeweave.plans.roles import ATOMIC_SQL, DENSE_SQL, EVENTS_SQL, GRID_SQL, OBS_SQL, TYPES, WIDE_SQL, errors, observations, rounded
from lodeweave.sources.schemas import WINDOWS

_BASE = f"WITH {ATOMIC_SQL},{GRID_SQL},\n{WIDE_SQL},\n{DENSE_SQL}"


def rolling_sql(source: str, windows: dict[str, int] = WINDOWS, sums: bool = True, counts: bool = True) -> str:
    columns = []
    for w, span in windows.items():
        over = f"OVER (PARTITION BY h3_res3 ORDER BY timestamp ROWS BETWEEN {span - 1} PRECEDING AND CURRENT ROW)"
        for t in TYPES:
            if sums:
                columns.append(f"round(CAST(CASE WHEN count(*) {over} >= {span} THEN sum({t}) {over} END AS DOUBLE), 6) AS {t}__sum_{w}")
            if counts:
                columns.append(f"CAST(CASE WHEN count(*) {over} >= {span} THEN sum(CAST({t} > 0 AS INTEGER)) {over} END AS BIGINT) AS {t}__count_{w}")
    return f"SELECT timestamp, h3_res3, {', '.join(columns)} FROM {source}"


@query(f"{_BASE}\n{rolling_sql('dense')}")
def feat_rolling(spark, sf_dir):
    """Hourly features on the global grid, from the scan to the rolled windows."""
    return rounded(features.build(observations(spark, sf_dir)))


@query(f"{_BASE}\n{rolling_sql('dense', counts=False)}")
def win01_rolling_sum(spark, sf_dir):
    f = features.build(observations(spark, sf_dir), types=TYPES)
    return rounded(f.select("timestamp", "h3_res3", *[c for c in f.columns if "__sum_" in c]))


@query(f"{_BASE}\n{rolling_sql('dense', sums=False)}")
def win02_rolling_count(spark, sf_dir):
    f = features.build(observations(spark, sf_dir), types=TYPES)
    return f.select("timestamp", "h3_res3", *[c for c in f.columns if "__count_" in c])


_HOURLY_OBS = OBS_SQL.replace("ts AS timestamp", "date_trunc('hour', ts) AS timestamp")
_PER_CELL = f"""WITH {_HOURLY_OBS},
atomic AS (SELECT h3_res3, loc.timestamp, measurement_type, location_weight * measurement_weight AS signal_weight FROM loc JOIN meas ON meas.obs_id = loc.obs_id AND meas.timestamp = loc.timestamp),
{WIDE_SQL},
steps AS (SELECT h3_res3, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp FROM wide GROUP BY 1),
dense AS (SELECT s.timestamp, s.h3_res3, {", ".join(f"coalesce(w.{t}, 0) AS {t}" for t in TYPES)} FROM steps s LEFT JOIN wide w ON w.h3_res3 = s.h3_res3 AND w.timestamp = s.timestamp)"""


@query(f"{_PER_CELL}\n{rolling_sql('dense')}")
def api04_features_per_cell(spark, sf_dir):
    """Each cell on its own grid, signals not deduplicated, joined on obs_id and timestamp."""
    return rounded(features.build(observations(spark, sf_dir, hourly=True), grid="per_cell", types=TYPES))


@query(f"{_PER_CELL}\nSELECT timestamp, h3_res3, {', '.join(f'round(CAST({t} AS DOUBLE), 6) AS {t}' for t in TYPES)} FROM dense")
def win03_upsample(spark, sf_dir):
    wide = features.pivot(features.atomic_by_time(observations(spark, sf_dir, hourly=True)), TYPES)
    d = features.upsample(wide, TYPES)
    return rounded(d.select("timestamp", "h3_res3", *[F.col(t).cast("double").alias(t) for t in TYPES]))


@query(f"WITH {GRID_SQL} SELECT timestamp FROM grid")
def win04_hourly_grid(spark, sf_dir):
    return features.hourly_grid(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").alias("timestamp")))


@query("SELECT event_id, date_trunc('hour', ts) AS hour FROM events")
def win05_truncate(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", hour(F.col("ts")).alias("hour"))


@query("SELECT DISTINCT event_type AS measurement_type FROM events WHERE event_type IS NOT NULL")
def agg01_vocabulary(spark, sf_dir):
    return observations(spark, sf_dir).where("measurement_type IS NOT NULL").select("measurement_type").distinct()


@query(f"WITH {OBS_SQL} SELECT DISTINCT obs_id, h3_res3, location_weight FROM loc")
def agg02_distinct_candidates(spark, sf_dir):
    return features.locations(observations(spark, sf_dir)).select("obs_id", "h3_res3", "location_weight")


@query(f"WITH {OBS_SQL} SELECT h3_res3, len(list(obs_id)) AS n, min(obs_id) AS first_obs, round(sum(location_weight), 6) AS weight FROM loc GROUP BY 1")
def agg03_lists_by_cell(spark, sf_dir):
    held = observations(spark, sf_dir).where("location_weight IS NOT NULL").groupBy("h3_res3").agg(F.collect_list(F.struct("obs_id", "location_weight")).alias("l"))
    return rounded(held.select("h3_res3", F.size("l").cast("long").alias("n"), F.array_min("l.obs_id").alias("first_obs"), F.aggregate("l.location_weight", F.lit(0.0), lambda a, x: a + x).alias("weight")))


@query(f"WITH {OBS_SQL} SELECT obs_id, list(measurement_type ORDER BY measurement_type)[1] AS first_type, count(*) AS n FROM meas GROUP BY 1")
def agg04_lists_by_observation(spark, sf_dir):
    held = observations(spark, sf_dir).where("measurement_type IS NOT NULL").groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("measurement_type", "measurement_weight"))).alias("l"))
    return held.select("obs_id", F.col("l")[0]["measurement_type"].alias("first_type"), F.size("l").cast("long").alias("n"))


@query(f"WITH {OBS_SQL} SELECT loc.obs_id, h3_res3, measurement_type, round(location_weight * measurement_weight, 6) AS signal_weight FROM loc LEFT JOIN meas USING (obs_id)")
def agg05_paired_explode(spark, sf_dir):
    return rounded(features.paired_lists(observations(spark, sf_dir)))


@query(f"WITH {ATOMIC_SQL},\n{WIDE_SQL} SELECT h3_res3, timestamp, {', '.join(f'round(CAST({t} AS DOUBLE), 6) AS {t}' for t in TYPES)} FROM wide")
def agg06_pivot(spark, sf_dir):
    wide = features.pivot(features.atomic(observations(spark, sf_dir)), TYPES)
    return rounded(wide.select("h3_res3", "timestamp", *[F.col(t).cast("double").alias(t) for t in TYPES]))


@query(f"WITH {ATOMIC_SQL} SELECT h3_res3, timestamp, " + ", ".join(f"round(CAST(sum(CAST(signal_weight AS DECIMAL(28,10))) FILTER (measurement_type = '{t}') AS DOUBLE), 6) AS {t}_sum_w, nullif(count(*) FILTER (measurement_type = '{t}'), 0) AS {t}_cnt_w" for t in TYPES) + " FROM atomic GROUP BY ALL")
def agg07_pivot_sum_count(spark, sf_dir):
    wide = rounded(features.pivot_sum_count(features.atomic(observations(spark, sf_dir)), TYPES))
    return wide.select("h3_res3", "timestamp", *[x for t in TYPES for x in (f"{t}_sum_w", F.nullif(f"{t}_cnt_w", F.lit(0)).alias(f"{t}_cnt_w"))])


@query("SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM events")
def agg08_bounds(spark, sf_dir):
    return observations(spark, sf_dir).agg(F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"))


@query(f"WITH {OBS_SQL} SELECT loc.obs_id, h3_res3, measurement_type FROM loc LEFT JOIN meas ON meas.obs_id = loc.obs_id AND measurement_type <> 'view'")
def jon01_left(spark, sf_dir):
    o = observations(spark, sf_dir)
    loc, meas = o.where("location_weight IS NOT NULL").select("obs_id", "h3_res3"), o.where("measurement_type <> 'view'").select("obs_id", "measurement_type")
    return loc.join(meas, "obs_id", "left")


@query(f"WITH {OBS_SQL} SELECT h3_res3, loc.timestamp, measurement_type, round(location_weight * measurement_weight, 6) AS signal_weight FROM loc JOIN meas ON meas.obs_id = loc.obs_id AND meas.timestamp = loc.timestamp")
def jon02_two_keys(spark, sf_dir):
    return rounded(features.atomic_by_time(observations(spark, sf_dir)))


@query(f"WITH {ATOMIC_SQL} SELECT h3_res3, timestamp, measurement_type, round(signal_weight, 6) AS signal_weight FROM atomic")
def jon03_atomic(spark, sf_dir):
    return rounded(features.atomic(observations(spark, sf_dir)))


@query(f"WITH {OBS_SQL} SELECT loc.obs_id, h3_res3, date_trunc('hour', loc.timestamp) AS timestamp, measurement_type, round(location_weight * measurement_weight, 6) AS signal_weight FROM loc JOIN meas USING (obs_id)")
def q4_atomic_by_observation(spark, sf_dir):
    """Signals of different observations kept apart."""
    return rounded(features.atomic(observations(spark, sf_dir), dedupe=False))


@query(f"{_BASE}\nSELECT timestamp, h3_res3, {', '.join(f'round(CAST({t} AS DOUBLE), 6) AS {t}' for t in TYPES)} FROM dense")
def jon04_densify(spark, sf_dir):
    o = observations(spark, sf_dir)
    d = features.densify(features.pivot(features.atomic(o), TYPES), features.hourly_grid(o), TYPES)
    return rounded(d.select("timestamp", "h3_res3", *[F.col(t).cast("double").alias(t) for t in TYPES]))


@query(f"WITH {OBS_SQL} SELECT obs_id, 'loc' AS side FROM loc WHERE obs_id IN (SELECT obs_id FROM loc WHERE h3_res3 = 'c03') UNION ALL SELECT obs_id, 'meas' FROM meas WHERE obs_id IN (SELECT obs_id FROM loc WHERE h3_res3 = 'c03')")
def jon08_semi(spark, sf_dir):
    """All rows of the observations that touch a cell."""
    rows = features.candidates(observations(spark, sf_dir), "c03")
    return rows.select("obs_id", F.when(F.col("location_weight").isNotNull(), "loc").otherwise("meas").alias("side"))


def label_sql(kinds, windows=WINDOWS) -> str:
    columns = []
    for kind in kinds:
        for w, span in windows.items():
            ahead = f"OVER (PARTITION BY h3_res3 ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND {span} FOLLOWING)"
            here = f"OVER (PARTITION BY h3_res3 ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND {span - 1} FOLLOWING)"
            columns.append({
                "future": f"CASE WHEN count(*) {ahead} >= {span} THEN max(event) {ahead} ELSE 0 END AS label_future_{w}",
                "inclusive": f"CASE WHEN count(*) {here} >= {span} THEN max(event) {here} END AS label_inclusive_{w}",
                "coarse": f"CASE WHEN count(*) {here} >= {span} THEN max(event) {here} END AS label_{w}",
                "cons": f"CASE WHEN count(*) {here} >= {span} THEN coalesce(max(event) {ahead}, 0) END AS label_{w}_cons",
            }[kind])
    return f"WITH {EVENTS_SQL}\nSELECT timestamp, h3_res3, event, {', '.join(columns)} FROM hourly"


def _hourly(spark, sf_dir):
    grid = features.hourly_grid(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").alias("timestamp")))
    return labels.hourly_events(errors(spark, sf_dir), grid)


@query(f"WITH {EVENTS_SQL} SELECT h3_res3, timestamp, event FROM hourly")
def win09_hourly_events(spark, sf_dir):
    return _hourly(spark, sf_dir)


@query(label_sql(("inclusive",)))
def win06_inclusive_labels(spark, sf_dir):
    return labels.build(_hourly(spark, sf_dir), ("inclusive",))


@query(label_sql(("future",)))
def win07_future_labels(spark, sf_dir):
    return labels.build(_hourly(spark, sf_dir), ("future",))


@query(label_sql(("cons",)))
def win08_conservative_labels(spark, sf_dir):
    return labels.build(_hourly(spark, sf_dir), ("cons",))


@query(label_sql(("coarse", "cons")))
def api06_labels_v1(spark, sf_dir):
    return labels.build(_hourly(spark, sf_dir), ("coarse", "cons"))


@query(label_sql(("future", "inclusive")))
def api07_labels_v2(spark, sf_dir):
    return labels.build(_hourly(spark, sf_dir))


@query(f"{_BASE},\n{EVENTS_SQL[EVENTS_SQL.index('happened'):]},\nf AS ({rolling_sql('dense', {'6h': 6})}),\nl AS (SELECT timestamp, h3_res3, CASE WHEN count(*) OVER w >= 6 THEN max(event) OVER w ELSE 0 END AS label_exclusive_6h FROM hourly WINDOW w AS (PARTITION BY h3_res3 ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING))\nSELECT f.*, l.label_exclusive_6h, CASE WHEN f.timestamp < TIMESTAMP '2024-01-15' THEN 'train' WHEN f.timestamp < TIMESTAMP '2024-01-22' THEN 'val' WHEN f.timestamp < TIMESTAMP '2024-01-29' THEN 'test' END AS split FROM f JOIN l ON l.timestamp = f.timestamp AND l.h3_res3 = f.h3_res3")
def ml02_training_frame(spark, sf_dir):
    """Features with labels and half-open time splits."""
    from lodeweave.operators.ml import split_column

    f = features.build(observations(spark, sf_dir), types=TYPES, windows={"6h": 6})
    l = labels.exclusive(labels.build(_hourly(spark, sf_dir), ("future",), {"6h": 6})).select("timestamp", "h3_res3", "label_exclusive_6h")  # noqa: E741
    splits = {"train": ("2024-01-01", "2024-01-15"), "val": ("2024-01-15", "2024-01-22"), "test": ("2024-01-22", "2024-01-29")}
    return rounded(f.join(l, ["timestamp", "h3_res3"]).withColumn("split", split_column(splits)))


@query()
def ml03_04_boosted_trees(spark, sf_dir):
    """Predictions of the test split by trees trained on the train split and stopped by the val split; not expressible in SQL."""
    from lodeweave.operators import ml

    splits = {"train": ("2024-01-01", "2024-01-15"), "val": ("2024-01-15", "2024-01-22"), "test": ("2024-01-22", "2024-01-29")}
    f = features.build(observations(spark, sf_dir), types=TYPES, windows={"6h": 6})
    l = labels.exclusive(labels.build(_hourly(spark, sf_dir), ("future",), {"6h": 6})).select("timestamp", "h3_res3", "label_exclusive_6h")  # noqa: E741
    data = ml.dataset(f.join(l, ["timestamp", "h3_res3"]), splits=splits).cache()
    model = ml.train(data, {"max_depth": 3, "max_bin": 32}, rounds=3)
    data.unpersist()
    return ml.predict(model, data.where("split = 'test'")).select("label", "prediction")
