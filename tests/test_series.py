"""Features and labels against vectors worked out by hand."""

import datetime as dt

import pytest

from lodeweave.operators import features, labels, opscore
from lodeweave.sources.schemas import WINDOWS


def at(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


def series(spark, values):
    return spark.createDataFrame([("c", at(i), v) for i, v in enumerate(values)], "h3_res3 string, timestamp timestamp_ntz, event int")


def test_rolling_sums_and_counts_are_null_until_full(spark):
    dense = spark.createDataFrame([("c", at(i), v) for i, v in enumerate([1, 0, 2, 0])], "h3_res3 string, timestamp timestamp_ntz, x long").selectExpr("h3_res3", "timestamp", "cast(x as decimal(28,10)) x")
    rows = features.rolling(dense, ["x"], {"w": 3}).orderBy("timestamp").collect()
    assert [r.x__sum_w for r in rows] == [None, None, 3, 2]
    assert [r.x__count_w for r in rows] == [None, None, 2, 1]


@pytest.mark.parametrize(("kind", "want"), [("inclusive", [1, 1, 1, 0, 1, 1, None, None]), ("future", [1, 1, 0, 1, 1, 0, 0, 0]), ("cons", [1, 1, 0, 1, 1, 1, None, None])])
def test_labels(spark, kind, want):
    rows = labels.build(series(spark, [0, 0, 1, 0, 0, 0, 1, 0]), (kind,), {"w": 3}).orderBy("timestamp").collect()
    assert [r[-1] for r in rows] == want


def test_future_tail_may_be_null(spark):
    rows = labels.build(series(spark, [0, 1]), ("future",), {"w": 2}, null_tail=True).collect()
    assert [r[-1] for r in rows] == [None, None]
    with pytest.raises(ValueError, match="kind"):
        labels.label("none", 1, None or features.Window.partitionBy("h3_res3").orderBy("timestamp"))


def test_exclusive_is_future(spark):
    rows = labels.exclusive(labels.build(series(spark, [0, 0, 1, 0, 0, 0, 0, 0, 0]), windows=WINDOWS)).collect()
    assert all(r.label_exclusive_6h == r.label_future_6h for r in rows)


@pytest.mark.parametrize(("times", "include_last", "want"), [((at(0, 10), at(3)), False, [0, 1, 2]), ((at(0, 10), at(3, 1)), False, [0, 1, 2, 3]), ((at(0, 10), at(3)), True, [0, 1, 2, 3]), ((at(5), at(5)), False, [])])
def test_grid(spark, times, include_last, want):
    frame = spark.createDataFrame([(t,) for t in times], "timestamp timestamp_ntz")
    assert [r.timestamp.hour for r in features.hourly_grid(frame, include_last=include_last).orderBy("timestamp").collect()] == want


def observations(spark, rows):
    return spark.createDataFrame(rows, "obs_id long, timestamp string, h3_res3 string, location_weight double, location_lat double, location_lon double, measurement_type string, measurement_weight double")


def test_equal_signals_of_two_observations_count_once_unless_kept_apart(spark):
    rows = [(i, "2024-01-01 00:10:00", "c", 0.5, 0.0, 0.0, None, None) for i in (1, 2)] + [(i, "2024-01-01 00:10:00", None, None, None, None, "a", 2.0) for i in (1, 2)]
    rows += [(3, "bad", "c", 0.5, 0.0, 0.0, None, None), (3, "bad", None, None, None, None, "b", 1.0), (4, "2024-01-01 01:30:00", "c", 0.5, 0.0, 0.0, None, None)]
    obs = observations(spark, rows)
    sums = lambda **k: [r.a__sum_1h for r in features.build(obs, windows={"1h": 1}, **k).orderBy("timestamp").collect()]
    assert sums() == [1.0, 0.0] and sums(dedupe=False) == [2.0, 0.0]
    assert features.vocabulary(obs) == ["a", "b"]
    assert features.atomic(obs).where("timestamp IS NULL").count() == 1


def test_hourly_events_count_an_hour_once(spark):
    grid = spark.createDataFrame([(at(h),) for h in range(3)], "timestamp timestamp_ntz")
    events = spark.createDataFrame([("c", at(1, 5), 1), ("c", at(1, 40), 1)], "h3_res3 string, timestamp timestamp_ntz, label int")
    assert [r.event for r in labels.hourly_events(events, grid).orderBy("timestamp").collect()] == [0, 1, 0]
    cells = spark.createDataFrame([("c",), ("d",)], "h3_res3 string")
    assert labels.hourly_events(events, grid, cells).count() == 6


def test_gap_segments(spark):
    times = [at(0), at(1), at(2, 59), at(5), at(6)]
    frame = spark.createDataFrame([("c", t) for t in times], "h3_cell string, timestamp timestamp_ntz")
    rows = opscore.gap_segments(frame).orderBy("timestamp").collect()
    assert [r.dt_hours for r in rows] == [None, 1, 1, 2, 1]
    assert [r.new_seg for r in rows] == [1, 0, 0, 1, 0]
    assert [(r.seg_id, r.seg_pos, r.seg_len) for r in rows] == [(1, 0, 3), (1, 1, 3), (1, 2, 3), (2, 0, 2), (2, 1, 2)]


def test_moving_average_skips_nulls_and_restarts(spark):
    values = [0.0, 1.0, 2.0, 0.0, None, 4.0]
    frame = spark.createDataFrame([("c", at(i), v, 1 if i < 4 else 2) for i, v in enumerate(values)] + [("d", at(0), 9.0, 1)], "h3_cell string, timestamp timestamp_ntz, x double, seg_id int")
    rows = opscore.ewma(frame, {"whole": ("x", 0.3, False), "part": ("x", 0.3, True)}).orderBy("h3_cell", "timestamp").collect()
    assert [round(r.part, 9) if r.part is not None else None for r in rows] == [0, 0.3, 0.81, 0.567, None, 4.0, 9.0]
    assert [round(r.whole, 9) for r in rows] == [0, 0.3, 0.81, 0.567, 0.567, round(0.7 * 0.567 + 1.2, 9), 9.0]


def test_features_on_both_grids_agree_where_both_have_rows(spark):
    rows = [(i, f"2024-01-01 0{i}:00:00", "c", 1.0, 0.0, 0.0, None, None) for i in range(4)] + [(i, f"2024-01-01 0{i}:00:00", None, None, None, None, "a", float(i)) for i in range(4)]
    obs = observations(spark, rows)
    a = {r.timestamp: r.a__sum_1h for r in features.build(obs, windows={"1h": 1}).collect()}
    b = {r.timestamp: r.a__sum_1h for r in features.build(obs, grid="per_cell", windows={"1h": 1}).collect()}
    assert set(a) < set(b) and all(b[t] == v for t, v in a.items())


def test_averages_run_on_over_batches(spark):
    import random

    rng, rows, want = random.Random(2), [], {}
    for cell in ("a", "b", None):
        y, seg = {}, 0
        for h in range(60):
            if rng.random() < 0.1:
                seg += 1
            x = None if rng.random() < 0.2 else rng.random()
            rows.append((cell, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), seg, x))
            for name, a, key in (("long", 0.02, None), ("short", 0.3, seg)):
                if (name, key) not in y and name == "short":
                    y = {k: v for k, v in y.items() if k[0] == "long"}
                if x is not None:
                    y[name, key] = (1 - a) * y[name, key] + a * x if (name, key) in y else x
                want.setdefault((cell, h), []).append(y.get((name, key)))
    frame = spark.createDataFrame(rows, "h3_cell string, timestamp timestamp_ntz, seg_id int, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.h3_cell, (r.timestamp - dt.datetime(2024, 1, 1)) // dt.timedelta(hours=1)): [r.long, r.short] for r in opscore.ewma(frame, {"long": ("x", 0.02, False), "short": ("x", 0.3, True)}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys()
    for k, pair in want.items():
        assert all((a is None or a != a) and b is None if b is None else abs(a - b) < 1e-9 for a, b in zip(got[k], pair)), (k, got[k], pair)


def test_a_stray_timestamp_is_an_error(spark):
    frame = spark.createDataFrame([(at(0),), (dt.datetime(9999, 1, 1),)], "timestamp timestamp_ntz")
    with pytest.raises(Exception, match="grid would span"):
        features.hourly_grid(frame).collect()
