"""Streams against the same sums and islands in a batch."""

from pyspark.sql import functions as F

from lodeweave.operators import opscore
from lodeweave.plans.roles import cell_of
from lodeweave.streaming import hourly
from tests.conftest import DATA


def drained(spark, frame, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def source(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    rows = e.select(cell_of(F.col("user_id"), 0).alias("h3_cell"), cell_of(F.col("user_id"), 0).alias("h3_res3"), F.col("ts").alias("timestamp"), F.col("event_type").alias("measurement_type"), F.col("value").cast("decimal(18,2)").alias("signal_weight"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    back = spark.read.parquet(str(tmp_path / "in"))
    return back, hourly.read_events(spark, str(tmp_path / "in"), back.schema)


def test_hourly_sums(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    got = drained(spark, hourly.hourly_signals(stream, "60 days"), "sums")
    want = batch.groupBy("h3_res3", F.date_trunc("hour", "timestamp").alias("timestamp"), "measurement_type").agg(F.sum("signal_weight").alias("signal"), F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_are_islands(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    got = drained(spark, hourly.sessions(stream, "2 hours", "60 days"), "runs")
    islands = opscore.gap_segments(batch.select("h3_cell", "timestamp")).groupBy("h3_cell", "seg_id").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count("*").alias("n"))
    assert sorted((r.h3_cell, r.start, r.end, r.n) for r in got.collect()) == sorted((r.h3_cell, r.start, r.end, r.n) for r in islands.collect())
