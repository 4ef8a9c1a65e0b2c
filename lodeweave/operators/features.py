"""Hourly rolling features of weighted observations by geo cell.

Observations give candidate cells (with weights) and measurements (with weights) of the same obs_id;
their product is a signal. Signals are summed by cell, hour and type, put on a dense hourly grid, and
rolled over row windows. One exchange by obs_id joins, one by (cell, hour) pivots with map-side sums,
and one by cell serves the grid join and all windows, which share one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.scalars import hour, next_hour, parse_time
from lodeweave.sources.schemas import WINDOWS

#: Signals are summed as decimals, so that sums don't depend on the order of rows.
EXACT = "decimal(28,10)"
#: A hundred years.
MAX_HOURS = 876_600


def locations(obs: DataFrame) -> DataFrame:
    return obs.where("location_weight IS NOT NULL").select("obs_id", "h3_res3", "location_weight", "location_lat", "location_lon", F.col("timestamp").cast("string").alias("timestamp_str")).distinct()


def measurements(obs: DataFrame) -> DataFrame:
    return obs.where("measurement_weight IS NOT NULL").select("obs_id", "measurement_type", "measurement_weight").distinct()


def atomic(obs: DataFrame, dedupe: bool = True) -> DataFrame:
    """h3_res3, timestamp (hour), measurement_type, signal_weight.

    dedupe: equal signals of a cell, hour and type count once, even of different observations; without it each
    observation's signals stay, with obs_id.
    """
    joined = locations(obs).join(measurements(obs), "obs_id")
    signal = (F.col("location_weight") * F.col("measurement_weight")).alias("signal_weight")
    columns = ["h3_res3", hour(parse_time(F.col("timestamp_str"))).alias("timestamp"), "measurement_type", signal]
    return joined.select(*columns).distinct() if dedupe else joined.select("obs_id", *columns)


def atomic_by_time(obs: DataFrame) -> DataFrame:
    """Signals joined on obs_id and timestamp, not deduplicated, at raw timestamps."""
    loc = obs.where("location_weight IS NOT NULL").select("obs_id", "timestamp", "h3_res3", "location_weight")
    meas = obs.where("measurement_weight IS NOT NULL AND measurement_type IS NOT NULL").select("obs_id", "timestamp", "measurement_type", "measurement_weight")
    return loc.join(meas, ["obs_id", "timestamp"]).select("h3_res3", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "measurement_type", (F.col("location_weight") * F.col("measurement_weight")).alias("signal_weight"))


def vocabulary(obs: DataFrame) -> list[str]:
    """The measurement types in ascending order; they name columns, so their number is small."""
    return [r[0] for r in obs.where("measurement_type IS NOT NULL").select("measurement_type").distinct().orderBy("measurement_type").collect()]


def hourly_grid(times: DataFrame, column: str = "timestamp", include_last: bool = False) -> DataFrame:
    """One row per hour from the first to before the last timestamp rounded up; `include_last` adds that hour if it is on the hour.

    A span of over MAX_HOURS, as by one stray timestamp, is an error: so the grid is small enough to send.
    """
    bounds = times.agg(hour(F.min(column)).alias("lo"), next_hour(F.max(column)).alias("hi"), F.max(column).alias("last"))
    hi = F.when(F.col("hi") == F.col("last"), F.col("hi") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("hi")) if include_last else F.col("hi")
    hours = bounds.select("lo", hi.alias("hi"))
    steps = F.expr(f"if(timestampdiff(HOUR, lo, hi) > {MAX_HOURS}, raise_error(concat('the grid would span ', lo, ' to ', hi)), if(hi > lo, sequence(lo, hi - INTERVAL 1 HOUR, INTERVAL 1 HOUR), array()))")
    return hours.select(F.explode(steps.cast("array<timestamp_ntz>")).alias("timestamp"))


def pivot(signals: DataFrame, types: Sequence[str]) -> DataFrame:
    """Sum of signals by cell, timestamp and type, a column for each of types."""
    return signals.groupBy("h3_res3", "timestamp").pivot("measurement_type", list(types)).agg(F.sum(F.col("signal_weight").cast(EXACT)))


def pivot_sum_count(signals: DataFrame, types: Sequence[str]) -> DataFrame:
    """Sum and count by cell, timestamp and type in one pass: columns {type}_sum_w and {type}_cnt_w."""
    return signals.groupBy("h3_res3", "timestamp").pivot("measurement_type", list(types)).agg(F.sum(F.col("signal_weight").cast(EXACT)).cast("double").alias("sum_w"), F.count("signal_weight").alias("cnt_w"))


def densify(wide: DataFrame, grid: DataFrame, types: Sequence[str]) -> DataFrame:
    """Each cell on each hour of the grid; hours without signals are 0. The grid has one row an hour: it is small enough to send."""
    cells = wide.select("h3_res3").distinct().join(F.broadcast(grid))
    return cells.join(wide, ["h3_res3", "timestamp"], "left").na.fill(0).select("timestamp", "h3_res3", *[F.coalesce(F.col(t), F.lit(0).cast(EXACT)).alias(t) for t in types])


def upsample(wide: DataFrame, types: Sequence[str]) -> DataFrame:
    """Each cell on its own hourly steps from its first to its last timestamp; rows off these steps are lost."""
    steps = wide.groupBy("h3_res3").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).select("h3_res3", F.explode(F.expr("sequence(lo, hi, INTERVAL 1 HOUR)").cast("array<timestamp_ntz>")).alias("timestamp"))
    return steps.join(wide, ["h3_res3", "timestamp"], "left").select("timestamp", "h3_res3", *[F.coalesce(F.col(t), F.lit(0).cast(EXACT)).alias(t) for t in types])


def full_window(c: Column, value: Column, span: int, w) -> Column:
    """value where the window has all of its rows, else null."""
    return F.when(F.count(F.lit(1)).over(w) >= span, value)


def rolling(dense: DataFrame, types: Sequence[str], windows: dict[str, int] = WINDOWS) -> DataFrame:
    """{type}__sum_{w} and {type}__count_{w} (hours with a signal) over the last rows of each cell; null until a window is full."""
    series = Window.partitionBy("h3_res3").orderBy("timestamp")
    columns = []
    for label, span in windows.items():
        w = series.rowsBetween(-(span - 1), 0)
        columns += [full_window(F.col(t), F.sum(t).over(w), span, w).cast("double").alias(f"{t}__sum_{label}") for t in types]
        columns += [full_window(F.col(t), F.sum((F.col(t) > 0).cast("int")).over(w), span, w).alias(f"{t}__count_{label}") for t in types]
    return dense.select("timestamp", "h3_res3", *columns)


def build(obs: DataFrame, grid: str = "global", dedupe: bool = True, windows: dict[str, int] = WINDOWS, types: Sequence[str] | None = None, include_last: bool = False) -> DataFrame:
    """Features of all cells. grid: global (one for all cells) or per_cell (each from its first to its last timestamp)."""
    types = list(types) if types is not None else vocabulary(obs)
    if grid == "per_cell":
        return rolling(upsample(pivot(atomic_by_time(obs), types), types), types, windows)
    hours = hourly_grid(obs.select(parse_time(F.col("timestamp").cast("string")).alias("timestamp")), include_last=include_last)
    signals = atomic(obs, dedupe)
    return rolling(densify(pivot(signals, types), hours, types), types, windows)


def candidates(obs: DataFrame, cell: str) -> DataFrame:
    """All rows of the observations that touch a cell."""
    touching = obs.where(F.col("h3_res3") == cell).select("obs_id").distinct()
    return obs.join(touching, "obs_id", "left_semi")


def paired_lists(obs: DataFrame) -> DataFrame:
    """A cell's (obs_id, weight) with the (type, weight) of each obs_id: obs_id, h3_res3, measurement_type, signal_weight.

    What lists by cell and by obs_id, exploded side by side, would give; no list is made, so a cell may be of any size.
    """
    held = obs.where("location_weight IS NOT NULL").select("obs_id", "h3_res3", "location_weight")
    measured = obs.where("measurement_type IS NOT NULL").select("obs_id", "measurement_type", "measurement_weight")
    rows = held.join(measured, "obs_id", "left")
    return rows.select("obs_id", "h3_res3", "measurement_type", (F.col("location_weight") * F.col("measurement_weight")).alias("signal_weight"))
