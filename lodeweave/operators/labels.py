"""Forward-looking labels on an hourly grid, by windows over the rows ahead of each hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.scalars import hour
from lodeweave.operators.features import full_window
from lodeweave.sources.schemas import WINDOWS

KINDS = ("future", "inclusive", "coarse", "cons")


def hourly_events(events: DataFrame, grid: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """h3_res3, timestamp, event for each cell on each hour. Several events in one hour count once.

    events: h3_res3, timestamp, label. cells: h3_res3 of the cells to build (default: those with events).
    """
    hourly = events.groupBy("h3_res3", hour(F.col("timestamp")).alias("timestamp")).agg(F.max("label").cast("int").alias("event"))
    wanted = (hourly if cells is None else cells).select("h3_res3").distinct()
    return wanted.join(F.broadcast(grid)).join(hourly, ["h3_res3", "timestamp"], "left").select("h3_res3", "timestamp", F.coalesce("event", F.lit(0)).alias("event"))


def label(kind: str, span: int, series, null_tail: bool = False) -> Column:
    """future: an event in the next `span` hours; inclusive and coarse: in this and the following span - 1;
    cons: as future, with 0 beyond the end. Where the window is cut off: 0 for future (null with null_tail), else null."""
    ahead, here = series.rowsBetween(1, span), series.rowsBetween(0, span - 1)
    if kind == "future":
        found = full_window(F.col("event"), F.max("event").over(ahead), span, ahead)
        return found if null_tail else F.coalesce(found, F.lit(0))
    if kind in ("inclusive", "coarse"):
        return full_window(F.col("event"), F.max("event").over(here), span, here)
    if kind == "cons":
        return full_window(F.col("event"), F.coalesce(F.max("event").over(ahead), F.lit(0)), span, here)
    raise ValueError(f"kind must be one of {KINDS}")


def build(hourly: DataFrame, kinds: Sequence[str] = ("future", "inclusive"), windows: dict[str, int] = WINDOWS, null_tail: bool = False) -> DataFrame:
    """timestamp, h3_res3, event and a label for each kind and window; exclusive labels are the future ones."""
    series = Window.partitionBy("h3_res3").orderBy("timestamp")
    name = {"future": "label_future_{}", "inclusive": "label_inclusive_{}", "coarse": "label_{}", "cons": "label_{}_cons"}
    return hourly.select("timestamp", "h3_res3", "event", *[label(k, span, series, null_tail).alias(name[k].format(w)) for k in kinds for w, span in windows.items()])


def exclusive(labels: DataFrame, window: str = "6h") -> DataFrame:
    """labels with label_exclusive_{window}, the name that training uses for label_future_{window}."""
    return labels.withColumn(f"label_exclusive_{window}", F.col(f"label_future_{window}"))
