"""Operational scores of multi-horizon predictions: joined horizons, gap-aware dynamics, a bounded score.

All window functions use two specifications, by cell and by (cell, segment). The segment is derived
within the cell, so both are served by one exchange by cell. The moving averages have no built-in form;
they run over the cells' sorted rows in Arrow batches, with the state of one cell at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.scalars import at_least, clip, hours_between
from lodeweave.sources.schemas import HORIZONS


@dataclass(frozen=True)
class Params:
    """Fixed values of the two presets."""

    roll_mean: int = 24
    roll_std: int = 24
    roll_max: int = 6
    min_short: int = 5
    min_long: int = 50
    long_window: int = 720
    alpha: float = 0.30
    long_alpha: float = 0.02
    std_floor: float = 1e-3
    z_clip: float = 5.0
    w_1hr: float = 0.55
    w_6hr: float = 0.25
    w_12hr: float = 0.20
    w_z_long: float = 0.05
    w_z_short: float = 0.05
    w_delta: float = 0.05
    w_rollmax: float = 0.05
    min_seg_points: int = 6


V2 = Params()
V1 = Params(w_z_long=0.0, w_z_short=0.15, w_delta=0.10, w_rollmax=0.10, min_seg_points=0)
PRESETS = {"v2": V2, "v1": V1}


def join_horizons(predictions: dict[str, DataFrame]) -> DataFrame:
    """h3_cell, timestamp, label_{h}, pred_{h}: all rows of all horizons; what is missing is 0."""
    out = None
    for h in HORIZONS:
        own = predictions[h].select("h3_cell", "timestamp", F.col("label").cast("double").alias(f"label_{h}"), F.col("prediction").cast("double").alias(f"pred_{h}"))
        out = own if out is None else out.join(own, ["h3_cell", "timestamp"], "full_outer")
    return out.na.fill(0.0, [f"{k}_{h}" for h in HORIZONS for k in ("label", "pred")])


def _cells():
    return Window.partitionBy("h3_cell").orderBy("timestamp")


def _segments():
    return Window.partitionBy("h3_cell", "seg_id").orderBy("timestamp")


def gap_segments(df: DataFrame) -> DataFrame:
    """dt_hours, new_seg, seg_id (from 1), seg_pos (from 0), seg_len: a gap of two hours or more starts a segment."""
    dt = hours_between(F.lag("timestamp").over(_cells()), F.col("timestamp"))
    df = df.withColumn("dt_hours", dt).withColumn("new_seg", F.when(F.col("dt_hours").isNull() | (F.col("dt_hours") > 1), 1).otherwise(0))
    df = df.withColumn("seg_id", F.sum("new_seg").over(_cells().rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumns({"seg_pos": F.row_number().over(_segments()) - 1, "seg_len": F.count(F.lit(1)).over(Window.partitionBy("h3_cell", "seg_id"))})


def ewma(df: DataFrame, averages: dict[str, tuple[str, float, bool]], dealt: bool = False) -> DataFrame:
    """Moving averages y = (1 - a) y' + a x, skipping nulls: {name: (column, a, restarts at each segment)}.

    Rows are hashed by cell and sorted by time; the averages run on from batch to batch, so a cell of any
    length is never gathered. dealt: the rows of a cell are in one partition already.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{k}` double" for k in averages])

    def same(a, b) -> bool:
        return a == b or pd.isna(a) and pd.isna(b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, segment, state = None, None, {}
        for batch in batches:
            if batch.empty:
                yield batch.assign(**{k: pd.Series(dtype="float64") for k in averages})
                continue
            cells = batch["h3_cell"]
            segments = batch["seg_id"] if "seg_id" in batch else pd.Series(0, index=batch.index)
            new_cell = (cells != cells.shift()) & ~(cells.isna() & cells.shift().isna())
            of_cell, of_segment = new_cell.cumsum().to_numpy(), (new_cell | (segments != segments.shift())).cumsum().to_numpy()
            goes_on = bool(state) and same(cells.iloc[0], cell)
            out = {}
            for k, (c, a, restarts) in averages.items():
                x, groups = batch[c].to_numpy("float64", na_value=np.nan), of_segment if restarts else of_cell
                carried = goes_on and not (restarts and segments.iloc[0] != segment)
                if carried:  # the average so far stands before the group that goes on
                    x, groups = np.concatenate([[state[k]], x]), np.concatenate([groups[:1], groups])
                y = pd.Series(x).groupby(groups).ewm(alpha=a, adjust=False, ignore_na=True).mean().to_numpy()
                out[k] = y[1:] if carried else y
            cell, segment, state = cells.iloc[-1], segments.iloc[-1], {k: v[-1] for k, v in out.items()}
            yield batch.assign(**out)

    return (df if dealt else df.repartition("h3_cell")).sortWithinPartitions("h3_cell", "timestamp").mapInPandas(run, schema)


def _spread(c: str, w, need: int) -> tuple[Column, Column]:
    enough = F.count(c).over(w) >= need
    return F.when(enough, F.avg(c).over(w)), F.when(enough, F.stddev_samp(c).over(w))


def _bounded(x: Column, mean: str, std: str, p: Params) -> Column:
    return clip((x - F.col(mean)) / at_least(F.col(std), p.std_floor), -p.z_clip, p.z_clip)


def long_baseline(df: DataFrame, p: Params = V2, averages: bool = True) -> DataFrame:
    """ewma_long_1hr, rmean_long_1hr, rstd_long_1hr, z_long_raw_1hr, z_long_1hr over a cell's observations, across gaps."""
    mean, std = _spread("pred_1hr", _cells().rowsBetween(-(p.long_window - 1), 0), p.min_long)
    df = df.withColumns({"rmean_long_1hr": mean, "rstd_long_1hr": std})
    df = df.withColumn("z_long_raw_1hr", _bounded(F.col("pred_1hr"), "rmean_long_1hr", "rstd_long_1hr", p))
    df = df.withColumn("z_long_1hr", F.tanh("z_long_raw_1hr"))
    return ewma(df, {"ewma_long_1hr": ("pred_1hr", p.long_alpha, False)}) if averages else df


def dynamics(df: DataFrame, preset: str = "v2", averages: bool = True) -> DataFrame:
    """Segment-wise deltas, averages, rolling maxima and z-scores of both presets."""
    p, seg = PRESETS[preset], _segments()
    df = gap_segments(df)
    mean, std = _spread("pred_1hr", seg.rowsBetween(-(p.roll_mean - 1), 0), p.min_short)
    raw = "_raw" if preset == "v2" else ""
    df = df.withColumns({
        **{f"d1_{h}{raw}": F.col(f"pred_{h}") - F.lag(f"pred_{h}").over(seg) for h in HORIZONS},
        "rmax_1hr": F.max("pred_1hr").over(seg.rowsBetween(-(p.roll_max - 1), 0)),
        "rmean_1hr": mean,
        "rstd_1hr": std,
    })
    start = F.col("new_seg") == 1
    if preset == "v1":
        z = F.when(F.col("rstd_1hr") > 1e-12, (F.col("pred_1hr") - F.col("rmean_1hr")) / F.col("rstd_1hr")).otherwise(0.0)
        df = df.withColumns({"z_1hr": z, "d1_1hr": F.when(~start, F.col("d1_1hr"))}).drop("seg_pos", "seg_len")
    else:
        df = df.withColumns({"z_short_raw_1hr": _bounded(F.col("pred_1hr"), "rmean_1hr", "rstd_1hr", p), "d1_1hr_raw": F.when(~start, F.col("d1_1hr_raw"))})
        trusted = F.col("seg_pos") >= p.min_seg_points
        gated = {"z_short_1hr": F.tanh("z_short_raw_1hr"), "d1_1hr": F.tanh(F.coalesce("d1_1hr_raw", F.lit(0.0))), "rmax_1hr": F.col("rmax_1hr")}
        df = df.withColumns({k: F.when(trusted, v).otherwise(0.0) for k, v in gated.items()})
    return ewma(df, {f"ewma_{h}": (f"pred_{h}", p.alpha, True) for h in HORIZONS}) if averages else df


def score(df: DataFrame, preset: str = "v2") -> DataFrame:
    """ops_score_raw and ops_score: the weighted horizons and dynamics; nulls count as 0."""
    p = PRESETS[preset]
    z_long = "z_long_1hr" if preset == "v2" else None
    terms = [("pred_1hr", p.w_1hr), ("pred_6hr", p.w_6hr), ("pred_12hr", p.w_12hr), (z_long, p.w_z_long), ("z_short_1hr" if preset == "v2" else "z_1hr", p.w_z_short), ("d1_1hr", p.w_delta), ("rmax_1hr", p.w_rollmax)]
    total = None
    for name, weight in terms:
        if name:
            term = F.lit(weight) * F.coalesce(F.col(name), F.lit(0.0))
            total = term if total is None else total + term
    return df.withColumns({"ops_score_raw": total, "ops_score": total})


def run(predictions: dict[str, DataFrame], preset: str = "v2", averages: bool = True) -> DataFrame:
    """Scored rows of three horizons' predictions.

    They are dealt by cell once: all windows, and at last all moving averages in one pass, keep to that.
    """
    df, p = join_horizons(predictions).repartition("h3_cell"), PRESETS[preset]
    means = {f"ewma_{h}": (f"pred_{h}", p.alpha, True) for h in HORIZONS}
    if preset == "v2":
        df = long_baseline(df, averages=False)
        means["ewma_long_1hr"] = ("pred_1hr", p.long_alpha, False)
    df = dynamics(df, preset, averages=False)
    return score(ewma(df, means, dealt=True) if averages else df, preset)


def write(scored: DataFrame, path: str, fracs: tuple[float, ...] = (0.001, 0.01, 0.05), score_col: str = "ops_score", label_col: str = "label_1hr") -> list[str]:
    """Write the scored rows and, next to them, the per-hour metrics of each fraction; return the paths."""
    from lodeweave.operators.metrics import topk_metrics

    scored.write.mode("overwrite").parquet(path)
    metrics = topk_metrics(scored.sparkSession.read.parquet(path), score_col, label_col, fracs).cache()
    paths = [path]
    for frac in fracs:
        paths.append(path.removesuffix(".parquet") + f".metrics_top{frac:.4f}.parquet")
        metrics.where(F.col("frac") == frac).drop("frac").orderBy("timestamp").write.mode("overwrite").parquet(paths[-1])
    metrics.unpersist()
    return paths
