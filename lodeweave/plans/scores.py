"""Queries over predictions: dynamics, scores and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave.operators import metrics, ml, opscore
from lodeweave.plans.registry import query
from lodeweave.plans.roles import HORIZON_SQL, horizons, rounded, table
from lodeweave.sources.tables import as_predictions

_SEG = f"WITH {HORIZON_SQL}"
_OVER = "OVER (PARTITION BY h3_cell, seg_id ORDER BY timestamp)"
_LAST = lambda n: f"OVER (PARTITION BY h3_cell, seg_id ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_LONG = "OVER (PARTITION BY h3_cell ORDER BY timestamp ROWS BETWEEN 719 PRECEDING AND CURRENT ROW)"


def _joined(spark, sf_dir):
    return opscore.join_horizons({h: as_predictions(d) for h, d in horizons(spark, sf_dir).items()})


@query(f"{_SEG} SELECT * FROM joined")
def jon06_full_outer(spark, sf_dir):
    return _joined(spark, sf_dir)


@query(f"{_SEG} SELECT h3_cell, timestamp, dt_hours, new_seg, seg_id, seg_pos, seg_len FROM seg")
def win12_gap_segments(spark, sf_dir):
    """Hour gaps, islands, positions and lengths."""
    return opscore.gap_segments(_joined(spark, sf_dir)).select("h3_cell", "timestamp", "dt_hours", "new_seg", "seg_id", "seg_pos", "seg_len")


@query(f"{_SEG} SELECT h3_cell, timestamp, {', '.join(f'round(pred_{h} - lag(pred_{h}) {_OVER}, 6) AS d1_{h}_raw' for h in ('1hr', '6hr', '12hr'))} FROM seg")
def win14_deltas(spark, sf_dir):
    return rounded(opscore.dynamics(_joined(spark, sf_dir), averages=False).select("h3_cell", "timestamp", "d1_1hr_raw", "d1_6hr_raw", "d1_12hr_raw"))


_EWMA = f"""{_SEG},
numbered AS (SELECT h3_cell, timestamp, pred_1hr, seg_id, row_number() OVER (PARTITION BY h3_cell ORDER BY timestamp) AS n FROM seg),
lists AS (SELECT *, list(pred_1hr) OVER (PARTITION BY h3_cell ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS whole, list(pred_1hr) OVER (PARTITION BY h3_cell, seg_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS part FROM numbered)
SELECT h3_cell, timestamp, round(list_reduce(part, lambda a, x: CAST(0.7 AS DOUBLE) * a + CAST(0.3 AS DOUBLE) * x), 6) AS ewma_1hr, round(list_reduce(whole, lambda a, x: CAST(0.98 AS DOUBLE) * a + CAST(0.02 AS DOUBLE) * x), 6) AS ewma_long_1hr FROM lists"""


@query(_EWMA)
def win15_ewma(spark, sf_dir):
    rows = opscore.gap_segments(_joined(spark, sf_dir)).select("h3_cell", "timestamp", "seg_id", "pred_1hr")
    out = opscore.ewma(rows, {"ewma_1hr": ("pred_1hr", 0.3, True), "ewma_long_1hr": ("pred_1hr", 0.02, False)})
    return rounded(out.select("h3_cell", "timestamp", "ewma_1hr", "ewma_long_1hr"))


@query(f"{_SEG} SELECT h3_cell, timestamp, round(max(pred_1hr) {_LAST(6)}, 6) AS rmax, round(CASE WHEN count(pred_1hr) {_LAST(24)} >= 5 THEN avg(pred_1hr) {_LAST(24)} END, 6) AS rmean_1hr, round(CASE WHEN count(pred_1hr) {_LAST(24)} >= 5 THEN stddev_samp(pred_1hr) {_LAST(24)} END, 6) AS rstd_1hr FROM seg")
def win16_17_rolling_stats(spark, sf_dir):
    d = opscore.dynamics(_joined(spark, sf_dir), "v1", averages=False)
    return rounded(d.select("h3_cell", "timestamp", F.col("rmax_1hr").alias("rmax"), "rmean_1hr", "rstd_1hr"))


_Z_LONG = f"""long AS (SELECT *, CASE WHEN count(pred_1hr) {_LONG} >= 50 THEN avg(pred_1hr) {_LONG} END AS rmean_long_1hr, CASE WHEN count(pred_1hr) {_LONG} >= 50 THEN stddev_samp(pred_1hr) {_LONG} END AS rstd_long_1hr FROM seg),
z_long AS (SELECT *, CASE WHEN rstd_long_1hr IS NOT NULL THEN least(greatest((pred_1hr - rmean_long_1hr) / greatest(rstd_long_1hr, CAST(0.001 AS DOUBLE)), CAST(-5 AS DOUBLE)), CAST(5 AS DOUBLE)) END AS z_long_raw_1hr FROM long)"""
_TANH = lambda x: f"((exp(2 * ({x})) - 1) / (exp(2 * ({x})) + 1))"
_SHORT = f"""short AS (SELECT *, pred_1hr - lag(pred_1hr) {_OVER} AS delta, max(pred_1hr) {_LAST(6)} AS rmax, CASE WHEN count(pred_1hr) {_LAST(24)} >= 5 THEN avg(pred_1hr) {_LAST(24)} END AS rmean_1hr, CASE WHEN count(pred_1hr) {_LAST(24)} >= 5 THEN stddev_samp(pred_1hr) {_LAST(24)} END AS rstd_1hr FROM z_long),
z_short AS (SELECT *, CASE WHEN rstd_1hr IS NOT NULL THEN least(greatest((pred_1hr - rmean_1hr) / greatest(rstd_1hr, CAST(0.001 AS DOUBLE)), CAST(-5 AS DOUBLE)), CAST(5 AS DOUBLE)) END AS z_short_raw_1hr FROM short),
dyn AS (SELECT *, {_TANH('z_long_raw_1hr')} AS z_long_1hr, CASE WHEN seg_pos >= 6 THEN {_TANH('z_short_raw_1hr')} ELSE 0 END AS z_short_1hr, CASE WHEN seg_pos >= 6 THEN {_TANH('coalesce(delta, 0)')} ELSE 0 END AS d1_1hr, CASE WHEN seg_pos >= 6 THEN rmax ELSE 0 END AS rmax_1hr FROM z_short)"""
_BASE = "CAST(0.55 AS DOUBLE) * pred_1hr + CAST(0.25 AS DOUBLE) * pred_6hr + CAST(0.2 AS DOUBLE) * pred_12hr"
_SCORED = f"""{_SEG},
{_Z_LONG},
{_SHORT},
scored AS (SELECT *, {_BASE} + CAST(0.05 AS DOUBLE) * (coalesce(z_long_1hr, 0) + coalesce(z_short_1hr, 0) + coalesce(d1_1hr, 0) + coalesce(rmax_1hr, 0)) AS ops_score FROM dyn)"""


@query(f"{_SEG},\n{_Z_LONG} SELECT h3_cell, timestamp, round(rmean_long_1hr, 6) AS rmean_long_1hr, round(rstd_long_1hr, 6) AS rstd_long_1hr, round({_TANH('z_long_raw_1hr')}, 5) AS z_long_1hr FROM z_long")
def win18_19_long_baseline(spark, sf_dir):
    d = opscore.long_baseline(_joined(spark, sf_dir), averages=False)
    return rounded(d.select("h3_cell", "timestamp", "rmean_long_1hr", "rstd_long_1hr", F.round("z_long_1hr", 5).alias("z_long_1hr")))


@query(f"{_SCORED} SELECT h3_cell, timestamp, seg_pos, round(z_short_1hr, 5) AS z_short_1hr, round(d1_1hr, 5) AS d1_1hr, round(rmax_1hr, 5) AS rmax_1hr FROM scored")
def api09_dynamics_v2(spark, sf_dir):
    """Bounded z-scores and deltas, gated by the place in the segment."""
    d = opscore.dynamics(_joined(spark, sf_dir), averages=False)
    return rounded(d.select("h3_cell", "timestamp", "seg_pos", "z_short_1hr", "d1_1hr", "rmax_1hr"), 5)


@query(f"{_SCORED} SELECT h3_cell, timestamp, round(ops_score, 5) AS ops_score, round(ops_score, 5) AS ops_score_raw FROM scored")
def api11_ops_score_v2(spark, sf_dir):
    """The whole scoring of three horizons, with its moving averages."""
    s = opscore.run({h: as_predictions(d) for h, d in horizons(spark, sf_dir).items()})
    return rounded(s.select("h3_cell", "timestamp", "ops_score", "ops_score_raw"), 5)


_V1 = f"""{_SEG},
short AS (SELECT *, CASE WHEN new_seg = 1 THEN NULL ELSE pred_1hr - lag(pred_1hr) {_OVER} END AS d1_1hr, max(pred_1hr) {_LAST(6)} AS rmax_1hr, CASE WHEN count(pred_1hr) {_LAST(24)} >= 5 THEN avg(pred_1hr) {_LAST(24)} END AS rmean_1hr, CASE WHEN count(pred_1hr) {_LAST(24)} >= 5 THEN stddev_samp(pred_1hr) {_LAST(24)} END AS rstd_1hr FROM seg),
dyn AS (SELECT *, CASE WHEN rstd_1hr > CAST(1e-12 AS DOUBLE) THEN (pred_1hr - rmean_1hr) / rstd_1hr ELSE 0 END AS z_1hr FROM short)"""


@query(f"{_V1} SELECT h3_cell, timestamp, round(z_1hr, 5) AS z_1hr, round(d1_1hr, 5) AS d1_1hr, round(rmax_1hr, 5) AS rmax_1hr FROM dyn")
def api10_dynamics_v1(spark, sf_dir):
    d = opscore.dynamics(_joined(spark, sf_dir), "v1", averages=False)
    return rounded(d.select("h3_cell", "timestamp", "z_1hr", "d1_1hr", "rmax_1hr"), 5)


@query(f"{_V1} SELECT h3_cell, timestamp, round({_BASE} + CAST(0.15 AS DOUBLE) * z_1hr + CAST(0.1 AS DOUBLE) * coalesce(d1_1hr, 0) + CAST(0.1 AS DOUBLE) * rmax_1hr, 5) AS ops_score FROM dyn")
def api12_ops_score_v1(spark, sf_dir):
    s = opscore.run({h: as_predictions(d) for h, d in horizons(spark, sf_dir).items()}, "v1", averages=False)
    return rounded(s.select("h3_cell", "timestamp", "ops_score"), 5)


_FRACS = (0.05, 0.25, 0.5)
_TOPK = f"""{_SEG}, ranked AS (SELECT timestamp, label_1hr AS y, count(*) OVER (PARTITION BY timestamp) AS n_cells, sum(label_1hr) OVER (PARTITION BY timestamp) AS n_pos, row_number() OVER (PARTITION BY timestamp ORDER BY pred_1hr DESC, h3_cell) AS rank FROM joined),
each AS (SELECT *, rank <= ceil(n_cells * frac) AS inside FROM ranked, (VALUES {", ".join(f"(CAST({f} AS DOUBLE))" for f in _FRACS)}) v(frac)),
m AS (SELECT frac, timestamp, first(n_cells) AS n_cells, first(n_pos) AS n_pos, sum(CASE WHEN inside THEN y ELSE 0 END) AS tp_at_k, CAST(sum(CAST(inside AS BIGINT)) AS BIGINT) AS k_count FROM each GROUP BY 1, 2)"""


@query(f"{_TOPK} SELECT *, round(tp_at_k / n_pos, 6) AS recall_at_k, round(tp_at_k / k_count, 6) AS precision_at_k FROM m WHERE n_pos > 0")
def ml11_topk_metrics(spark, sf_dir):
    """Recall and precision of each hour's top fraction; hours without events are left out."""
    return rounded(metrics.topk_metrics(_joined(spark, sf_dir), "pred_1hr", "label_1hr", _FRACS))


@query(f"{_TOPK} SELECT *, CASE WHEN n_pos > 0 THEN round(tp_at_k / n_pos, 6) END AS recall_at_k, round(tp_at_k / k_count, 6) AS precision_at_k FROM m")
def win23_24_topk_all_hours(spark, sf_dir):
    return rounded(metrics.topk_metrics(_joined(spark, sf_dir), "pred_1hr", "label_1hr", _FRACS, only_event_hours=False))


@query(f"{_SEG} SELECT timestamp, count(*) AS n_cells, sum(label_1hr) AS n_pos FROM joined GROUP BY 1 HAVING sum(label_1hr) > 0")
def agg09_hour_counts(spark, sf_dir):
    """Rows and events by hour, hours with events alone."""
    return _joined(spark, sf_dir).groupBy("timestamp").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("label_1hr").alias("n_pos")).where("n_pos > 0")


@query(f"{_SEG} SELECT name, round(min(x), 6) AS min, round(quantile_cont(x, 0.01), 6) AS p01, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.99), 6) AS p99, round(max(x), 6) AS max FROM (SELECT 'pred_1hr' AS name, pred_1hr AS x FROM joined UNION ALL SELECT 'pred_6hr', pred_6hr FROM joined UNION ALL SELECT 'pred_12hr', pred_12hr FROM joined) GROUP BY 1")
def agg11_quantiles(spark, sf_dir):
    return rounded(metrics.quantiles(_joined(spark, sf_dir), ("pred_1hr", "pred_6hr", "pred_12hr")))


def _judged(spark, sf_dir):
    """Labelled documents with a rule's score; scores tie."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    return d.join(l, "doc_id").select("quality", (F.col("n_chars") % 97 / 97.0).alias("s"))


_JUDGED = "WITH judged AS (SELECT l.quality, (n_chars % 97) / CAST(97 AS DOUBLE) AS s FROM documents d JOIN labels l USING (doc_id))"


@query(f"""{_JUDGED}, g AS (SELECT s, count(*) AS n, sum(quality) AS pos FROM judged GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS n_all, sum(pos) OVER (ORDER BY s DESC) AS tp FROM g),
t AS (SELECT sum(n) AS n, sum(pos) AS p, sum(CAST(pos AS DOUBLE) * tp / n_all) AS ap, sum(CAST(n - pos AS DOUBLE) * (tp - pos + pos / 2.0)) AS wins FROM c)
SELECT CAST(n AS BIGINT) AS n, round(p / n, 6) AS event_rate, round(ap / p, 6) AS average_precision, round(wins / (p * (n - p)), 6) AS roc_auc, round(ap / p / (p / n), 6) AS lift FROM t""")
def ml05_07_ranking(spark, sf_dir):
    """Average precision, ROC-AUC, event rate and lift."""
    return rounded(metrics.ranking(_judged(spark, sf_dir), "s", "quality"))


@query("SELECT avg(quality) AS event_rate FROM labels")
def agg15_event_rate(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.avg("quality").alias("event_rate"))


@query("SELECT l_suppkey, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def srt05_top_25(spark, sf_dir):
    """The greatest sums, as a top-25 report."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty")).orderBy(F.desc("qty"), "l_suppkey").limit(25)


_RUNS = ml.experiments()


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r['name']}', {r['max_depth']}, CAST({r['eta']} AS DOUBLE), CAST({r['subsample']} AS DOUBLE), CAST({r['colsample_bytree']} AS DOUBLE), {r['max_bin']}, {r['min_child_weight']}, {r['scale_pos_weight']})" for r in _RUNS) + ") v(name, max_depth, eta, subsample, colsample_bytree, max_bin, min_child_weight, scale_pos_weight)")
def ml09_experiments(spark, sf_dir):
    rows = [(r["name"], r["max_depth"], float(r["eta"]), float(r["subsample"]), float(r["colsample_bytree"]), r["max_bin"], r["min_child_weight"], r["scale_pos_weight"]) for r in ml.experiments()]
    return spark.createDataFrame(rows, "name string, max_depth int, eta double, subsample double, colsample_bytree double, max_bin int, min_child_weight int, scale_pos_weight int")


@query(f"{_SEG} SELECT h3_cell, timestamp, rank FROM (SELECT h3_cell, timestamp, CAST(row_number() OVER (PARTITION BY timestamp ORDER BY pred_1hr DESC, h3_cell) AS INTEGER) AS rank FROM joined)")
def win23_ordinal_rank(spark, sf_dir):
    w = Window.partitionBy("timestamp").orderBy(F.desc("pred_1hr"), "h3_cell")
    return _joined(spark, sf_dir).select("h3_cell", "timestamp", F.row_number().over(w).alias("rank"))
