"""Ranking metrics as aggregations and windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.scalars import ratio


def topk_metrics(df: DataFrame, score_col: str, label_col: str, fracs: Sequence[float], only_event_hours: bool = True, time: str = "timestamp", tie: str = "h3_cell") -> DataFrame:
    """frac, timestamp, n_cells, n_pos, tp_at_k, k_count, recall_at_k, precision_at_k; k is n_cells * frac rounded up.

    Rows are ranked once for all fractions; ties in score go by `tie`.
    """
    if not fracs or not all(0 < f <= 1 for f in fracs):
        raise ValueError("fractions must be over 0 and at most 1")
    hour = Window.partitionBy(time)
    ranked = df.select(
        time, F.col(label_col).alias("y"),
        F.count(F.lit(1)).over(hour).alias("n_cells"), F.sum(label_col).over(hour).alias("n_pos"),
        F.row_number().over(hour.orderBy(F.desc_nulls_last(score_col), tie)).alias("rank"),
    )
    if only_event_hours:
        ranked = ranked.where("n_pos > 0")
    each = ranked.withColumn("frac", F.explode(F.array(*[F.lit(float(f)) for f in fracs])))
    inside = F.col("rank") <= F.ceil(F.col("n_cells") * F.col("frac"))
    out = each.groupBy("frac", time).agg(F.first("n_cells").alias("n_cells"), F.first("n_pos").alias("n_pos"), F.sum(F.when(inside, F.col("y")).otherwise(0)).alias("tp_at_k"), F.sum(inside.cast("long")).alias("k_count"))
    return out.withColumns({"recall_at_k": ratio(F.col("tp_at_k"), F.col("n_pos")), "precision_at_k": ratio(F.col("tp_at_k"), F.col("k_count"))})


def _range_of(x: str, bounds: Sequence[float]) -> Column:
    """How many of the sorted bounds are at most x, by halving steps."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    held = f"array({','.join(f'{b!r}D' for b in bounds)})"
    return F.expr(f"aggregate(sequence({steps - 1}, 0, -1), 0, (n, k) -> if(n + shiftleft(1, k) <= {len(bounds)}, if(element_at({held}, least(n + shiftleft(1, k), {len(bounds)})) <= {x}, n + shiftleft(1, k), n), n))")


def _bounds(values: DataFrame, x: str, bins: int) -> list[float]:
    """At most bins - 1 values that cut the distinct values into ranges of about equal numbers."""
    found = values.agg(F.percentile_approx(x, [k / bins for k in range(1, bins)], 20 * bins)).first()[0]
    return sorted({float(b) for b in found or ()})


def _by_score(df: DataFrame, score_col: str, label_col: str, bins: int) -> DataFrame:
    """s, n, pos, and cumulated counts from the highest score down: all, tp. Ties are one step.

    Cumulating is in two levels, so that no task sorts all scores: sums of `bins` ranges of about as many
    distinct scores first, wherever these crowd, then within each range.
    """
    steps = df.where(F.col(score_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(score_col).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label_col).cast("long")).alias("pos"))
    steps = steps.withColumn("bin", _range_of("s", _bounds(steps, "s", bins)))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bases = steps.groupBy("bin").agg(F.sum("n").alias("bn"), F.sum("pos").alias("bp"))
    bases = bases.select("bin", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("p0"))
    w = Window.partitionBy("bin").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    within = steps.withColumns({"n1": F.sum("n").over(w), "p1": F.sum("pos").over(w)})
    return within.join(F.broadcast(bases), "bin").select("s", "n", "pos", (F.col("n0") + F.col("n1")).alias("all"), (F.col("p0") + F.col("p1")).alias("tp"))  # `bins` rows


def ranking(df: DataFrame, score_col: str, label_col: str, bins: int = 256) -> DataFrame:
    """One row: n, event_rate, average_precision (step-wise), roc_auc (ties count half), lift (average precision / event rate)."""
    steps = _by_score(df, score_col, label_col, bins)
    sums = steps.agg(
        F.sum("n").alias("n"), F.sum("pos").alias("p"),
        F.sum(F.col("pos") * F.col("tp") / F.col("all")).alias("ap"),
        F.sum((F.col("n") - F.col("pos")).cast("double") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0)).alias("wins"),
    )
    out = sums.select("n", ratio(F.col("p"), F.col("n")).alias("event_rate"), ratio(F.col("ap"), F.col("p")).alias("average_precision"), ratio(F.col("wins"), F.col("p") * (F.col("n") - F.col("p"))).alias("roc_auc"))
    return out.withColumn("lift", ratio(F.col("average_precision"), F.col("event_rate")))


def quantiles(df: DataFrame, columns: Sequence[str], bins: int = 256) -> DataFrame:
    """name, min, p01, p50, p99, max of each column (exact, linear between ranks).

    Ranks are in two levels, as in `ranking`: sums of ranges of distinct values, then within each.
    """
    shares = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    out = []
    for c in columns:
        values = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
        values = values.withColumn("bin", _range_of("x", _bounds(values, "x", bins)))
        below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bases = values.groupBy("bin").agg(F.sum("n").alias("bn")).select("bin", F.coalesce(F.sum("bn").over(below), F.lit(0)).alias("n0"), F.sum("bn").over(Window.partitionBy()).alias("all"))
        upto = F.sum("n").over(Window.partitionBy("bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
        ranks = values.withColumn("n1", upto).join(F.broadcast(bases), "bin").select("x", "all", (F.col("n0") + F.col("n1") - F.col("n")).alias("lo"), (F.col("n0") + F.col("n1")).alias("hi"))  # `bins` rows
        at = {k: F.lit(q) * (F.col("all") - 1) for k, q in shares.items()}

        def place(rank: Column) -> Column:
            return F.max(F.when((F.col("lo") <= rank) & (rank < F.col("hi")), F.col("x")))

        found = ranks.agg(F.min("x").alias("min"), F.max("x").alias("max"), F.max("all").alias("all"), *[f for k, p in at.items() for f in (place(F.floor(p)).alias(f"{k}_lo"), place(F.ceil(p)).alias(f"{k}_hi"))])
        share = {k: at[k] - F.floor(at[k]) for k in shares}
        out.append(found.select(F.lit(c).alias("name"), "min", *[(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * share[k]).alias(k) for k in shares], "max"))
    return reduce(DataFrame.unionByName, out)
