"""Training frames, boosted trees, evaluation and the one-at-a-time sweep."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.metrics import ranking
from lodeweave.sources.storage import write_text

#: Half-open time splits. Fixed values.
SPLITS = {"train": ("2024-01-01", "2024-05-01"), "val": ("2024-05-01", "2024-06-01"), "test": ("2024-06-01", "2024-07-01")}
LABEL = "label_exclusive_6h"
#: The base setting and the swept ones.
BASE = {"max_depth": 8, "eta": 0.05, "subsample": 0.8, "colsample_bytree": 0.5, "max_bin": 256, "min_child_weight": 1, "scale_pos_weight": 1}
SWEEP = {
    "scale_pos_weight": ("spw", (1, 2, 5, 10, 20, 50, 100)),
    "max_depth": ("depth", (3, 4, 6, 8, 10, 12)),
    "eta": ("eta", (0.3, 0.1, 0.05, 0.02, 0.01)),
    "subsample": ("subsample", (0.5, 0.7, 0.9, 1.0)),
    "colsample_bytree": ("colsample", (0.5, 0.7, 0.9, 1.0)),
    "max_bin": ("maxbin", (64, 128, 256)),
    "min_child_weight": ("mcw", (1, 5, 10, 20)),
}


def time_slice(df: DataFrame, start: str, end: str, time: str = "timestamp") -> DataFrame:
    return df.where((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz")))


def split_column(splits: dict[str, tuple[str, str]] = SPLITS, time: str = "timestamp") -> Column:
    """The name of the split a row is in, or null."""
    found = F.lit(None).cast("string")
    for name, (start, end) in splits.items():
        found = F.when((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz")), name).otherwise(found)
    return found


def feature_names(columns: Sequence[str]) -> list[str]:
    return sorted(c for c in columns if "__sum_" in c or "__count_" in c)


def training_columns(df: DataFrame, label: str = LABEL, time: str = "timestamp") -> DataFrame:
    return df.select(time, label, *feature_names(df.columns))


def dataset(df: DataFrame, label: str = LABEL, splits: dict[str, tuple[str, str]] = SPLITS, cells: Sequence[str] | None = None, time: str = "timestamp") -> DataFrame:
    """split, label and the assembled features of the rows inside the splits; an error if there are none."""
    from pyspark.ml.feature import VectorAssembler

    rows = df.where(F.col("h3_res3").isin(list(cells))) if cells is not None else df
    rows = training_columns(rows, label, time).withColumn("split", split_column(splits, time)).where("split IS NOT NULL").na.fill(0)
    if rows.isEmpty():
        raise RuntimeError("no rows in any split")
    names = feature_names(df.columns)
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("split", F.col(label).cast("double").alias("label"), "features")


def classifier(params: dict, rounds: int = 2000, seed: int = 7):
    """A boosted-tree classifier for the sweep's parameter names; a validation column stops it early."""
    from pyspark.ml.classification import GBTClassifier

    p = BASE | params
    return GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", validationIndicatorCol="held", maxIter=rounds, maxDepth=p["max_depth"], stepSize=p["eta"], subsamplingRate=p["subsample"],
        featureSubsetStrategy=str(p["colsample_bytree"]), maxBins=p["max_bin"], minInstancesPerNode=p["min_child_weight"], seed=seed,
    )


def train(data: DataFrame, params: dict | None = None, rounds: int = 2000, path: str | None = None):
    """A model of the train split, stopped by the val split; saved under path if given."""
    p = BASE | (params or {})
    rows = data.where("split IN ('train', 'val')").select("features", "label", (F.col("split") == "val").alias("held"), F.when(F.col("label") > 0, float(p["scale_pos_weight"])).otherwise(1.0).alias("weight"))
    model = classifier(p, rounds).fit(rows)
    if path:
        model.write().overwrite().save(path)
    return model


def predict(model, data: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(data).withColumn("prediction", vector_to_array("probability")[1]).drop("probability", "rawPrediction")


def importances(model, names: Sequence[str], top: int = 25) -> list[tuple[str, float]]:
    """The features of the greatest normalised importance, as (name, importance)."""
    return sorted(zip(names, (float(x) for x in model.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))[:top]


def evaluate(model, data: DataFrame, names: Sequence[str], run_dir: str | None = None, params: dict | None = None, split: str = "test") -> dict:
    """Metrics of a split; with run_dir, a folder in any store, also metrics.json, params.json, feature_importance_gain.json and predictions as Parquet."""
    scored = predict(model, data.where(F.col("split") == split))
    found = ranking(scored, "prediction", "label").first().asDict()
    ranked = importances(model, names)
    if run_dir:
        for name, value in (("metrics", found), ("params", params or {}), ("feature_importance_gain", dict(ranked))):
            write_text(data.sparkSession, f"{run_dir}/{name}.json", json.dumps(value, indent=2))
        scored.select("label", "prediction").write.mode("overwrite").parquet(f"{run_dir}/predictions.parquet")
    return found | {"importances": ranked}


def experiments() -> list[dict]:
    """The base setting and each swept value with all others at the base: 34 named runs, some of equal parameters."""
    runs = [{"name": "baseline", **BASE}]
    return runs + [{"name": f"{short}_{v}", **BASE, key: v} for key, (short, values) in SWEEP.items() for v in values]


def distinct_runs(runs: Sequence[dict]) -> dict[tuple, list[str]]:
    """Parameters of the runs to execute, each with the names it stands for."""
    found: dict[tuple, list[str]] = {}
    for r in runs:
        found.setdefault(tuple(sorted((k, v) for k, v in r.items() if k != "name")), []).append(r["name"])
    return found
