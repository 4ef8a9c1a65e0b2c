import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeweave.llm import quality, queries
from tests.conftest import DATA


def test_held_out_accuracy(spark):
    got = queries.op8_quality_scores(spark, f"{DATA}/sf0.1")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    assert sum(r.quality == r.predicted for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    one, zero = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in one for b in zero]) > 0.97


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=20))
def test_isotonic_steps(pairs):
    counts = np.array([a + b for a, b in pairs], float)
    ones = np.array([a for a, _ in pairs], float)
    steps = quality.isotonic(ones, counts)
    assert (np.diff(steps) >= -1e-12).all() and (steps >= 0).all() and (steps <= 1).all()
    if counts.sum():
        assert abs((steps * counts).sum() - ones.sum()) < 1e-9
        shifted = np.clip(steps + 0.01, 0, 1)
        loss = lambda s: (counts * (s - ones / np.maximum(counts, 1)) ** 2).sum()
        assert loss(steps) <= loss(shifted) + 1e-9


def test_odd_rows(spark, odd_docs, no_docs):
    stats = quality.described(odd_docs.select("doc_id", "text"))
    labels = spark.createDataFrame([(0, 1), (3, 1), (3, 0), (4, None), (None, 1), (6, 0)], "doc_id long, quality int")
    for taught in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = quality.scored(stats, quality.learn(stats, taught, F.lit(True))).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == 1 for r in quality.scored(stats, quality.learn(stats, labels.limit(0), F.lit(True))).collect())
    none = quality.described(no_docs.select("doc_id", "text"))
    assert quality.scored(none, quality.learn(none, labels, F.lit(True))).count() == 0


def test_partition_sums_give_the_normal_equations(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(50, len(quality.STATISTICS)))
    y = rng.normal(size=50)
    k = len(quality.STATISTICS)
    model = quality.Model(np.zeros(k), np.ones(k), np.zeros(0), np.zeros(quality.CELLS))
    frame = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(rows, y)], "stats array<double>, y double").repartition(5)
    xx, xy = quality._normal_equations(frame, model)
    x = model.features(rows)
    assert np.allclose(xx, x.T @ x) and np.allclose(xy, x.T @ y)
