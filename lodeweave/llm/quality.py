"""Quality scores from document statistics: random Fourier features, ridge regression, isotonic calibration.

1. Every text is reduced to STATISTICS, a few numbers; only these go on.
2. Random Fourier features cos(w x + b), with w from a seeded normal distribution, approximate a
   Gaussian kernel over the arsinh of the standardised statistics; the model has no other features.
3. Each partition sums its share of the normal equations X'X and X'y; the sums are added row by row of
   the matrix on the executors, and the driver solves the ridge system, whose size is fixed.
4. The raw scores of the calibration fold are counted in CELLS equal steps, and pooling adjacent
   violators over the steps makes a non-decreasing map from raw score to the share of label 1.

The classifier is learned on a bounded sample of labelled rows, at most about `sample`, chosen by a hash
of doc_id, split between fit and calibration. Scores depend on the text alone.

Defined cases: null text is empty text and gets a score; a document whose label rows disagree is taught
with their mean; null labels teach nothing; repeated documents are rows of their own, each scored, and of
those of one doc_id the one with the least statistics teaches; a very long text is read whole; with no
labelled row every score is 1 (nothing is rejected); with one class only, its share; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, text_bytes

STATISTICS = ("log_bytes", "log_words", "log_word_length", "upper", "digits", "stops", "marks", "symbols", "pipes", "spaces", "other", "distinct", "same_next", "top_word", "bare_words", "end_marks", "log_line", "same_lines")
FEATURES, WIDTH, RIDGE, CELLS, SEED = 160, 4.0, 1e-2, 400, 20240229
_ODD_END = re.compile(rb"[^\w\s.,;:?'\"\x80-\xff](?=\s|$)", re.ASCII)
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!'\"()-", b"#$%&*+/<=>@[\\]^_`{}~", b"|", b" \t\n\r\x0b\x0c", bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _k


def statistics(t: bytes) -> list[float]:
    """STATISTICS of one text."""
    words = t.split()
    n, k = max(1, len(t)), max(1, len(words))
    classes = np.bincount(_CLASS, np.bincount(np.frombuffer(t, np.uint8), minlength=256), 9) / n
    counts = Counter(words)
    lines = t.split(b"\n")
    bare = sum(c for w, c in counts.items() if not w.isalnum() and not any(97 <= b <= 122 or 65 <= b <= 90 or b > 127 for b in w))
    return [
        float(np.log1p(len(t))), float(np.log1p(len(words))), float(np.log1p(len(t) / k)), *classes[1:6], classes[6], classes[7], classes[8],
        len(counts) / k, sum(map(bytes.__eq__, words, words[1:])) / k, max(counts.values(), default=0) / k,
        bare / k, len(_ODD_END.findall(t)) / k, float(np.log1p(len(t) / len(lines))), 1 - len({*lines}) / len(lines),
    ]


def described(docs: DataFrame) -> DataFrame:
    """The columns of docs other than text, and stats: the STATISTICS of the text."""
    carried = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t.as_py()) for t in batch.column(len(carried)).cast(pa.binary())], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))], [*carried, "stats"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried]
    return docs.select(*carried, text_bytes(F.col("text")).alias("text")).mapInArrow(run, ", ".join([*kinds, "stats array<double>"]))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray

    def parts(self) -> tuple[np.ndarray, ...]:
        """Plain values for a broadcast: executors needn't know the class."""
        return self.mean, self.scale, self.weights, self.steps

    def features(self, stats: np.ndarray) -> np.ndarray:
        """1 and the random Fourier features; arsinh keeps far statistics apart without letting them run away."""
        x = np.arcsinh((stats - self.mean) / self.scale)
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, 1 / WIDTH, (x.shape[1], FEATURES))
        return np.hstack([np.ones((len(x), 1)), np.cos(x @ w + rng.uniform(0, 2 * np.pi, FEATURES)) * np.sqrt(2 / FEATURES)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights if len(self.weights) else np.zeros(len(stats))

    def cell(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw + 0.5) / 2 * CELLS, 0, CELLS - 1).astype(int)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """The calibrated share of label 1, with a little of the raw score, so that equal steps keep an order."""
        raw = self.raw(stats)
        return np.clip(self.steps[self.cell(raw)] + 1e-3 * (np.clip(raw, -0.5, 1.5) - 0.5), 0, 1)


def isotonic(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The non-decreasing steps closest to ones / counts (pool adjacent violators); empty steps lie between their neighbours."""
    pools: list[list[float]] = []
    at = np.flatnonzero(counts)
    for i in at:
        pools.append([ones[i], counts[i], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, k = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + k]
    fitted = np.repeat([s / n for s, n, _ in pools], [int(k) for *_, k in pools])
    return np.interp(np.arange(len(counts)), at, fitted) if len(at) else np.ones(len(counts))


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y over rows (stats, y): summed in each partition, then for each row of the matrix."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = model.features(np.array(batch.column(0).to_pylist(), float).reshape(-1, len(STATISTICS)))
            own = x.T @ np.hstack([x, batch.column(1).to_numpy()[:, None]])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist())], ["i", "line"])

    def add(t: pa.Table) -> pa.Table:
        line = np.array(t.column("line").to_pylist()).sum(axis=0)
        return pa.table({"i": t.column("i").slice(0, 1), "line": [line.tolist()]})

    lines = rows.select("stats", "y").mapInArrow(sums, "i int, line array<double>").groupBy("i").applyInArrow(add, "i int, line array<double>")
    full = np.array([r["line"] for r in sorted(lines.collect())])  # FEATURES + 1 rows
    return full[:, :-1], full[:, -1]


def learn(stats: DataFrame, labels: DataFrame, teaches: Column, sample: int = 30_000) -> Model:
    """A model of stats (doc_id, stats) and labels (doc_id, quality), from the rows for which `teaches` holds."""
    y = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & teaches).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    size = y.count()
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20))
    chosen = y.where(part < min(1.0, sample / max(1, size)) * (1 << 20))
    rows = cut(stats.groupBy("doc_id").agg(F.min("stats").alias("stats")).join(chosen, "doc_id").withColumn("fit", F.pmod(part, F.lit(4)) > 0).select("doc_id", "stats", "y", "fit"))
    fit, rest = rows.where("fit"), rows.where("NOT fit")
    moments = fit.select("y", *[F.col("stats")[i].alias(f"s{i}") for i in range(len(STATISTICS))])
    found = moments.agg(F.count("y"), *[f(f"s{i}") for f in (F.avg, F.stddev_pop) for i in range(len(STATISTICS))]).first()
    k = len(STATISTICS)
    if not found[0]:
        return Model(np.zeros(k), np.ones(k), np.zeros(0), np.ones(CELLS))
    model = Model(np.array(found[1 : k + 1], float), np.maximum(np.array(found[k + 1 :], float), 1e-6), np.zeros(0), np.zeros(CELLS))
    xx, xy = _normal_equations(fit, model)
    model.weights = np.linalg.solve(xx + RIDGE * max(1.0, found[0] / 1000) * np.eye(len(xx)), xy)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(np.array(batch.column(0).to_pylist(), float).reshape(-1, k))
            yield pa.RecordBatch.from_arrays([pa.array(model.cell(raw)), batch.column(1)], ["cell", "y"])

    ones, counts = np.zeros(CELLS), np.zeros(CELLS)
    calibration = rest if not rest.isEmpty() else fit
    for r in calibration.select("stats", "y").mapInArrow(cells, "cell long, y double").groupBy("cell").agg(F.sum("y").alias("s"), F.count("y").alias("n")).collect():
        ones[r["cell"]], counts[r["cell"]] = r["s"], r["n"]
    model.steps = isotonic(ones, counts)
    return model


def scored(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The columns of stats with score and predicted in place of stats."""
    carried = [c for c in stats.columns if c != "stats"]
    held = stats.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            score = own.score(np.array(batch.column(len(carried)).to_pylist(), float).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*carried, "score", "predicted"])

    kinds = [f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in carried]
    return stats.select(*carried, "stats").mapInArrow(run, ", ".join([*kinds, "score double", "predicted int"]))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores at least `threshold`: one pass over the texts, no exchange."""
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            rows = np.array([statistics(t.as_py() or b"") for t in batch.column(at).cast(pa.binary())], float).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(own.score(rows) >= threshold))

    return docs.mapInArrow(run, docs.schema)
