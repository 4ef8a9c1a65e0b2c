"""Removal of repeated byte strings by prefix doubling over sorted positions of texts.

Every byte covered by a string of `length` bytes that also starts elsewhere is removed. The starts of such
strings are found as in building a suffix array by prefix doubling: a position has a rank, the name of the
prefix that starts there; a round sorts pairs of ranks (that of the prefix so far, that at a growing
offset), positions whose pair is unique leave, and the others get the pair's name as their rank, until
prefixes reach `length`. Two things make the rounds small:

- Ranks are names by hash, 64 bits for each half of a pair, so that no rank must be fetched from elsewhere.
- Only anchors are sorted, not all positions. Every start p has an anchor, the place with the least hash of
  8 bytes among the first ones of its string. Equal strings have equal anchors, so one row stands for the
  run of neighbouring starts with one anchor.

The first round pairs the ranks of the two halves of the first FIRST bytes from each anchor. What all
strings of a run share begins at its anchor or before and grows as the run is cut into shorter ones, at the
same distances from the anchor: from FIRST bytes over length - 143 and length - 15 to `length`, where a run
is one start and its rank decides. Each round pairs the rank so far with that of what a shorter run shares.

A run whose shared bytes are unique leaves: none of its strings is repeated. A run all of whose bytes (the
rank `whole`) are repeated has only repeated strings. What is left goes on, with one run standing for each
class of equal ones.

No group is gathered: pairs are counted with partial sums, written, and joined back, which lets adaptive
execution split a frequent pair. Texts are keyed by their digest and stored once, with their number of
copies, in buckets by that key: later rounds read them without an exchange. All bytes of copies are removed.

Defined cases: null text is empty; texts of under `length` bytes stay whole; a repeated row, or a copy, is
an occurrence elsewhere; strings are judged on the input; a very long text is one row, its anchors found in
linear time; a null doc_id is a row like any other; an empty table gives no rows; further columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lodeweave.llm.common import bucketed, cut, release, text_bytes, text_key

GRAM = 8
FIRST = 64
#: Numbers of starts in a run, in the rounds after the first.
SIZES = (144, 16, 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, from running minima of blocks in both directions."""
    n = len(v)
    blocks = np.concatenate([v, np.full(-n % width, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], forth[width - 1 : n])


def first_bytes(length: int) -> int:
    """What all strings of an anchor's run share at the least."""
    return min(FIRST, length // 2 + GRAM)


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of each run of starts with one anchor; the text has `length` bytes at least."""
    spread = length - first_bytes(length) + 1
    starts = len(text) - length + 1
    grams = np.ndarray(starts + spread - 1, "<u8", text, strides=(1,)) * _ODD
    grams ^= grams >> np.uint64(29)
    grams *= _ODD
    grams &= np.uint64(0xFFFFFFFF00000000)
    grams |= np.arange(len(grams), dtype=np.uint64)  # the first of equal hashes is the least
    at = sliding_least(grams, spread) & np.uint64(0xFFFFFFFF)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return at[first].astype(np.int64), first, np.concatenate([first[1:] - 1, [starts - 1]])


def _placed(lo: np.ndarray, n: np.ndarray, back: np.ndarray) -> np.ndarray:
    """A run in one long: first start, number of starts, and how far the anchor lies behind the first start."""
    return (lo.astype(np.int64) << 32) | (n.astype(np.int64) << 16) | back.astype(np.int64)


_ROW = "key binary, run long, n long, above long, rank long, whole long"


def _rows(batch: pa.RecordBatch, of: list[int], runs: list[int], n: list[int], names: list[tuple[int, int, int]]) -> pa.RecordBatch:
    above, rank, whole = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*names, strict=True))
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(runs, pa.int64()), pa.array(n, pa.int64()), above, rank, whole], ["key", "run", "n", "above", "rank", "whole"])


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """A row for each anchor's run: the ranks of the two halves of its first bytes, and of all its strings' bytes."""
    shared = first_bytes(length)
    half = shared // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, runs, n, names = [], [], [], []
            for i, (value, copies) in enumerate(zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True)):
                t = value.as_py()
                if len(t) < length:
                    continue
                at, lo, hi = anchors(t, length)
                of += [i] * len(at)
                n += [copies] * len(at)
                runs += _placed(lo, hi - lo + 1, at - lo).tolist()
                for a, p, q in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    names.append((xxh3_64_intdigest(t[a : a + half]), xxh3_64_intdigest(t[a + half : a + shared]), xxh3_64_intdigest(t[p : q + length], a - p)))
                if len(of) > 50_000:
                    yield _rows(batch, of, runs, n, names)
                    of, runs, n, names = [], [], [], []
            if of:
                yield _rows(batch, of, runs, n, names)

    return texts.select("key", "text", "n").mapInArrow(run, _ROW)


def shorter_runs(text: bytes, run: int, length: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(run, rank, whole) for the parts of a run at each `size` distances from its anchor."""
    lo, n, back = run >> 32, run >> 16 & 0xFFFF, run & 0xFFFF
    a = lo + back
    for part in range((back - n + 1) // size, back // size + 1):
        near, far = part * size, part * size + size - 1  # distances of the part from the anchor
        first, last = max(lo, a - far), min(lo + n - 1, a - near)
        rank = xxh3_64_intdigest(text[a - near : a - far + length])
        yield (first << 32) | (last - first + 1 << 16) | (a - first), rank, xxh3_64_intdigest(text[first : last + length], a - first) if size > 1 else rank


def _shorter_rows(texts: DataFrame, asks: DataFrame, length: int, size: int) -> DataFrame:
    """The parts of the runs in asks (key, asks: run, n, above), of `size` starts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, runs, n, names = [], [], [], []
            for i, (text, asked) in enumerate(zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True)):
                t = text.as_py()
                for ask in asked.as_py():
                    above = ask["above"] & 0xFFFFFFFFFFFFFFFF
                    for r, rank, whole in shorter_runs(t, ask["run"], length, size):
                        of.append(i)
                        runs.append(r)
                        n.append(ask["n"])
                        names.append((above, rank, whole))
                    if len(of) > 50_000:
                        yield _rows(batch, of, runs, n, names)
                        of, runs, n, names = [], [], [], []
            if of:
                yield _rows(batch, of, runs, n, names)

    return texts.join(asks, "key").select("key", "text", "asks").mapInArrow(run, _ROW)


def cut_spans(text: bytes, starts: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal removed runs, for runs of starts (first, count), and the bytes that are left."""
    runs: list[list[int]] = []
    for lo, n in sorted(starts):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], lo + n - 1 + length)
        else:
            runs.append([lo, lo + n - 1 + length])
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(text[at:lo])
        at = hi
    kept.append(text[at:])
    return [(lo, hi) for lo, hi in runs], b"".join(kept)


_PAIR = ["above", "rank"]


def _not_unique(rows: DataFrame) -> DataFrame:
    """The rows whose pair of ranks occurs again, and whether all rows of that pair are equal as wholes."""
    counted = cut(rows.groupBy(*_PAIR).agg(F.sum("n").alias("_n"), F.min("whole").alias("_a"), F.max("whole").alias("_b")).where("_n > 1"))
    left = cut(rows.join(counted, _PAIR).select(*rows.columns, (F.col("_a") == F.col("_b")).alias("same")))
    release(counted)
    return left


def _settled(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, run of those that are repeated as wholes; key, asks of one run for each class of the others.

    n: 1 for a run that stands for itself alone; others stand for copies, or for runs already found repeated.
    """
    classes = cut(left.where("NOT same").groupBy(*_PAIR, "whole").agg(F.sum("n").alias("total"), F.min(F.struct("key", "run")).alias("one")))
    many = classes.where("total > 1").select(*_PAIR, "whole", F.lit(True).alias("many"))
    found = left.where("n = 1").join(many, [*_PAIR, "whole"], "left").where("same OR many").select("key", "run")
    ask = F.struct(F.col("one.run").alias("run"), F.least("total", F.lit(2)).alias("n"), F.xxhash64(*_PAIR).alias("above"))
    return cut(found), classes.select("one.key", ask.alias("ask")).groupBy("key").agg(F.collect_list("ask").alias("asks"))  # of one text's own runs


def repeated_starts(texts: DataFrame, length: int) -> DataFrame:
    """key, run: the runs of starts of repeated strings of texts without copies. texts: key, text, n (number of copies)."""
    left, out = None, []
    for size in (0, *(k for k in SIZES if k < length - first_bytes(length) + 1 or k == 1)):
        if size:
            settled, asks = _settled(left)
            release(left)
            out.append(settled)
        rows = cut(_shorter_rows(texts, asks, length, size) if size else _anchor_rows(texts, length))
        left = _not_unique(rows)
        release(rows)
    return reduce(DataFrame.unionByName, [*out, left.where("n = 1").select("key", "run")])


def remove_repeats(docs: DataFrame, length: int = 400, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_bytes also spans and kept (the bytes that are left)."""
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), text_bytes(F.col("text")).alias("text")).where("key IS NOT NULL")
    texts = bucketed(keyed.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")), "key")
    spans = repeated_starts(texts, length).groupBy("key").agg(F.collect_list("run").alias("runs"))
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["spans", "kept"] * keep_bytes]
    span = pa.struct([("from", pa.int32()), ("to", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found, n in zip(batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3).to_pylist(), strict=True):
                t = text.as_py()
                starts = [(0, len(t) - length + 1)] if n > 1 and len(t) >= length else [(r >> 32, r >> 16 & 0xFFFF) for r in found.as_py() or ()]
                runs, kept = cut_spans(t, starts, length)
                out.append((len(t), len(t) - len(kept), len(runs), sha256(kept).hexdigest(), *[[{"from": a, "to": b} for a, b in runs], kept] * keep_bytes))
            columns = list(zip(*out, strict=True)) or [[]] * (len(names) - 1)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(span), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names)

    schema = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<from:int,to:int>>, kept binary" * keep_bytes
    done = cut(texts.join(spans, "key", "left").select("key", "text", "runs", "n").mapInArrow(run, schema))
    release(texts)
    return keyed.select("doc_id", "key").join(done, "key").drop("key")
