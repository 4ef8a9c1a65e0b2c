"""Removal of lines shared with earlier documents, by patience alignment of overlapping pairs.

A document's lines are compared without outer white space. A line weighs as many words as it has, or one
for each LETTERS bytes where that is more (scripts without spaces). A common block is a run of lines that
stands in an earlier document too and weighs `min_words` at least; all lines of all common blocks are
deleted from the later document.

Pairs are found through shared lines and runs of short lines: for each line, the shortest run that begins
there and the shortest that ends there, of those that weigh enough. Any line of a common block is in such
a run of the block. Runs that more than one text holds pair every later document with the run's first
holder (the least document). So pairs grow with the lines, even where one run stands in a third of all
documents, and yet nothing is lost: whatever other documents hold the run too, the first one does. Pairs
are ranked by their rarest run: the fewer texts hold it, the sooner the pair is aligned.

Each pair is aligned by patience diff: lines that are unique in both sequences anchor it, the longest
increasing subsequence of the anchors stays, and the gaps between are aligned in the same way, after
their common heads and tails. Maximal runs of aligned lines are common blocks. An alignment keeps one
order, so runs that stand elsewhere in the earlier document, or repeatedly, may be left over: each such
run is aligned where the earlier document has it, and extended as far as both agree.

Only lines within shared runs are sent to an alignment. The partners of a document come one after another
in a sorted stream, not gathered. Copies of a whole text are treated as a group: its first document is
aligned with earlier ones, and the others are wholly common with it.

Documents are ordered by doc_id (nulls last), then by the text's digest.

Defined cases: null text stays null and has no line; texts without heavy enough shared runs stay as they
are; a very long text is a long sequence of hashes, its runs found in linear time; of repeated rows all
but one are copies, and rows equal in doc_id and text too are told apart no further: the rows of the first
document's id and text all stay; an empty table gives no rows; further columns are kept as they are,
whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lodeweave.llm.alignment import patience
from lodeweave.llm.common import cut, spare, text_bytes, text_key

MIN_WORDS = 8
LETTERS = 12
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)


def weight(line: bytes) -> int:
    return max(len(line.split()), len(line) // LETTERS)


def runs(lines: Sequence[int], words: Sequence[int], least: int) -> list[tuple[int, int, int]]:
    """(from, to, hash) of the shortest runs of lines that weigh `least`: from each line on, and up to each line."""
    upto = [0, *accumulate(words)]
    ends = {(i, bisect_left(upto, upto[i] + least)) for i in range(len(lines)) if upto[i] + least <= upto[-1]}
    ends |= {(bisect_right(upto, upto[j] - least) - 1, j) for j in range(1, len(lines) + 1) if upto[j] >= least}
    if not ends:
        return []
    heads, powers = [0], [1]  # hashes of all beginnings, so that any run's hash is one subtraction
    for x in lines:
        heads.append((heads[-1] * _BASE + (x & 0xFFFFFFFFFFFFFFFF) + 1) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    return [(i, j, (heads[j] - heads[i] * powers[j - i]) % _PRIME) for i, j in sorted(ends)]


def stretches(at: Sequence[int]) -> list[tuple[int, int]]:
    """[from, to) of the parts of increasing places that are without a gap."""
    cuts = [0, *(k for k in range(1, len(at)) if at[k] != at[k - 1] + 1), len(at)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _gapped(lines: Sequence[int], parts: list[tuple[int, int]], side: str) -> list:
    """The lines with a mark of its own, equal to nothing, in place of each gap; and each one's index."""
    out = []
    for a, b in parts:
        out += [(lines[k], k) for k in range(a, b)]
        out.append(((side, a), -1))
    return out


def common_blocks(later: Sequence[int], earlier: Sequence[int], words: Sequence[int], earlier_words: Sequence[int], least: int, at: Sequence[int] | None = None, earlier_at: Sequence[int] | None = None) -> list[tuple[int, int]]:
    """Runs [from, to) of later's lines that weigh `least` and are aligned with earlier. at: the lines' places, where some are left out."""
    own, other = stretches(at or range(len(later))), stretches(earlier_at or range(len(earlier)))
    a, b = _gapped(later, own, "a"), _gapped(earlier, other, "b")
    blocks: list[list[int]] = []
    for i, j in patience([x for x, _ in a], [x for x, _ in b]):
        k = a[i][1]
        if blocks and blocks[-1][1] == k and blocks[-1][2:] == [i, j]:
            blocks[-1][1:] = [k + 1, i + 1, j + 1]
        else:
            blocks.append([k, k + 1, i + 1, j + 1])
    found = [(lo, hi) for lo, hi, *_ in blocks if sum(words[lo:hi]) >= least]
    taken = {k for lo, hi in found for k in range(lo, hi)}
    left = [k for k in range(len(later)) if k not in taken]
    if not left:
        return found
    places = {}
    for lo, hi in other:
        for i, _, h in runs(earlier[lo:hi], earlier_words[lo:hi], least):
            places.setdefault(h, (lo, lo + i, hi))
    for lo, hi in own:
        for i, j, h in runs(later[lo:hi], words[lo:hi], least):
            i, j = lo + i, lo + j
            if h in places and bisect_left(left, i) < bisect_left(left, j):
                first, p, last = places[h]
                q = p + j - i
                while i > lo and p > first and later[i - 1] == earlier[p - 1]:
                    i, p = i - 1, p - 1
                while j < hi and q < last and later[j] == earlier[q]:
                    j, q = j + 1, q + 1
                found.append((i, j))
                del left[bisect_left(left, i) : bisect_left(left, j)]
    return found


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """key, lines (hashes), words (weights) and runs (distinct hashes) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts, size, held, ends = [], [], [0], [], [0]
            for t in batch.column(1).cast(pa.binary()):
                lines = [x.strip() for x in t.as_py().split(b"\n")]
                own, weights = [xxh3_64_intdigest(x) for x in lines], [weight(x) for x in lines]
                held += {h for *_, h in runs(own, weights, least)}
                hashes += own
                counts += weights
                size.append(len(hashes))
                ends.append(len(held))
            at = pa.array(size, pa.int32())
            lists = (pa.ListArray.from_arrays(at, pa.array(np.array(hashes, np.uint64).view(np.int64))), pa.ListArray.from_arrays(at, pa.array(counts, pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(held, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["key", "lines", "words", "runs"])

    return docs.select(text_key(F.col("text")).alias("key"), text_bytes(F.col("text")).alias("text")).mapInArrow(run, "key binary, lines array<long>, words array<int>, runs array<long>")


def _shared_parts(rows: DataFrame, least: int) -> DataFrame:
    """key, at, lines, words: the lines within shared runs, and partners (df, key). rows: key, lines, words, shared (hash, df, partner)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ats, hashes, weights, partners = [], [], [], [], []
            for key, lines, words, shared in zip(*(batch.column(k) for k in range(4)), strict=True):
                lines, words, by = lines.as_py(), words.as_py(), {}
                held = set()
                for s in shared.as_py():
                    held.add(s["run"])
                    if s["partner"] is not None:
                        by[s["partner"]] = min(s["df"], by.get(s["partner"], s["df"]))
                at: list[int] = []
                for i, j, h in runs(lines, words, least):  # in order of i
                    if h in held:
                        at += range(max(i, at[-1] + 1 if at else 0), j)
                keys.append(key.as_py())
                ats.append(at)
                hashes.append([lines[k] for k in at])
                weights.append([words[k] for k in at])
                partners.append([{"df": n, "partner": p} for p, n in by.items()])
            kinds = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.struct([("df", pa.int64()), ("partner", pa.binary())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((keys, ats, hashes, weights, partners), kinds, strict=True)], ["key", "at", "lines", "words", "partners"])

    return rows.mapInArrow(run, "key binary, at array<int>, lines array<long>, words array<int>, partners array<struct<df:long,partner:binary>>")


def _aligned(rows: DataFrame, least: int) -> DataFrame:
    """key, gone: from rows sorted by key, each document's own lines first (df -1), then its partners' lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, gone, taken = None, [], [], set()

        def close():
            if own and taken:
                keys.append(own[0])
                gone.append(sorted(own[1][k] for k in taken))

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("key", "df", "at", "lines", "words")), strict=True):
                key, df, at, lines, words = (x.as_py() for x in row)
                if df < 0:
                    close()
                    own, taken = (key, at, lines, words), set()
                elif len(taken) < len(own[1]):
                    for lo, hi in common_blocks(own[2], lines, own[3], words, least, own[1], at):
                        taken.update(range(lo, hi))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])
                keys, gone = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    return rows.mapInArrow(run, "key binary, gone array<int>")


def shared_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The groups of equal texts (key, first: their first document, n), and key, gone: deleted lines of a group's first document."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    own = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    groups = cut(own.groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")))
    sequences = cut(_lines(docs, min_words).where("size(runs) > 0").groupBy("key").agg(F.first(F.struct("lines", "words", "runs")).alias("s")).select("key", "s.*").join(groups.drop("n"), "key"))

    each = sequences.select("key", "first", F.explode("runs").alias("run"))
    held = cut(each.groupBy("run").agg(F.min("first").alias("earlier"), F.count(F.lit(1)).alias("df")).where("df > 1"))  # apart, so that adaptive execution can split a frequent run
    partner = F.when(F.col("earlier.key") != F.col("key"), F.col("earlier.key"))
    shared = each.select("key", "run").join(held, "run").groupBy("key").agg(F.collect_list(F.struct("run", "df", partner.alias("partner"))).alias("shared"))  # of one text's own runs
    parts = cut(_shared_parts(sequences.select("key", "lines", "words").join(shared, "key").select("key", "lines", "words", "shared"), min_words))

    pairs = parts.select("key", F.inline("partners"))
    theirs = pairs.join(parts.select(F.col("key").alias("partner"), "at", "lines", "words"), "partner").select("key", "df", "partner", "at", "lines", "words")
    mine = parts.where("size(partners) > 0").select("key", F.lit(-1).cast("long").alias("df"), F.lit(None).cast("binary").alias("partner"), "at", "lines", "words")
    rows = mine.unionByName(theirs).repartition("key").sortWithinPartitions("key", "df", "partner")
    return groups, _aligned(rows, min_words)


def without_shared_lines(docs: DataFrame, min_words: int = MIN_WORDS, marks: bool = False) -> DataFrame:
    """The columns of docs with text cut down; with marks also the number of lines and the numbers of deleted lines,
    as _lines and _gone (with underscores added where docs has such a column)."""
    groups, gone = shared_lines(docs, min_words)
    kept_columns = docs.columns
    key, first, cut_out, is_first, n_lines = spare("_key", "_first", "_gone", "_is_first", "_lines", taken=kept_columns)
    placed = docs.withColumn(key, text_key(F.col("text")))
    decided = groups.join(gone, "key", "left").where("n > 1 OR gone IS NOT NULL")
    decided = cut(decided.select(F.col("key").alias(key), F.col("first").alias(first), F.col("gone").alias(cut_out)))  # apart, so that a frequent text can be split
    rows = placed.join(decided, key, "left").select(*[F.col(f"`{c}`") for c in kept_columns], cut_out, (F.col(first).isNull() | F.col("doc_id").eqNullSafe(F.col(f"{first}.doc_id"))).alias(is_first))
    at = kept_columns.index("text")
    text = docs.schema["text"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, removed = [], [], []
            for t, gone, own in zip(batch.column(at).to_pylist(), batch.column(len(kept_columns)).to_pylist(), batch.column(len(kept_columns) + 1).to_pylist(), strict=True):
                lines = [] if t is None else t.split("\n")
                if not own and sum(weight(x.strip()) for x in (t or "").encode().split(b"\n")) >= min_words:
                    gone = range(len(lines))
                out = {*gone} if gone else set()
                texts.append(t if not out else "\n".join(x for i, x in enumerate(lines) if i not in out))
                totals.append(len(lines))
                removed.append(sorted(out))
            columns = [*batch.columns[: len(kept_columns)], pa.array(totals, pa.int32()), pa.array(removed, pa.list_(pa.int32()))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*kept_columns, n_lines, cut_out])

    kinds = [f"`{c}` {text.simpleString() if c == 'text' else docs.schema[c].dataType.simpleString()}" for c in kept_columns]
    out = rows.mapInArrow(run, ", ".join([*kinds, f"`{n_lines}` int", f"`{cut_out}` array<int>"]))
    return out if marks else out.select(*[F.col(f"`{c}`") for c in kept_columns])


def digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), n_kept_bytes, kept_sha256."""
    out = without_shared_lines(docs.select("doc_id", "text"), min_words, marks=True)
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.size("_gone").alias("n_removed"), F.octet_length(text_bytes(F.col("text"))).cast("long").alias("n_kept_bytes"), F.sha2(text_bytes(F.col("text")), 256).alias("kept_sha256"))
