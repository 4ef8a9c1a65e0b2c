"""Best-fit packing of documents into sequences of several permitted lengths.

Documents become pieces of at most the largest length. Pieces are dealt by a hash to packing cells of
about `cell_tokens` tokens, so the number of cells grows with the corpus and a cell's size doesn't.

Within a cell the permitted lengths are chosen jointly: for each set of them, pieces come in decreasing
length, each goes to the open bin that it fills best, and when none has room, the length of the set with
the least cost per token that the remaining pieces can put into it is opened (the smallest that fits, if
the set has none). Each bin shrinks to the smallest permitted length that holds its contents, and the set
with the least total cost is taken. Then pieces move to other bins, or to a bin of their own,
bins join, as long as the total cost falls; bins that changed shrink again.

Defined cases: a document has one token for each run of non-space characters and one end mark, so null
and empty texts make a piece of one token; a longer document than the largest length is split into as many
pieces as it takes, never cut off; a null doc_id stays null; repeated rows are separate pieces; ties in
length go by doc_id, then piece; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Sequence
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import text_bytes

LENGTHS = (512, 1024, 2048, 4096)
#: Cost of a sequence of length c: OVERHEAD + c + c * c / QUADRATIC.
OVERHEAD, QUADRATIC = 16.0, 65536.0
#: Of the fillings, one for each set of lengths, so many of the cheapest are improved.
JOINT = 4
#: Bins of so many pieces together are filled again by the best of all groupings.
EXACT = 7


def cost(c: int) -> float:
    return OVERHEAD + c + c * c / QUADRATIC


def _fill(sizes: Sequence[int], lengths: Sequence[int], opened: Sequence[int]) -> list[list[int]]:
    """The pieces of each bin, for sizes in decreasing order, with bins opened at the lengths in `opened`."""
    left = sum(sizes)
    open_bins: dict[int, list[int]] = {}
    rooms: list[int] = []
    bins: list[list[int]] = []
    for i, size in enumerate(sizes):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
        else:
            fit = [c for c in opened if c >= size] or lengths[bisect_left(lengths, size) :][:1]
            if not fit:
                raise ValueError(f"a piece of {size} is longer than {lengths[-1]}")
            room = min(fit, key=lambda c: (cost(c) / min(c, left), c))
            b = len(bins)
            bins.append([])
        bins[b].append(i)
        left -= size
        if room > size:
            if room - size not in open_bins:
                insort(rooms, room - size)
            open_bins.setdefault(room - size, []).append(b)
    return bins


def _improve(bins: list[list[int]], sizes: Sequence[int], lengths: Sequence[int]) -> list[list[int]]:
    """Move pieces and join bins as long as the total cost falls."""
    steps = {c: cost(c) for c in lengths}
    fit = lambda n: lengths[bisect_left(lengths, n)]
    price = lambda n: steps[fit(n)] if n else 0.0
    held = [sum(sizes[i] for i in b) for b in bins]
    order = sorted((n, b) for b, n in enumerate(held) if n)

    def change(b: int | None, pieces: list[int]) -> None:
        """Give bin b, or a new one, these pieces."""
        if b is None:
            b = len(bins)
            bins.append([])
            held.append(0)
        if held[b]:
            del order[bisect_left(order, (held[b], b))]
        bins[b], held[b] = pieces, sum(sizes[i] for i in pieces)
        if held[b]:
            insort(order, (held[b], b))

    def partner(b: int, size: int, saved: float) -> int:
        """The bin other than b to which `size` more tokens cost the least and less than what is saved; else -1."""
        best = (saved - 1e-9, -1)
        for c in lengths:
            at = bisect_left(order, (c - size + 1, -1)) - 1
            if at >= 0 and order[at][1] == b:
                at -= 1
            if at >= 0:
                n, other = order[at]
                best = min(best, (price(n + size) - price(n), other))
        return best[1]

    again = True
    while again:
        again = False
        for _, b in sorted((held[b] - fit(held[b]), b) for _, b in order):
            for i in sorted(bins[b], key=lambda i: sizes[i]):
                saved = price(held[b]) - price(held[b] - sizes[i])
                other = partner(b, sizes[i], saved) if saved > 0 else -1
                if other >= 0 or saved > price(sizes[i]) + 1e-9:
                    change(b, [k for k in bins[b] if k != i])
                    change(*((other, [*bins[other], i]) if other >= 0 else (None, [i])))
                    again = True
        for n, b in list(order):
            other = partner(b, n, price(n)) if held[b] == n else -1
            if other >= 0:
                joined = bins[other] + bins[b]
                change(b, [])
                change(other, joined)
                again = True
        group: list[int] = []
        for _, b in sorted((-price(n) / n, b) for n, b in order if fit(n) > n):
            if group and sum(len(bins[x]) for x in group) + len(bins[b]) > EXACT:
                again |= _resolved(group, bins, sizes, price, change, lengths[-1])
                group = []
            if len(bins[b]) <= EXACT:
                group.append(b)
        again |= len(group) > 0 and _resolved(group, bins, sizes, price, change, lengths[-1])
    return [b for b in bins if b]


def _resolved(group: list[int], bins, sizes, price, change, longest: int) -> bool:
    """Put the pieces of a few bins, EXACT at most, into bins at the least cost of all groupings; whether that saves any."""
    pieces = [i for b in group for i in bins[b]]
    total = [0] * (1 << len(pieces))
    for mask in range(1, len(total)):
        low = mask & -mask
        total[mask] = total[mask ^ low] + sizes[pieces[low.bit_length() - 1]]
    best, taken = [0.0] * len(total), [0] * len(total)
    for mask in range(1, len(total)):
        low = mask & -mask
        rest = sub = mask ^ low
        best[mask] = float("inf")
        while True:
            own = sub | low
            if total[own] <= longest and (c := price(total[own]) + best[mask ^ own]) < best[mask]:
                best[mask], taken[mask] = c, own
            if not sub:
                break
            sub = (sub - 1) & rest
    if best[-1] >= sum(price(sum(sizes[i] for i in bins[b])) for b in group) - 1e-9:
        return False
    parts, mask = [], len(total) - 1
    while mask:
        parts.append([i for k, i in enumerate(pieces) if taken[mask] >> k & 1])
        mask ^= taken[mask]
    for b in group:
        change(b, [])
    for b, part in zip(group, parts, strict=False):
        change(b, part)
    for part in parts[len(group) :]:
        change(None, part)
    return True


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """For sizes in decreasing order: each one's bin, its offset there, and the final length of each bin."""
    lengths = sorted(lengths)
    shrunk = lambda bins: [lengths[bisect_left(lengths, sum(sizes[i] for i in b))] for b in bins]
    total = lambda bins: sum(map(cost, shrunk(bins)))
    tried = [_fill(sizes, lengths, opened) for n in range(1, len(lengths) + 1) for opened in combinations(lengths, n)]
    found = min((_improve([b[:] for b in bins], sizes, lengths) for bins in sorted(tried, key=total)[:JOINT]), key=total)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for k, b in enumerate(found):
        at = 0
        for i in sorted(b):
            bins[i], offsets[i] = k, at
            at += sizes[i]
    return bins, offsets, shrunk(found)


def word_tokens(text: Column) -> Column:
    """Runs of non-space characters, and one for the end of the document."""
    return F.regexp_count(text_bytes(text), F.lit(r"\S+")).cast("long") + 1


def pieces(docs: DataFrame, longest: int, tokens: Column | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens, and a salt from the text."""
    n = F.col("_n")
    rows = docs.select("doc_id", (word_tokens(F.col("text")) if tokens is None else tokens).alias("_n"), F.crc32(text_bytes(F.col("text"))).alias("_salt"))
    cut_up = rows.select("doc_id", "_n", "_salt", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / longest).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * longest
    return cut_up.select("doc_id", "piece", start.alias("start"), F.least(n - start, F.lit(longest)).cast("int").alias("n_tokens"), "_salt")


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, cell_tokens: int = 1 << 20, tokens: Column | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id, bin_offset, capacity: one row for each piece.

    tokens: the number of tokens of a row (a Column; default word_tokens), at least 1.
    """
    lengths = tuple(sorted(lengths))
    items = pieces(docs, lengths[-1], tokens)
    total = items.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    cells = max(1, math.ceil(total / cell_tokens))
    dealt = items.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "_salt"), F.lit(cells)))

    def one_cell(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("_salt", "ascending")])
        bins, offsets, capacity = best_fit(t.column("n_tokens").to_pylist(), lengths)
        cell = t.column("cell")[0].as_py()
        return pa.table({
            **{c: t.column(c) for c in ("doc_id", "piece", "start", "n_tokens")},
            "bin_id": pa.array([(cell << 24) + b for b in bins], pa.int64()),
            "bin_offset": pa.array(offsets, pa.int32()),
            "capacity": pa.array([capacity[b] for b in bins], pa.int32()),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("cell").applyInArrow(one_cell, f"doc_id {kind}, piece int, start long, n_tokens int, bin_id long, bin_offset int, capacity int")
