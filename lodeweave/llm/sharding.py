"""Shards along a Hilbert curve over quantised metadata, with DataFrame functions only.

Several metadata dimensions are quantised to `bits` bits each, every row gets its index on the Hilbert
curve through that grid, and the rows in curve order are cut into runs of equal count. Rows near each
other on the curve are near in every dimension, so each shard spans a small box of the grid, and a reader
with predicates on any of them skips shards by their minima and maxima.

A dimension is quantised by rank: its distinct values are sorted, and a value's place among all rows, as a
share of them, is its coordinate. So neighbours stay neighbours, as minima and maxima need it, and every
coordinate has about as many rows as the others. Ranks are summed in two levels: over ranges of values, then
within each.

The global rank on the curve needs no global sort: rows are counted by curve cell (at most 2**(bits*dims)
cells, so that table may be broadcast), cells of many rows are dealt by a hash of the ordering columns into
buckets of about `bucket_rows`, counts are summed along the curve, and a row's rank is its cell's offset,
plus its bucket's, plus its number within the bucket.

Defined cases: null text has size 1 and the crc32 of no bytes (0); a null dimension has coordinate 0; a null
doc_id sorts first; a very long text counts by its size and crc32 alone; repeated rows are separate rows
with ranks of their own; ties break by doc_id, crc32 and size, so only rows equal in all three may swap; an
empty table gives no rows. Only the named columns are read, so further columns don't matter.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, partitions, text_bytes


@cache
def curve_automaton(dims: int) -> tuple[list[int], list[int]]:
    """Hilbert curve as a finite automaton: for each state and corner, the curve digit and the next state.

    A state is (entry corner e, direction d) of a subcube. The corner is reflected and rotated to the
    standard orientation, its Gray rank is the digit, and the digit's own entry and direction turn the state.
    """
    side, mask = 1 << dims, (1 << dims) - 1

    def turned(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & mask

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    rank = {gray(i): i for i in range(side)}

    def trailing_ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    digits, following = [], []
    for e in range(side):
        for d in range(dims):
            for corner in range(side):
                w = rank[turned(corner ^ e, -(d + 1))]
                entry = 0 if w == 0 else gray(2 * ((w - 1) // 2))
                along = 0 if w == 0 else trailing_ones(w if w % 2 else w - 1) % dims
                digits.append(w)
                following.append((e ^ turned(entry, d + 1)) * dims + (d + along + 1) % dims)
    return digits, following


def curve_index(dims: list[str], bits: int) -> Column:
    """Hilbert index of integer columns with values in [0, 2**bits): one automaton step for each bit."""
    digits, following = curve_automaton(len(dims))
    side = 1 << len(dims)
    corner = " + ".join(f"(shiftright(`{c}`, b) % 2) * {1 << j}" for j, c in enumerate(dims))
    at = f"a.s * {side} + {corner} + 1"
    step = f"named_struct('h', a.h * {side}L + element_at(array({','.join(map(str, digits))}), cast({at} AS INT)), 's', element_at(array({','.join(map(str, following))}), cast({at} AS INT)))"
    return F.expr(f"aggregate(sequence({bits - 1}, 0, -1), named_struct('h', 0L, 's', 0), (a, b) -> {step}, a -> a.h)")


def ranked(rows: DataFrame, dims: dict[str, str], bits: int) -> DataFrame:
    """rows with a coordinate of `bits` bits by rank for each dimension: dims maps its name to the column it ranks."""
    for name, column in dims.items():
        counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
        values = cut(counted.repartitionByRange(partitions(rows.sparkSession), "_value").select("_value", "_n", F.spark_partition_id().alias("_range")))
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = values.groupBy("_range").agg(F.sum("_n").alias("_range_n"))  # one row for each shuffle partition
        ranges = ranges.select("_range", F.coalesce(F.sum("_range_n").over(before), F.lit(0)).alias("_range_at"), F.sum("_range_n").over(Window.partitionBy()).alias("_all"))
        within = F.sum("_n").over(Window.partitionBy("_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        middle = F.col("_range_at") + F.col("_within") - (F.col("_n") + 1) / 2
        coordinates = values.withColumn("_within", within).join(ranges, "_range").select("_value", F.floor(middle * (1 << bits) / F.col("_all")).cast("int").alias(name))
        rows = rows.join(coordinates, F.col(column) == F.col("_value"), "left").drop("_value").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


def cut_runs(rows: DataFrame, dims: list[str], n_shards: int, order: list[str], bits: int = 5, bucket_rows: int = 100_000) -> DataFrame:
    """rows with curve, rank, shard and slot: `n_shards` runs along the curve, counts at most one apart.

    dims: columns with coordinates of `bits` bits. order: columns that order the rows of a curve cell's bucket.
    """
    placed = cut(rows.withColumn("curve", curve_index(dims, bits)).drop(*dims))
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("curve").agg(F.count(F.lit(1)).alias("_cell_n"))
    cells = cut(cells.select("curve", "_cell_n", F.coalesce(F.sum("_cell_n").over(along), F.lit(0)).alias("_cell_at"), F.sum("_cell_n").over(Window.partitionBy()).alias("_all")))
    bucket = F.pmod(F.xxhash64(*order), F.ceil(F.col("_cell_n") / bucket_rows))
    dealt = placed.join(F.broadcast(cells), "curve").withColumn("_bucket", bucket)  # 2 ** (bits * dims) cells at most
    by_bucket = dealt.groupBy("curve", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy("curve").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = by_bucket.select("curve", "_bucket", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_bucket_at"))
    number = F.row_number().over(Window.partitionBy("curve", "_bucket").orderBy(*order))
    found = dealt.withColumn("_number", number).join(at, ["curve", "_bucket"]).withColumn("rank", F.col("_cell_at") + F.col("_bucket_at") + F.col("_number") - 1)
    sharded = found.withColumn("shard", F.expr(f"cast(rank * {n_shards} div _all AS INT)"))
    return sharded.withColumn("slot", F.expr(f"rank - (shard * _all + {n_shards - 1}) div {n_shards}")).drop("_bucket", "_number", "_cell_n", "_cell_at", "_bucket_at", "_all")


def document_shards(docs: DataFrame, n_shards: int = 8, bits: int = 5) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve. Dimensions: source, lang, size."""
    rows = docs.select("doc_id", (F.octet_length(text_bytes(F.col("text"))) + 1).cast("long").alias("size"), F.crc32(text_bytes(F.col("text"))).alias("text_crc32"), "source", "lang")
    dims = {"_by_source": "source", "_by_lang": "lang", "_by_size": "size"}
    out = cut_runs(ranked(cut(rows), dims, bits), list(dims), n_shards, ["doc_id", "text_crc32", "size"], bits)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, shards: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Write docs as Parquet folders by shard, each file sorted along the curve; return each shard's box for pruning.

    `key` must be unique in both frames.
    """
    placed = docs.join(shards.select(key, "shard", "slot", "curve"), key)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{n}_{c}") for c in ("curve", "source", "lang", "n_chars") for n, f in (("min", F.min), ("max", F.max))])
