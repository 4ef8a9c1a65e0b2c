"""SimHash fingerprints and their near-duplicate components, by a Gray-ordered hierarchical index.

Words are runs of characters other than space and U+0009 to U+000D of the text with A-Z lower-cased;
shingles are `width` consecutive words (fewer words: all of them; none: fingerprint zero). A bit is set
if it is set in over half of the shingles' XXH64 values (seed 42), repeats included.

All distinct fingerprints are sorted by Gray rank, in which neighbours share most bits: range partitions,
sorted and cut into blocks of BLOCK. A block is a node of the index: the mask of the bits on which all of
it agrees, and their values. FAN neighbouring nodes make a node of the level above, up to one root; what
its children agree on is factored out into it. The index is joined with itself from the root: a pair of
nodes becomes the pairs of their children; the differing bits under both masks bound the distance from
below, add up from level to level, and over `distance` a whole pair of groups is dropped. Pairs of blocks
that are left are opened: the same descent goes on within the two, over nodes of FAN fingerprints, and
whole fingerprints decide. A pair of blocks gives a spanning forest of its links, never all links.

Nothing is gathered: levels, pairs of nodes and blocks are frames; a task holds a few pairs of blocks. With
n blocks about n * log2(n)**2 / 4 pairs of them are opened at a distance of 2.

Defined cases: null text is empty text; texts without words are linked to each other like any equal
fingerprints; a very long text is fingerprinted whole, in pieces; repeated rows and ties are of one
fingerprint and so of one component; the component of rows whose every doc_id is null is null; an empty
table gives no rows; further columns are not read, and stay as they are in `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, spare, text_bytes, text_key
from lodeweave.llm.graph import components

FAN = 8
BLOCK = 512  # FAN to the power of 3: a block has three levels of its own
_FAN_BITS = 3


def shingles(text: str | bytes | None, width: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included, in order."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    n = len(words) - width + 1
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned integer."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounds the unpacked bits of a very long text
        bits += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | bytes | None, width: int = 3) -> int:
    """The fingerprint as an unsigned integer."""
    return majority(shingles(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """The columns of docs other than text, and fp, the fingerprint's 64 bits as a signed long."""
    carried = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(carried)).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*carried, "fp"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried]
    return docs.select(*carried, text_bytes(F.col("text")).alias("text")).mapInArrow(run, ", ".join([*kinds, "fp long"]))


class GrayIndex:
    """The index within a block, of fingerprints in Gray order: levels of (mask of shared bits, their values), up to one root."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        mask, value = np.full(len(fps), ~np.uint64(0)), fps
        size = BLOCK
        while size > 1 or len(value) > 1:
            pad = -len(value) % FAN
            m = np.concatenate([mask, np.repeat(mask[-1:], pad)]).reshape(-1, FAN)
            v = np.concatenate([value, np.repeat(value[-1:], pad)]).reshape(-1, FAN)
            shared = np.bitwise_and.reduce(m & ~(v ^ v[:, :1]), axis=1)
            mask, value, size = shared, v[:, 0] & shared, size // FAN
            self.levels.append((mask, value))

    @property
    def root(self) -> tuple[int, int]:
        """Mask and value of the whole block."""
        mask, value = self.levels[-1]
        return int(mask[0]), int(value[0])

    def links(self, other: GrayIndex, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j) of fingerprints here and there at most `distance` bits apart, in pieces; i < j if other is this one."""
        yield from self._below(other, len(self.levels) - 1, np.zeros(1, int), np.zeros(1, int), distance)

    def _below(self, other: GrayIndex, level: int, i: np.ndarray, j: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (m, v), (n, w) = self.levels[level], other.levels[level]
        near = np.bitwise_count((v[i] ^ w[j]) & m[i] & n[j]) <= distance
        i, j = i[near], j[near]
        here, there = (x.levels[level - 1][1] if level else x.fps for x in (self, other))
        step = np.arange(FAN)
        for at in range(0, len(i), 4096):
            a = (i[at : at + 4096, None] * FAN + step)[:, :, None]
            b = (j[at : at + 4096, None] * FAN + step)[:, None, :]
            a, b = (x.ravel() for x in np.broadcast_arrays(a, b))
            keep = (a < len(here)) & (b < len(there))
            if self is other:
                keep &= (a <= b) if level else (a < b)
            a, b = a[keep], b[keep]
            if level:
                yield from self._below(other, level - 1, a, b, distance)
            else:
                near = np.bitwise_count(here[a] ^ there[b]) <= distance
                yield a[near], b[near]


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the least place of its component."""
    label = np.arange(n)
    for a, b in links:
        while len(a):
            x, y = label[a], label[b]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
    return label


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_blocks(fps: DataFrame, range_rows: int = 1 << 16, block: int = BLOCK) -> DataFrame:
    """id, mask, value, fps (bytes): the distinct fingerprints (column fp) in Gray order, by blocks; ids go with the order."""
    ranges = -(-max(1, fps.count()) // range_rows)
    wide = max(1, (2 * range_rows // block - 1).bit_length())  # bits of a block's number in its range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, kept = TaskContext.get().partitionId(), 0, np.zeros(0, np.uint64)
        for batch in _then_none(batches):
            if batch is not None:
                kept = np.concatenate([kept, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            upto = len(kept) // block * block if batch is not None else len(kept)
            cuts = [kept[at : min(at + block, upto)] for at in range(0, upto, block)]
            kept = kept[upto:]
            if cuts:
                roots = [GrayIndex(c).root for c in cuts]
                ids = [(part << 40) | (made + k) for k in range(len(cuts))]
                made += len(cuts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([_signed(r[k]) for r in roots], pa.int64()) for k in (0, 1)), pa.array([c.tobytes() for c in cuts], pa.binary())], ["id", "mask", "value", "fps"])

    placed = fps.select("fp", _gray_rank("fp").alias("gray")).repartitionByRange(ranges, "gray").sortWithinPartitions("gray")
    found = cut(placed.select("fp").mapInArrow(run, "id long, mask long, value long, fps binary"))
    most = found.agg(F.max(F.col("id").bitwiseAND(F.lit((1 << 40) - 1)))).first()[0]
    wide = max(wide, int(most or 0).bit_length())
    return found.withColumn("id", F.shiftleft(F.shiftright("id", 40), wide).bitwiseOR(F.col("id").bitwiseAND(F.lit((1 << 40) - 1))))


def node_levels(blocks: DataFrame) -> list[DataFrame]:
    """id, mask, value of the nodes of each level, from the blocks to the root."""
    levels = [blocks.select("id", "mask", "value")]
    agreed = F.bit_and("mask").bitwiseAND(F.bit_and("value").bitwiseOR(F.bitwise_not(F.bit_or("value"))))
    top = blocks.agg(F.max("id")).first()[0]
    while top:
        up = levels[-1].groupBy(F.shiftright("id", _FAN_BITS).alias("id")).agg(agreed.alias("mask"), F.bit_and("value").alias("value"))
        levels.append(cut(up.select("id", "mask", F.col("value").bitwiseAND(F.col("mask")).alias("value"))))
        top >>= _FAN_BITS
    return levels


def block_pairs(levels: list[DataFrame], distance: int) -> DataFrame:
    """u <= v: the pairs of blocks that the index can't tell to be over `distance` bits apart."""
    pairs = levels[-1].select(F.col("id").alias("u"), F.col("id").alias("v"))
    apart = F.bit_count(F.expr("(x.value ^ y.value) & x.mask & y.mask"))
    for level in levels[-2::-1]:
        below = level.groupBy(F.shiftright("id", _FAN_BITS).alias("up")).agg(F.collect_list(F.struct("id", "mask", "value")).alias("nodes"))  # FAN at most
        both = pairs.join(below.select(F.col("up").alias("u"), F.col("nodes").alias("a")), "u").join(below.select(F.col("up").alias("v"), F.col("nodes").alias("b")), "v")
        opened = both.select("b", F.explode("a").alias("x")).select("x", F.explode("b").alias("y"))
        pairs = opened.where((F.col("x.id") <= F.col("y.id")) & (apart <= distance)).select(F.col("x.id").alias("u"), F.col("y.id").alias("v"))
    return pairs


def link_fingerprints(fps: DataFrame, distance: int = 2, block: int = BLOCK) -> DataFrame:
    """Edges a, b that join the linked ones of distinct fingerprints (column fp) into components."""
    blocks = gray_blocks(fps, block=block)
    pairs = block_pairs(node_levels(blocks), distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                a = np.frombuffer(one.as_py(), np.uint64)
                if two.is_valid:
                    first, second = a, np.frombuffer(two.as_py(), np.uint64)
                    found = ((i, j + len(first)) for i, j in GrayIndex(first).links(GrayIndex(second), distance))
                    a = np.concatenate([first, second])
                else:
                    index = GrayIndex(a)
                    found = index.links(index, distance)
                label = forest(len(a), found)
                moved = np.flatnonzero(label != np.arange(len(a)))
                out.append((a[moved], a[label[moved]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]).view(np.int64)) for k in (0, 1)], ["a", "b"])

    held = blocks.select("id", "fps")
    opened = pairs.join(held.select(F.col("id").alias("u"), F.col("fps").alias("one")), "u").join(held.select(F.col("id").alias("v"), F.col("fps").alias("two")), "v")
    return opened.select("one", F.when(F.col("u") != F.col("v"), F.col("two")).alias("two")).mapInArrow(run, "a long, b long")


def _then_none(items):
    yield from items
    yield None


def _gray_rank(c: str):
    """Rank in Gray order: the prefix parity of the bits, as signed long with the order of unsigned."""
    x = F.col(c)
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def rooted(marked: DataFrame, distance: int) -> DataFrame:
    """fp and root, the fingerprint that names its component."""
    distinct = cut(marked.select("fp").distinct())
    roots = components(link_fingerprints(distinct, distance)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_components(docs: DataFrame, distance: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id of the linked documents)."""
    marked = cut(fingerprints(docs.select("doc_id", "text"), width))
    by_root = rooted(marked, distance)
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(by_root, "fp")
    least = first.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = by_root.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, marked: DataFrame, rooted: DataFrame) -> DataFrame:
    """The document of the least doc_id (nulls last), then text key, of each component. marked: doc_id, _key, node; rooted: node, root.

    Of rows equal in doc_id and text the one whose other columns come first as JSON stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    first = marked.groupBy("node").agg(F.min(order).alias("first"))
    kept = first.join(rooted, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.doc_id", "first._key")
    key, kept_id, kept_key, whole = spare("_key", "_id", "_kept", "_whole", taken=docs.columns)
    kept = cut(kept.select(F.col("doc_id").alias(kept_id), F.col("_key").alias(kept_key)))
    out = docs.withColumn(key, text_key(F.col("text"))).join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col("_key") == F.col(kept_key))
    repeated = marked.groupBy("doc_id", "_key").count().where("count > 1").join(kept, same, "left_semi")
    if not repeated.isEmpty():
        least = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
        out = out.groupBy("doc_id", key).agg(least.alias(whole)).select(f"{whole}.*")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(docs: DataFrame, distance: int = 2, width: int = 3) -> DataFrame:
    """One document of each component, with the columns of docs."""
    marked = cut(fingerprints(docs.select("doc_id", text_key(F.col("text")).alias("_key"), "text"), width))
    return first_of_each(docs, marked.withColumnRenamed("fp", "node"), rooted(marked, distance).withColumnRenamed("fp", "node"))
