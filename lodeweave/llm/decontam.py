"""Benchmark decontamination over a positional inverted index of the training tokens.

Words are runs of ASCII digits and letters (A-Z lower-cased) and of all characters beyond ASCII. A
benchmark item gives its windows of `width` consecutive words; an item of fewer words is one window.

1. The corpus frequency of every test term is counted. A window may miss 1 - `share` of its terms; one
   of which the corpus lacks more can't occur and goes.
2. Of the terms that the corpus has, as many of the rarest as the window may still miss, and two more,
   are its anchors: in any match two of them are there (one, if one term alone makes a match).
3. The index is stored: postings (term, document, position) of the test terms. Where no two anchors of
   some window are near each other nothing can match, so postings out of a window's reach of such a place
   are left out, those of frequent terms among them.
4. Documents and windows meet on the anchors; pairs with two anchors of the window in the document stay.
   Then the window's posting lists in that document, each adjusted by its term's offset, are intersected
   from the rarest term to the commonest. A start at which all lists meet is an exact phrase; one at which
   lists of at least `share` of the terms have a position within `slop` is a proximity match, but for starts
   within `slop` of an exact phrase's; a start goes as soon as it has missed too many terms.

Both passes over the corpus drop words through a sieve, a bitmap of SIEVE_BITS bits of the terms'
hashes. Its size is the same for any benchmark and so may be broadcast; the later joins on the terms
are exact. Everything keyed by a document is keyed by its text's digest: copies share postings. The
windows of a document come one after another in a sorted stream, not gathered.

Defined cases: null and empty texts have no words, no hits, and are not contaminated; a very long text is
one list of words, and its postings are of it alone; an item without words has no window; a null item_id
counts as the item ''; items of equal id are one item; a null doc_id stays null; repeated documents give a
row each; an empty benchmark hits nothing; an empty corpus gives no rows; further columns of either table
are not read, and stay as they are in `clean`, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, spare, text_bytes, text_key

SIEVE_BITS = 1 << 22
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def windows(benchmark: DataFrame, width: int = 13) -> DataFrame:
    """words and items (sorted ids as strings): the distinct windows of all items and the items that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                w = [x.decode() for x in words(text)]
                cuts = [w[i : i + width] for i in range(max(1, len(w) - width + 1))] if w else []
                ids += [item] * len(cuts)
                found += cuts
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.list_(pa.string()))], ["item", "words"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_bytes(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "item string, words array<string>").groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def sieve(terms: DataFrame) -> bytes:
    """A byte for each of SIEVE_BITS hashes: 1 if it is some term's. terms: column term."""
    at = terms.select((F.crc32("term") % SIEVE_BITS).cast("int").alias("at")).distinct().toPandas()["at"].to_numpy()  # SIEVE_BITS rows at most
    held = np.zeros(SIEVE_BITS, np.uint8)
    held[at.astype(np.int64)] = 1
    return held.tobytes()


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each term occurs in the corpus; terms that don't occur are left out."""
    held = docs.sparkSession.sparkContext.broadcast(sieve(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieved, total = held.value, Counter()
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).cast(pa.binary()):
                seen.update(words(text.as_py()))
                if len(seen) > 500_000:
                    total.update({w: n for w, n in seen.items() if sieved[crc32(w) % SIEVE_BITS]})
                    seen.clear()
            total.update({w: n for w, n in seen.items() if sieved[crc32(w) % SIEVE_BITS]})
            if len(total) > 500_000:
                yield _counts(total)
                total = Counter()
        yield _counts(total)

    counted = docs.select(text_bytes(F.col("text")).alias("text")).mapInArrow(run, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n")).join(terms, "term", "left_semi")


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])


def anchors(wins: DataFrame, freq: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Of the windows that can occur: window (a number), words, items, order (offsets from the rarest term on) and needed (terms);
    and each one's anchors: window, needed, term, others (the terms of which one must be near; '': none must)."""
    each = wins.select("words", "items", F.posexplode("words").alias("offset", "term")).join(freq, "term", "left")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))).alias("ordered")
    held = each.groupBy("words").agg(ordered, F.first("items").alias("items")).withColumn("needed", F.ceil(F.size("words") * share).cast("int"))
    held = held.withColumn("present", F.expr("filter(ordered, x -> x.n > 0)")).where("size(present) >= needed")
    held = cut(held.select(F.monotonically_increasing_id().alias("window"), "words", "items", "needed", F.expr("transform(ordered, x -> x.offset)").alias("order"), F.expr("slice(present, 1, size(present) - needed + 2)").alias("rare")))
    one = held.select("window", "needed", "rare", F.inline("rare"))
    others = F.when(F.col("needed") < 2, F.array(F.lit(""))).otherwise(F.expr("transform(filter(rare, x -> x.offset != offset), x -> x.term)"))
    return held.drop("rare"), one.select("window", "needed", "term", others.alias("others"))


def index(docs: DataFrame, anchored: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """doc_id, key, n_words and postings: term, position, and whether it is an anchor, within reach of two anchors of a window that are near each other."""
    paired = anchored.select("term", F.explode("others").alias("other")).select(F.concat_ws(" ", "term", "other").alias("term"))
    held = docs.sparkSession.sparkContext.broadcast((sieve(terms), sieve(anchored), sieve(paired)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tested, sieved, pairs = held.value

        class Known(dict):
            """3: an anchor that needs no other, 2: an anchor, 1: a test term, 0: neither."""

            def __missing__(self, x: bytes) -> int:
                place = crc32(x) % SIEVE_BITS
                self[x] = found = (2 + pairs[crc32(x + b" ") % SIEVE_BITS]) if sieved[place] else tested[place]
                return found

        class Paired(dict):
            def __missing__(self, two: tuple[bytes, bytes]) -> int:
                self[two] = found = pairs[crc32(b"%b %b" % two) % SIEVE_BITS]
                return found

        known, paired = Known(), Paired()

        def meeting(w: list[bytes], at: list[int], marks: bytes) -> Iterator[int]:
            """Places of anchors with another of the same window in reach (which may be the same place)."""
            lo = hi = 0
            for i in at:
                while at[lo] < i - reach:
                    lo += 1
                while hi < len(at) and at[hi] <= i + reach:
                    hi += 1
                if marks[i] > 2:
                    yield i
                    continue
                own = w[i]
                for j in at[lo:hi]:
                    if paired[own, w[j]]:
                        yield i
                        break

        for batch in batches:
            sizes, ends, held_terms, places, flags = [], [0], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                w = words(text.as_py())
                if len(known) > 500_000:
                    known.clear()
                if len(paired) > 500_000:
                    paired.clear()
                marks = bytes(map(known.__getitem__, w))
                done = 0
                for i in meeting(w, np.flatnonzero(np.frombuffer(marks, np.uint8) > 1).tolist(), marks):
                    for j in range(max(done, i - reach), min(len(w), i + reach + 1)):
                        if k := marks[j]:
                            held_terms.append(w[j])
                            places.append(j)
                            flags.append(k > 1)
                    done = max(done, min(len(w), i + reach + 1))
                sizes.append(len(w))
                ends.append(len(places))
            postings = pa.StructArray.from_arrays([pa.array(held_terms, pa.binary()).cast(pa.string()), pa.array(places, pa.int32()), pa.array(flags, pa.bool_())], ["term", "at", "anchor"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), postings)], ["doc_id", "key", "n_words", "postings"])

    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), text_bytes(F.col("text")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, key binary, n_words long, postings array<struct<term:string,at:int,anchor:boolean>>")


def _close(starts: list[tuple[int, int]], most: int) -> bool:
    """Whether two of the sorted (start, offset) of different offsets are at most so far apart."""
    last: dict[int, int] = {}
    for s, i in starts:
        if any(j != i and s - t <= most for j, t in last.items()):
            return True
        last[i] = s
    return False


def intersect(lists: dict[str, set[int]], window: list[str], order: list[int], needed: int, slop: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Starts of exact phrases, and (start, terms found) of proximity matches, of one window in one document.

    lists: positions of each term. order: the window's offsets, from the rarest term on.
    """
    spare_terms = len(window) - needed
    if needed > 1:  # of the rarest spare_terms + 2 terms a match has two, within `slop` of their places
        starts = sorted((p - i, i) for i in order[: spare_terms + 2] for p in lists.get(window[i], ()))
        if not _close(starts, 2 * slop):
            return [], []
    first = order[0]
    exact = {p - first for p in lists.get(window[first], ())}
    for i in order[1:]:
        if not exact:
            break
        here = lists.get(window[i], ())
        exact = {s for s in exact if s + i in here}
    skip, found = {s + d for s in exact for d in range(-slop, slop + 1)}, {}
    for k, i in enumerate(order):
        if k > spare_terms and not found:
            break
        here = lists.get(window[i], ())
        if k <= spare_terms:  # a start that has none of the first spare_terms + 1 terms has missed too many
            for p in here:
                for s in range(p - i - slop, p - i + slop + 1):
                    if s not in skip:
                        found.setdefault(s, 0)
        for s in list(found):
            if any(p in here for p in range(s + i - slop, s + i + slop + 1)):
                found[s] += 1
            elif found[s] + len(order) - k - 1 < needed:
                del found[s]
    return sorted(exact), sorted((s, n) for s, n in found.items() if n >= needed)


def matches(indexed: DataFrame, wins: DataFrame, anchored: DataFrame, slop: int = 2) -> DataFrame:
    """key, start, length, items, exact, found (terms in or near their places): exact phrases and proximity matches."""
    held = cut(indexed.where("size(postings) > 0").groupBy("key").agg(F.first("postings").alias("postings")))  # of equal texts, so equal
    terms = held.select("key", F.explode(F.expr("array_distinct(transform(filter(postings, x -> x.anchor), x -> x.term))")).alias("term"))
    pairs = terms.join(anchored.drop("others"), "term").groupBy("key", "window").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed")).where(F.col("n") >= F.least(F.lit(2), "needed"))
    asked = pairs.select("key", "window").join(wins, "window").select("key", "words", "items", "needed", "order")
    none = F.lit(None)
    lists = held.select("key", none.cast("array<string>").alias("words"), none.cast("array<string>").alias("items"), none.cast("int").alias("needed"), none.cast("array<int>").alias("order"), "postings")
    rows = lists.unionByName(asked.withColumn("postings", none.cast(held.schema["postings"].dataType)))
    rows = rows.repartition("key").sortWithinPartitions("key", F.col("words").isNotNull())
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[str, set[int]] = {}
        for batch in batches:
            out = []
            rows, ends = batch.column(5), batch.column(5).offsets.to_pylist()
            held_terms, places = (rows.values.field(k).to_pylist() for k in (0, 1))
            for n, (key, window, items, needed, order) in enumerate(zip(*batch.columns[:5], strict=True)):
                if not window.is_valid:
                    lists = {}
                    for term, at in zip(held_terms[ends[n] : ends[n + 1]], places[ends[n] : ends[n + 1]], strict=True):
                        lists.setdefault(term, set()).add(at)
                    continue
                window = window.as_py()
                exact, near = intersect(lists, window, order.as_py(), needed.as_py(), slop)
                if exact or near:
                    key, items, size = key.as_py(), items.as_py(), len(window)
                    out += [(key, s, size, items, True, size) for s in exact] + [(key, s, size, items, False, k) for s, k in near]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "start", "length", "items", "exact", "found"])

    return rows.mapInArrow(run, "key binary, start int, length int, items array<string>, exact boolean, found int")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, slop: int = 2, share: float = 0.8) -> DataFrame:
    """Per document: doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items by proximity alone)."""
    wins = cut(windows(benchmark, width))
    terms = wins.select(F.explode("words").alias("term")).distinct()
    held, anchored = anchors(wins, frequencies(docs, terms), share)
    indexed = cut(index(docs, anchored, terms, width - 1 + 2 * slop))
    found = cut(matches(indexed, held, anchored, slop))
    exact = found.where("exact")
    hit = exact.select("key", F.explode(F.expr("sequence(start, start + length - 1)")).alias("at")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    by_item = found.select("key", "exact", F.explode("items").alias("item")).groupBy("key", "item").agg(F.max("exact").alias("exact"))
    items = by_item.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count_if(~F.col("exact")).alias("n_near"))
    by_key = cut(items.join(hit, "key", "left"))  # apart, so that a frequent text can be split
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return indexed.select("doc_id", "key", "n_words").join(by_key, "key", "left").select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """The documents that are not contaminated, with the columns of docs."""
    key, bad_key = spare("_key", "_bad", taken=docs.columns)
    bad = contamination(docs, benchmark, width).where("contaminated").select(F.col("key").alias(bad_key)).distinct()
    return docs.withColumn(key, text_key(F.col("text"))).join(bad, F.col(key) == F.col(bad_key), "left_anti").drop(key)
