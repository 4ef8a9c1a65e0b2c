import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeweave.llm import packing, queries, sharding
from tests.conftest import DATA


@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    lengths = (16, 32, 64)
    bins, offsets, capacity = packing.best_fit(sizes, lengths)
    content = defaultdict(int)
    for s, b, at in zip(sizes, bins, offsets):
        assert at == content[b]
        content[b] += s
    assert sorted(content) == list(range(len(capacity)))
    assert all(capacity[b] == min(c for c in lengths if c >= n) for b, n in content.items())


def groupings(n, groups=()):
    if not n:
        yield groups
        return
    for k in range(len(groups)):
        yield from groupings(n - 1, (*groups[:k], (*groups[k], n - 1), *groups[k + 1 :]))
    yield from groupings(n - 1, (*groups, (n - 1,)))


@pytest.mark.parametrize(("lengths", "most"), [(packing.LENGTHS, 4096), (packing.LENGTHS, 1500), ((16, 32, 64), 64)])
def test_cost_against_every_grouping(lengths, most):
    rng, ratios = random.Random(most), []
    for _ in range(8):
        sizes = sorted((rng.randint(1, most) for _ in range(9)), reverse=True)
        filled = ([sum(sizes[i] for i in g) for g in gs] for gs in groupings(9))
        least = min(sum(packing.cost(min(c for c in lengths if c >= n)) for n in f) for f in filled if max(f) <= lengths[-1])
        ratios.append(sum(map(packing.cost, packing.best_fit(sizes, lengths)[2])) / least)
    assert sum(ratios) / len(ratios) <= 1.02 and max(ratios) < 1.2


def test_packing_places_every_token_once(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = packing.pack(docs, (128, 256, 1024), cell_tokens=50_000).collect()
    want = {r.doc_id: len(r.text.split()) + 1 for r in docs.collect()}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.n_tokens))
        bins[r.bin_id].append((r.bin_offset, r.n_tokens, r.capacity))
    for d, n in want.items():
        at = 0
        for start, k in sorted(pieces[d]):
            assert start == at
            at += k
        assert at == n
    for b in bins.values():
        at = 0
        for offset, k, capacity in sorted(b):
            assert offset == at
            at += k
        assert at <= capacity == b[0][2]
    assert sum(want.values()) > 0.93 * sum(b[0][2] for b in bins.values())


def test_packing_odd_rows(odd_docs, no_docs):
    assert packing.pack(odd_docs).select("doc_id", "piece", "n_tokens").count() > odd_docs.count()
    assert packing.pack(odd_docs).agg(F.sum("n_tokens")).first()[0] == sum(len((r.text or "").split()) + 1 for r in odd_docs.collect())
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_unit_steps(spark, dims, bits):
    side, names = 1 << bits, [f"x{k}" for k in range(dims)]
    grid = spark.range(side**dims).select(*[F.expr(f"cast(id div {side**k} % {side} as int)").alias(n) for k, n in enumerate(names)])
    cells = sorted((r.h, tuple(r)[:-1]) for r in grid.withColumn("h", sharding.curve_index(names, bits)).collect())
    assert [h for h, _ in cells] == list(range(side**dims))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(cells, cells[1:]))


def check_rows_law(rows, docs, n):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs), key=str)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    counts = [len(by[s]) for s in range(n)]
    assert set(by) <= set(range(n)) and max(counts) - min(counts) <= 1
    last = -1
    for s in range(n):
        own = sorted(by[s], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        for r in own:
            assert r.curve >= last
            last = r.curve


def test_whole_table_is_cut_along_the_curve(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = queries.op2_hilbert_shards(spark, f"{DATA}/sf0.01")
    check_rows_law(got.collect(), [(r.doc_id, r.text) for r in docs.collect()], 8)
    assert {r.law for r in got.collect()} == {"rows"}


def test_sharding_odd_rows(odd_docs, no_docs):
    check_rows_law(sharding.document_shards(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], 8)
    assert sharding.document_shards(no_docs).count() == 0


def test_written_shards_and_their_boxes(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    boxes = sharding.write_shards(docs, sharding.document_shards(docs), str(tmp_path / "shards")).collect()
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() == sum(b.rows for b in boxes)
    ordered = sorted(boxes, key=lambda b: b.shard)
    assert all(a.max_curve <= b.min_curve for a, b in zip(ordered, ordered[1:]))


def test_ranks_of_values_are_even_and_in_order(spark):
    rows = [(None,)] * 3 + [("b",)] * 40 + [(f"v{i:03d}",) for i in range(60)]
    frame = spark.createDataFrame(rows, "x string")
    got = {r.x: r.q for r in sharding.ranked(frame, {"q": "x"}, 4).collect()}
    assert got[None] == 0
    values = sorted(x for x in got if x is not None)
    assert [got[x] for x in values] == sorted(got[x] for x in values) and max(got.values()) == 15
    assert got["v000"] - got["b"] >= 2


def test_predicates_skip_most_shards(spark):
    """Shares of shards whose minima and maxima rule a value out, over all values, weighted by nothing."""
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    placed = sharding.cut(docs.join(sharding.document_shards(docs, n_shards=64).select("doc_id", "shard"), "doc_id").select("shard", "source", "lang", F.octet_length("text").alias("size")))
    boxes = placed.groupBy("shard").agg(*[f(c).alias(f"{n}_{c}") for c in ("source", "lang", "size") for n, f in (("min", F.min), ("max", F.max))]).collect()
    skipped = {}
    for c in ("source", "lang"):
        values = [r[0] for r in placed.select(c).distinct().collect() if r[0] is not None]
        skipped[c] = sum(not b[f"min_{c}"] <= v <= b[f"max_{c}"] for v in values for b in boxes) / len(values) / len(boxes)
    sizes = [r[0] for r in placed.select(F.percentile("size", F.array(*[F.lit(k / 20) for k in range(1, 20)]))).collect()][0]
    skipped["size"] = sum(not b.min_size <= v <= b.max_size for v in sizes for b in boxes) / len(sizes) / len(boxes)
    assert skipped["source"] > 0.6 and skipped["lang"] > 0.5 and skipped["size"] > 0.5, skipped
