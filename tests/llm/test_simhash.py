import numpy as np
import pytest
import xxhash

from lodeweave.llm import simhash
from lodeweave.llm.common import cut
from lodeweave.llm.graph import components
from tests.conftest import DATA


def plain_fingerprint(text):
    w = [x for x in __import__("re").split(rb"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()) if x]
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(ids, fps, distance=2):
    label = list(range(len(fps)))
    x = np.array(fps, np.uint64)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= distance) + i + 1:
            label[max(root(i), root(j))] = min(root(i), root(j))
    roots = [root(i) for i in range(len(fps))]
    least = {}
    for i, r in zip(ids, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in roots]


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, plain_components([r.doc_id for r in rows], fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_components(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip((str(d) for d, _ in rows), (f"{f:016x}" for f in fps), map(str, plain_components([d for d, _ in rows], fps))))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_components(odd_docs).collect()) == want
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({w[2] for w in want})


def test_no_rows(no_docs):
    assert simhash.near_components(no_docs).count() == 0
    assert simhash.one_of_each(no_docs).count() == 0


def in_gray_order(fps):
    gray = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(k)
    return fps[np.argsort(gray)]


def cluster(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, max(1, n // 20), dtype=np.uint64)
    return in_gray_order(np.unique(base[rng.integers(0, len(base), n)] ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))))


@pytest.mark.parametrize("n", [1, 2, 9, 500])
def test_index_finds_every_link(n):
    fps, other = cluster(n, n), cluster(n + 1, 2 * n)[:512]
    other[: n // 2] = fps[: n // 2] ^ np.uint64(5)
    other = in_gray_order(np.unique(other))
    for x, y in ((fps, fps), (fps, other)):
        here = simhash.GrayIndex(x)
        there = here if y is x else simhash.GrayIndex(y)
        want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ y[None]) <= 2)) if y is not x or i < j}
        assert {p for a, b in here.links(there, 2) for p in zip(a.tolist(), b.tolist())} == want


def roots_of(frame, fps, **sizes):
    roots = {r.node: r.root for r in components(simhash.link_fingerprints(frame, 2, **sizes)).collect()}
    groups = {}
    for f, c in zip(fps.view(np.int64).tolist(), plain_components(fps.view(np.int64).tolist(), fps.tolist())):
        groups.setdefault(c, set()).add(roots.get(f, f))
    return groups


@pytest.mark.parametrize("block", [8, 64, 512])
def test_dense_groups_lose_no_link(spark, block):
    rng = np.random.default_rng(5)
    centre = np.uint64(0x1234567890ABCDEF)
    one, two = (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64) for _ in range(2))
    fps = np.unique(np.concatenate([centre ^ one ^ two, cluster(3, 300)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    groups = roots_of(frame, fps, block=block)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set().union(*groups.values()))


def test_upper_nodes_prune_whole_groups(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    fps = cut(simhash.fingerprints(docs.select("doc_id", "text")).select("fp").distinct())
    blocks = simhash.gray_blocks(fps, range_rows=2048, block=32)
    levels = simhash.node_levels(blocks)
    n = blocks.count()
    assert n > 250 and levels[-1].count() == 1 and len(levels) > 3
    pairs = [simhash.block_pairs(levels[k:], 2).count() / (levels[k].count() * (levels[k].count() + 1) / 2) for k in range(len(levels))]
    assert pairs[0] < 0.3 and pairs[1] < 0.8  # shares of all pairs of nodes that are left, at the blocks and one level above
    back = [x for r in blocks.orderBy("id").collect() for x in np.frombuffer(r.fps, np.uint64).tolist()]
    assert back == in_gray_order(np.array(back, np.uint64)).tolist() and len(back) == fps.count()
