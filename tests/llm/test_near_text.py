import random
import re

import numpy as np

import corpus_pipeline
from lodeweave.llm import near_text, simhash
from tests.conftest import DATA


def plain_shingles(text, width=5):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()) if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain_kept(docs):
    """The least id of each component of texts of Jaccard 0.8 and more, every pair compared."""
    docs = sorted(docs)
    sets = [plain_shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [docs[i][0] for i in range(len(docs)) if root(i) == i]


def kept_by_stage(spark, docs):
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, None).collect())


def test_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    assert kept_by_stage(spark, docs) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_large_groups_of_edited_copies(spark):
    rng, rows = random.Random(3), []
    bases = [[f"w{rng.randrange(3000)}" for _ in range(n)] for n in (9, 40, 90, 150)]
    for i in range(240):
        w = list(bases[i % 4])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(3000)}"
        rows.append((i, " ".join(w)))
    want = plain_kept(rows)
    assert 4 < len(want) < 150
    assert kept_by_stage(spark, spark.createDataFrame(rows, "doc_id long, text string")) == want


def edited_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base, rows = [f"w{rng.randrange(3000)}" for _ in range(words)], []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(3000)}"
        rows.append((i, " ".join(w)))
    return rows


def test_fingerprints_go_through_the_index(spark, monkeypatch):
    rows, linked = edited_copies(40, 400, 3, 5), []
    index = simhash.link_fingerprints

    def kept_links(fps, *args, **kwargs):
        linked.append(index(fps, *args, **kwargs))
        return linked[-1]

    monkeypatch.setattr(simhash, "link_fingerprints", kept_links)
    assert kept_by_stage(spark, spark.createDataFrame(rows, "doc_id long, text string")) == plain_kept(rows) == [0]
    assert linked[0].count() > 0


def test_clusters_of_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_text, "CHUNK", 8)
    rows = edited_copies(90, 60, 7, 6)
    want = plain_kept(rows)
    assert 1 < len(want) < 80
    assert kept_by_stage(spark, spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_similar_sets_against_all_pairs():
    rng = random.Random(7)
    sets = [np.unique(np.array([rng.randrange(14) for _ in range(rng.randrange(1, 14))], np.uint32)) for _ in range(60)]
    near = lambda x, y: 5 * len({*x} & {*y}) >= 4 * len({*x} | {*y})
    label = list(range(60))
    for _ in sets:
        for i in range(60):
            label[i] = min(label[j] for j in range(60) if near(sets[i].tolist(), sets[j].tolist()))
    assert near_text.similar(sets).tolist() == label and len({*label}) > 3


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    for words in (1, 32):
        for _ in range(200):
            x, y = (np.unique(rng.integers(0, 1 << 63, rng.integers(0, 300))) for _ in range(2))
            y = np.union1d(y[: rng.integers(0, 40)], x)
            apart = int(np.bitwise_count(near_text.parities(x, words) ^ near_text.parities(y, words)).sum())
            assert apart <= len(np.setxor1d(x, y)) and (apart - len(np.setxor1d(x, y))) % 2 == 0


def test_short_texts_with_one_shingle_in_common_are_no_cluster(spark):
    rows = [(i, " ".join([*(f"s{i // 2}x{k}" for k in range(5)), *(f"w{i}x{k}" for k in range(20))])) for i in range(600)]
    rows += [(600 + i, " ".join([f"v{k}" for k in range(40)] + [f"u{i}"])) for i in range(2)]
    marked = near_text.described(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    found = near_text.clusters_by_shingles(marked, marked.select("node", "n", "fp", "fp2", "odd"))
    near = {r.doc_id for r in found.join(marked, "node").select("doc_id").collect()}
    marked.unpersist()
    assert near == {600, 601}


def test_small_blocks_are_tested_at_once_as_walked(monkeypatch):
    rng, several = np.random.default_rng(9), 0
    for _ in range(100):
        sets = [np.setdiff1d(np.arange(30, dtype=np.uint64), rng.integers(0, 30, rng.integers(0, 12)).astype(np.uint64)) for _ in range(rng.integers(2, 20))]
        odd, n = np.array([near_text.parities(x)[0] for x in sets]).view(np.int64), np.array([len(x) for x in sets])
        columns = n, np.zeros_like(n), np.zeros_like(n), odd, np.zeros_like(n)
        monkeypatch.setattr(near_text, "TABLE", 64)
        once = near_text.neighbours(*columns)
        monkeypatch.setattr(near_text, "TABLE", 0)
        assert once.tolist() == near_text.neighbours(*columns).tolist()
        several += 1 < len({*once.tolist()}) < len(sets)
    assert several > 3


def dealt_parts(spark, clusters):
    rows = near_text.deals(spark.createDataFrame([(c, i) for c, own in clusters.items() for i in own], "cluster long, node long")).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.part, set()).add(r.node)
    assert len(rows) == sum(map(len, parts.values()))
    for own in clusters.values():  # no pair is lost
        assert all(any({i, j} <= held for held in parts.values()) for i in own for j in own)
    return len(rows)


def test_overlapping_clusters_take_each_set_once(spark):
    assert dealt_parts(spark, {c: range(c, c + 10) for c in range(30)} | {99: [70, 71]}) == 41  # and not 302


def test_large_groups_are_dealt_by_what_takes_fewer_sets(spark, monkeypatch):
    monkeypatch.setattr(near_text, "CHUNK", 8)
    assert dealt_parts(spark, {c: range(2 * c, 2 * c + 3) for c in range(40)}) == 120  # a chain: by its clusters
    assert dealt_parts(spark, {c: [*range(20), 20 + c] for c in range(30)}) < 30 * 21 * 2  # near copies: by their group
    assert dealt_parts(spark, {1: range(50), 2: [60, 61]}) == 50 * 6 + 2


def even_words(n, seed):
    """Words whose shingles set each bit of both fingerprints in about half of them, so that a few edits turn many bits."""
    rng, total = random.Random(seed), np.zeros(128, int)
    words = [f"w{rng.randrange(5000)}" for _ in range(4)]
    while len(words) < n:
        tried = []
        for k in [rng.randrange(5000) for _ in range(40)]:
            h = simhash.shingles(" ".join([*words[-4:], f"w{k}"]), 5)
            both = np.concatenate([h, (h ^ h >> np.uint64(29)) * near_text._ODD])
            sums = total + np.unpackbits(both.view(np.uint8), bitorder="little").astype(int) * 2 - 1
            tried.append((np.abs(sums).sum(), k, sums))
        _, k, total = min(tried, key=lambda x: x[:2])
        words.append(f"w{k}")
    return words


def test_similar_texts_with_far_fingerprints_are_linked(spark):
    rows = []
    for i in range(4):
        words = even_words(200, i)
        edited = [f"x{k}" if k in (30, 75, 120, 165) else w for k, w in enumerate(words)]  # 176 of 216 shingles are in both
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    held = {r.doc_id: r for r in near_text.described(frame).collect()}
    apart = [sum(((held[i][c] ^ held[i + 1][c]) % (1 << 64)).bit_count() for c in ("fp", "fp2")) for i in (0, 2, 4, 6)]
    assert max(apart) > near_text.BITS
    assert kept_by_stage(spark, frame) == plain_kept(rows) == [0, 2, 4, 6]


def test_no_similar_pair_is_ruled_out_in_a_block():
    rng, links, ruled_out = np.random.default_rng(10), 0, 0
    for size in (40, 64, 65, 130, 500, 3000, 40_000):
        pool, sets = rng.integers(0, 1 << 62, 2 * size).astype(np.uint64), []
        for _ in range(12):
            sets.append(np.unique(np.concatenate([pool[: size - rng.integers(0, size // 3)], pool[size:][: rng.integers(0, size // 12 + 1)]])))
        sets += [np.unique(rng.integers(0, 1 << 62, size + rng.integers(0, 9)).astype(np.uint64)) for _ in range(4)]
        n, order = np.array([len(x) for x in sets]), rng.permutation(16)
        sets, n = [sets[k] for k in order], n[order]
        fps = rng.integers(-(1 << 63), 1 << 63, (2, 16))  # as far apart as any two texts'
        odd = np.array([near_text.sized_parities(x) for x in sets], object)
        found = near_text.tested(n, *fps, odd, np.zeros(16, int))(np.arange(16)[:, None], np.arange(16))
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                common = len(np.intersect1d(x, y))
                if 9 * common >= 4 * (len(x) + len(y)):
                    assert found[i, j] and found[j, i]
                    links += 1
                elif common == 0 and size < 36_000:
                    assert not found[i, j]
                    ruled_out += 1
    assert links > 50 and ruled_out > 50
