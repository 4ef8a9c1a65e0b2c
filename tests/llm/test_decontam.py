import hashlib
import random
import re

from lodeweave.llm import decontam
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, width=13):
    wins = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    out = []
    sizes = {len(w) for w in wins}
    for doc, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect()), key=str)


def test_whole_tables_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows_of(decontam.contamination(docs, items)) == want
    assert any(w[5] for w in want)
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)


def test_short_items_odd_rows_and_repeats(spark, odd_docs):
    items = [(1, "the only one"), (2, "x"), (None, "line here of some length"), (3, ""), (4, None), (5, "missing phrase"), (5, "filler word0 filler"), (6, "a"), (6, "a")]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id int, text string, n int")
    want = plain([(r.doc_id, r.text) for r in odd_docs.collect()], items)
    assert rows_of(decontam.contamination(odd_docs, bench)) == want


def test_proximity_match(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    near = item.replace("gamma", "gamma inserted").replace("kappa", "other")
    docs = spark.createDataFrame([(1, f"x y {item} z"), (2, f"q {near} w"), (3, "alpha nu beta mu kappa iota")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id int, text string")
    got = {r.doc_id: (r.n_hit, r.n_near) for r in decontam.contamination(docs, bench).collect()}
    assert got == {1: (13, 0), 2: (0, 1), 3: (0, 0)}


def test_no_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert decontam.contamination(no_docs, bench).count() == 0
    none = decontam.contamination(odd_docs, bench.limit(0))
    assert none.count() == odd_docs.count() and none.where("n_hit > 0 OR contaminated").count() == 0


def plain_near(docs, items, width=13, slop=2):
    """Per document the number of items with no exact window and one of at least 80 % of the terms near their places, at any start."""
    out = {}
    for doc, text in docs:
        w, near, whole = plain_words(text), set(), set()
        for item, t in items:
            v = plain_words(t)
            for win in {tuple(v[i : i + width]) for i in range(max(1, len(v) - width + 1))}:
                for s in range(-width - slop, len(w) + slop):
                    if s >= 0 and tuple(w[s : s + len(win)]) == win:
                        whole.add(item)
                    if 5 * sum(x in w[max(0, s + i - slop) : max(0, s + i + slop + 1)] for i, x in enumerate(win)) >= 4 * len(win):
                        near.add(item)
        out[doc] = len(near - whole)
    return out


def test_proximity_against_brute_force(spark):
    rng = random.Random(11)
    items = [(k, " ".join(f"r{k}x{i}" if i % 3 else f"c{rng.randrange(30)}" for i in range(n))) for k, n in enumerate((6, 10, 13, 13, 16))]
    docs = []
    for d in range(60):
        w = items[d % 5][1].split()
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(w))
            w[at : at + 1] = [["absent"], [w[at], "more"], []][rng.randrange(3)]
        docs.append((d, " ".join([f"c{rng.randrange(30)}" for _ in range(rng.randrange(6))] + w + ["c1"] * rng.randrange(3))))
    docs = docs[5:]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    want = plain_near(docs, items)
    assert sum(want.values()) > 10
    assert {r.doc_id: r.n_near for r in decontam.contamination(frame, bench).collect()} == want


def test_proximity_without_the_rarest_word(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = spark.createDataFrame([(1, item.replace("gamma", "other")), (2, "alpha beta delta gamma gamma")], "doc_id long, text string")
    for word in ("gamma", "nowhere"):
        bench = spark.createDataFrame([(7, item.replace("gamma", word))], "item_id int, text string")
        assert {r.doc_id: r.n_near for r in decontam.contamination(docs, bench).collect()} == {1: 1, 2: 0}
