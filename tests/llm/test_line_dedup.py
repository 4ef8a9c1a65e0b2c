import hashlib
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodeweave.llm import alignment, line_dedup
from tests.conftest import DATA


def key_of(text):
    return hashlib.sha256((text or "").encode()).digest()[:16]


def plain(docs, min_words=line_dedup.MIN_WORDS):
    """Every document against every earlier text: the lines of all runs that both hold and that weigh enough go."""
    order = lambda d: (d[0] is None, d[0] or 0, key_of(d[1]))
    heavy = lambda x: max(len(x.split()), len(x) // 12)
    first = {}
    for d in docs:
        if key_of(d[1]) not in first or order(d) < order(first[key_of(d[1])]):
            first[key_of(d[1])] = d
    lines = {k: [x.strip(b" \t\n\r\x0b\x0c") for x in (d[1] or "").encode().split(b"\n")] for k, d in first.items()}
    holders = {}
    for k, ls in lines.items():
        for x in {*ls}:
            holders.setdefault(x, set()).add(k)
    out = []
    for doc, text in docs:
        k = key_of(text)
        raw, gone = ([] if text is None else text.split("\n")), set()
        if order((doc, text)) != order(first[k]):
            if sum(map(heavy, lines[k])) >= min_words:
                gone = set(range(len(raw)))
        else:
            a = lines[k]
            for e in {e for x in a if x for e in holders[x]}:
                if order(first[e]) < order(first[k]):
                    b = lines[e]
                    where = {}
                    for j, y in enumerate(b):
                        where.setdefault(y, []).append(j)
                    for i, x in enumerate(a):
                        for j in where.get(x, ()):
                            if not i or not j or a[i - 1] != b[j - 1]:  # a run's beginning
                                n = 0
                                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                                    n += 1
                                if sum(map(heavy, a[i : i + n])) >= min_words:
                                    gone |= set(range(i, i + n))
        kept = "\n".join(x for i, x in enumerate(raw) if i not in gone).encode()
        out.append((doc, len(raw), len(gone), len(kept), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(w[2] for w in want) > 50
    assert rows_of(line_dedup.digest(docs)) == want


@given(st.lists(st.integers(0, 9), max_size=25), st.lists(st.integers(0, 9), max_size=25))
def test_alignment(a, b):
    pairs = alignment.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(alignment.patience(a, a)) == len(a)
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        best = max((sum(m.size for m in SequenceMatcher(None, a, b, False).get_matching_blocks()), 0))
        assert len(pairs) >= best - 25 and bool(pairs) == bool(set(a) & set(b))


@given(st.lists(st.integers(0, 30), max_size=30))
def test_increasing_is_longest(places):
    got = [places[i] for i in alignment.increasing(places)]
    assert all(x < y for x, y in zip(got, got[1:]))
    best = [0] * len(places)
    for i, p in enumerate(places):
        best[i] = 1 + max([best[j] for j in range(i) if places[j] < p], default=0)
    assert len(got) == max(best, default=0)


def test_odd_rows(odd_docs, no_docs):
    assert rows_of(line_dedup.digest(odd_docs)) == plain([(r.doc_id, r.text) for r in odd_docs.collect()])
    out = line_dedup.without_shared_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    assert line_dedup.digest(no_docs).count() == 0


def test_short_lines_and_later_holders(spark):
    long, block = "one two three four five six seven eight nine", "a b c d e\nf g h i j\nk l m n o"
    texts = ["nothing here", f"x\n{long}\ny\n{block}", f"{block}\nz\n{long}", f"u\n{block}\nv", f"{block}"]
    docs = list(enumerate(texts, 1))
    rows = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {1: (1, 0), 2: (6, 0), 3: (5, 4), 4: (5, 3), 5: (3, 3)}


@pytest.mark.parametrize("seed", range(4))
def test_crossing_and_repeated_blocks(spark, seed):
    rng = random.Random(seed)
    words = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(words) for _ in range(rng.randrange(14)))) for i in range(60)]
    docs += [(None, docs[3][1]), (70, "短い行\n" * 3 + "これはとても長い行なので、空白がなくても八語より重いと数えられます。この行はもっと続きます。"), (71, "これはとても長い行なので、空白がなくても八語より重いと数えられます。この行はもっと続きます。\nx")]
    assert rows_of(line_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string"))) == plain(docs)


def test_a_long_text_of_empty_lines(spark):
    docs = [(1, "\n" * 100_000 + "a b c d e f g h"), (2, "\n" * 50_000 + "a b c d e f g h")]
    rows = {r.doc_id: r.n_removed for r in line_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {1: 0, 2: 50_001}
