import hashlib
from collections import Counter

import numpy as np
import pytest

from lodeweave.llm import suffix_dedup
from tests.conftest import DATA


def plain(docs, length):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()), key=str)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], 400)
    assert sum(w[2] for w in want) > 0
    assert rows_of(suffix_dedup.remove_repeats(docs)) == want


@pytest.mark.parametrize("length", [32, 60])
def test_overlaps_edges_and_periods(spark, length):
    rng = np.random.default_rng(length)
    word = lambda n: "".join(rng.choice(list("abcdé"), n))
    shared = [word(n) for n in (length - 1, length, length + 1, 3 * length, 200)]
    texts = [word(int(rng.integers(0, 90))) + s + word(int(rng.integers(0, 90))) for s in shared for _ in range(4)]
    texts += [shared[3][5 : 5 + length + k] + word(30) for k in range(-1, 9)]
    texts += ["a" * 300, "ab" * 200, "a" * length, word(50) + "xyz" * 60, shared[3], shared[3], None, "", "é" * 100]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(suffix_dedup.remove_repeats(frame, length)) == plain(docs, length)


def test_odd_rows(odd_docs):
    want = plain([(r.doc_id, r.text) for r in odd_docs.collect()], 400)
    got = suffix_dedup.remove_repeats(odd_docs, keep_bytes=True)
    assert rows_of(got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s["to"] - s["from"] for s in r.spans) == r.n_removed for r in got.collect())


def test_no_rows(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
