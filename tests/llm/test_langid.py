import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodeweave.llm import langid, queries
from lodeweave.llm.common import fold
from tests.conftest import DATA


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = queries.op3_language_id(spark, f"{DATA}/sf0.01")
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert got.count() == docs.count()


def test_words_first_then_shorter_grams():
    tables = [{"the": 0}, {"q": 1}, {"qu": 2}, {}, {}, {}]
    import numpy as np

    model = langid.Model(["a", "b"], tables, np.array([[-1.0, -2], [-5, -3], [-2, -6]]))
    assert model.unseen("quz").tolist() == [-2, -6]
    assert model.unseen("q").tolist() == [-5, -3]
    assert model.unseen("x").tolist() == [0, 0]
    assert model.predict("The THE", {})[0] == "a"
    assert model.predict("12 -", {}) == ("und", 0.0) and model.predict(None, {}) == ("und", 0.0)


def test_odd_rows(spark, odd_docs, no_docs):
    model = langid.learn(odd_docs, fold(F.col("doc_id"), 4) != 2)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd_docs, model).collect()}
    assert (0, "und") in got and (2, "und") in got and langid.identify(odd_docs, model).count() == odd_docs.count()
    assert langid.identify(no_docs, model).count() == 0
    nothing = langid.learn(no_docs, F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd_docs, nothing).collect()} == {"und"}


@pytest.mark.parametrize(("text", "want"), [("½ ² 7 ① Ⅷ ٣", []), ("हिन्दी भाषा", ["हिन्दी", "भाषा"]), ("don't x2y naïve ª\u0301", ["don", "t", "x", "y", "naïve", "ª\u0301"]), ("\u0301a", ["a"])])
def test_words_are_letters_and_their_marks(text, want):
    assert langid.words(text) == want


def test_only_numbers_and_marks_are_undetermined(spark):
    docs = spark.createDataFrame([(0, "ein Wort", "de"), (1, "½ ² 7", None), (2, "Ⅷ ①", None), (3, "\u0301", None), (4, "Wort", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.learn(docs, F.lit(True))).collect()}
    assert got == {0: ("de", 1.0), 1: ("und", 0.0), 2: ("und", 0.0), 3: ("und", 0.0), 4: ("de", 1.0)}


def plain_words(text):
    out, now = [], ""
    for c in text.lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or kind == "M" and now:
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def plain_predictions(docs, taught):
    """Counts in dictionaries, and every word of every text looked up anew."""
    counts = defaultdict(lambda: defaultdict(Counter))  # by length of n-gram (0: words), then text, then language
    for text, lang in taught:
        for w in plain_words(text):
            counts[0][w][lang] += 1
            for n in range(1, 6):
                for i in range(len(w) + 3 - n):
                    counts[n][f"\2{w}\3"[i : i + n]][lang] += 1
    languages = sorted({lang for _, lang in taught})
    totals = {n: {lang: sum(c[lang] + 0.5 for c in t.values()) for lang in languages} for n, t in counts.items()}
    logs = lambda n, x: [math.log((counts[n][x][lang] + 0.5) / totals[n][lang]) for lang in languages]
    out = {}
    for doc, text in docs:
        total, found = [0.0] * len(languages), plain_words(text or "")
        for w in found:
            if w in counts[0]:
                own = [logs(0, w)]
            else:
                for n in range(5, 0, -1):
                    own = [logs(n, g) for i in range(len(w) + 3 - n) if (g := f"\2{w}\3"[i : i + n]) in counts[n]]
                    if own:
                        break
            total = [t + sum(o[k] for o in own) / max(1, len(own)) for k, t in enumerate(total)]
        best = max(total)
        out[doc] = (languages[total.index(best)], 1 / sum(math.exp(t - best) for t in total)) if found else ("und", 0.0)
    return out


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = docs.collect()
    taught = [(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.text is not None and r.lang is not None]
    want = plain_predictions([(r.doc_id, r.text) for r in rows], taught)
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op3_language_id(spark, f"{DATA}/sf0.001").collect()}
    assert {d: p for d, (p, _) in got.items()} == {d: p for d, (p, _) in want.items()}
    assert all(abs(got[d][1] - s) < 1e-6 for d, (_, s) in want.items())
