"""Language identification by word-first backoff.

The model has the log frequency, per language, of the words of a sample, and of the character n-grams of
those words in word bounds. A known word counts with its own log frequencies. An unknown one counts with
the mean over its longest n-grams that are known: five characters, else four, and so down to one. A
text's language is the one with the greatest sum over all its words; its score is that language's share
after a softmax of the sums.

Words are runs of letters (Unicode category L) with the marks (category M) after them, in lower case.

The model is learned on a bounded sample of labelled rows, at most about `sample` of each language,
chosen by a hash of doc_id; all words of that sample and all their n-grams are in it, so its size is
bounded by the sample and it may be broadcast. Spark counts the words first; then each distinct word is
spread into n-grams once. Every text is read whole.

Defined cases: a text that is null or has no letter is `und` with score 0; rows without a language or a
text teach nothing; ties between languages go to the first in order of name; repeated rows are rows of
their own; a null doc_id is a row like any other; a very long text is counted whole, word by word; with
nothing to learn from every text is `und`; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, release

LONGEST = 5
UNKNOWN = "und"


def _class(*kinds: str) -> str:
    """Character ranges of Unicode categories (by their beginnings), as the inside of a regular expression's class."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)).startswith(kinds)]
    ends = [i for i in range(len(codes)) if i + 1 == len(codes) or codes[i + 1] != codes[i] + 1]
    starts = [0, *(i + 1 for i in ends[:-1])]
    return "".join(f"{chr(codes[a])}-{chr(codes[b])}" for a, b in zip(starts, ends, strict=True))


LETTERS = re.compile(f"[{_class('L')}][{_class('L', 'M')}]*")
#: Where a text has none of the marks and odd numbers in _ODD, _PLAIN finds the same words, and faster.
_ODD = frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)).startswith(("M", "Nl", "No")))
_PLAIN = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    text = text.lower()
    return (_PLAIN if text.isascii() or _ODD.isdisjoint({*text}) else LETTERS).findall(text)


def grams(word: str, n: int) -> list[str]:
    held = f"\x02{word}\x03"
    return [held[i : i + n] for i in range(len(held) - n + 1)]


@dataclass
class Model:
    """tables[0]: words, tables[n]: n-grams, each to a row of logs (one column for each of languages)."""

    languages: list[str]
    tables: list[dict[str, int]]
    logs: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            known = [i for g in grams(word, n) if (i := self.tables[n].get(g)) is not None]
            if known:
                return self.logs[known].mean(axis=0)
        return np.zeros(len(self.languages))

    def predict(self, text: str | None, cache: dict[str, np.ndarray]) -> tuple[str, float]:
        found = words(text) if text else []
        if not found or not self.languages:
            return UNKNOWN, 0.0
        find = self.tables[0].get
        rows = np.array([find(w, -1) for w in found])
        total = self.logs[rows[rows >= 0]].sum(axis=0)
        for i in np.flatnonzero(rows < 0).tolist():
            word = found[i]
            v = cache.get(word)
            if v is None:
                if len(cache) > 100_000:
                    cache.clear()
                v = cache[word] = self.unseen(word)
            total += v
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def learn(docs: DataFrame, teaches: Column, sample: int = 1000) -> Model:
    """A model of the rows of docs (doc_id, text, lang) for which `teaches` holds."""
    known = docs.where(teaches & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], [{} for _ in range(LONGEST + 1)], np.zeros((0, 0)))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])[F.col("lang")]
    chosen = known.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20)) < share * (1 << 20))

    def counted(held: Counter) -> pa.RecordBatch:
        lang, kind, gram = zip(*held, strict=True) if held else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.int32()), pa.array(gram, pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "kind", "gram", "k"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, k in Counter(words(text.as_py())).items():
                    held[lang, 0, word] += k
            if len(held) > 300_000:
                yield counted(held)
                held = Counter()
        yield counted(held)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for lang, word, k in zip(*(batch.column(c).to_pylist() for c in ("lang", "gram", "k")), strict=True):
                for n in range(1, LONGEST + 1):
                    for g in grams(word, n):
                        held[lang, n, g] += k
            if len(held) > 300_000:
                yield counted(held)
                held = Counter()
        yield counted(held)

    schema, by = "lang string, kind int, gram string, k long", ("lang", "kind", "gram")
    each = cut(chosen.select("lang", "text").mapInArrow(tally, schema).groupBy(*by).agg(F.sum("k").alias("k")))
    parts = each.select("lang", "kind", "gram", "k").mapInArrow(spread, schema).groupBy(*by).agg(F.sum("k").alias("k"))
    rows = each.unionByName(parts).toArrow()  # of a bounded sample
    release(each)

    languages = sorted(sizes)
    tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    columns = [rows.column(c).to_pylist() for c in ("lang", "kind", "gram")]
    at, kinds = [], []
    for _, kind, gram in zip(*columns, strict=True):
        i = tables[kind].setdefault(gram, len(kinds))
        if i == len(kinds):
            kinds.append(kind)
        at.append(i)
    counts = np.zeros((len(kinds), len(languages)))
    column = {lang: j for j, lang in enumerate(languages)}
    counts[at, [column[lang] for lang in columns[0]]] = rows.column("k").to_numpy()
    logs, kind_of = np.zeros_like(counts), np.array(kinds, int)
    for kind in range(LONGEST + 1):
        own = counts[kind_of == kind] + 0.5
        logs[kind_of == kind] = np.log(own / own.sum(axis=0))
    return Model(languages, tables, logs)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables, model.logs))  # plain values: executors needn't know the class
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = Model(*held.value), {}
        for batch in batches:
            found = [own.predict(t.as_py(), cache) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
