import pytest

from lodeweave.llm import licenses
from lodeweave.llm.alignment import patience
from lodeweave.llm.decontam import words
from tests.conftest import DATA


def plain(text, min_coverage=licenses.MIN_COVERAGE):
    """Every stretch against every template, without the bounds."""
    w, found = words((text or "").encode()), []
    for name, marked in licenses.TEMPLATES.items():
        t = words(marked.replace("*", "").encode())
        names = {words(x.encode())[0] for x in marked.split("*")[1:]}
        n, best = len(t), 0
        span, step = n + (n + 1) // 2, max(1, n // 2)
        for i in range(0, max(1, len(w) - span + step), step):
            pairs = patience(w[i : i + span], t)
            held, inside = [t[j] for _, j in pairs], {a for a, _ in pairs}
            strange = [w[i + a] for a in range(max(-i, min(inside, default=0) - 1), max(inside, default=-1) + 1) if a not in inside]
            if names <= {*held} and not {x for x in strange if x in licenses.VETO and x not in t}:
                best = max(best, len(pairs))
        if best / n >= min_coverage:
            found.append((-best / n, -n, name))
    return sorted(found)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert (r.license, r.licenses) == (want[0][2] if want else None, ",".join(sorted(f[2] for f in want)))
        assert abs(r.coverage - (-want[0][0] if want else 0)) < 1e-12
    assert any(r.license for r in rows)


def test_notices_of_a_larger_table_are_found(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    got = {r.doc_id: r.licenses.split(",") for r in licenses.scan(docs).collect()}
    for name in ("MIT", "GPL-3.0", "CC-BY-NC-4.0", "Apache-2.0"):
        held = [r.doc_id for r in docs.where(docs.text.contains(licenses.TEMPLATES[name].replace("*", ""))).select("doc_id").collect()]
        assert held and all(name in got[d] for d in held)


def test_changed_repeated_and_long(spark, odd_docs, no_docs):
    mit = licenses.TEMPLATES["MIT-text"].replace("*", "")
    changed = mit.replace("free of charge", "at no cost").replace("merge, publish,", "publish,")
    texts = [f"x {'y ' * 500}{changed} z", mit + " " + mit, " ".join(mit.split()[:40]), mit.upper(), f"{'lorem ' * 50000}{mit}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(licenses.scan(frame).collect())
    assert [r.license for r in rows] == ["MIT-text", "MIT-text", None, "MIT-text", "MIT-text"]
    assert 0.9 < rows[0].coverage < 1 and rows[1].coverage == 1 and rows[4].first_word == 50000
    assert rows[0].first_word == 501
    odd = licenses.scan(odd_docs)
    assert odd.count() == odd_docs.count() and odd.where("license IS NOT NULL OR coverage > 0").count() == 0
    assert licenses.scan(no_docs).count() == 0


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Released under the BSD License.", None),
        ("released under the new license", None),
        ("Released under the MIT license", "MIT"),
        ("Licensed under the Mozilla Public License, Version 2.0.", None),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"),
        ("This work is licensed under the GNU General Public License, version 3", "GPL-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3", None),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0-notice"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0-notice"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0-notice"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Not all rights are reserved", None),
        (licenses.TEMPLATES["BSD-3-Clause"].replace("*", ""), "BSD-3-Clause"),
        (licenses.TEMPLATES["BSD-2-Clause"], "BSD-2-Clause"),
        (licenses.TEMPLATES["LGPL-2.1-header"].replace("*", ""), "LGPL-2.1-header"),
        (licenses.TEMPLATES["AGPL-3.0-header"].replace("*", ""), "AGPL-3.0-header"),
        (licenses.TEMPLATES["GPL-3.0-header"].replace("*", ""), "GPL-3.0-header"),
        (licenses.TEMPLATES["GPL-2.0-header"].replace("*", ""), "GPL-2.0-header"),
    ],
)
def test_near_misses(text, name):
    known = [licenses.Template.of(n, t, licenses.MIN_COVERAGE) for n, t in licenses.TEMPLATES.items()]
    found = [f[2] for f in licenses.scan_text(known, text.encode())]
    assert found[:1] == ([name] if name else [])
    assert name is None or all(f.split("-")[0] == name.split("-")[0] for f in found) and len({f.removesuffix("-notice").removesuffix("-header") for f in found}) == 1
