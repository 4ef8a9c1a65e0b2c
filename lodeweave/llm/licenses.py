"""License scans by patience alignment of whole texts with license templates.

Words are those of benchmark decontamination (ASCII letters and digits in lower case, and all beyond
ASCII). A text is taken in stretches of 1.5 template lengths, one for each half length, so that every
copy of a template lies whole in some stretch, wherever it stands and however often. A stretch is aligned
with the template: words that are unique in both anchor it, the longest increasing subsequence of the
anchors stays, and the gaps are aligned in the same way. The coverage is the share of the template's
words that are aligned. A license is found if some stretch covers `min_coverage` of it, has all its
required words in place (names and versions, marked by * in the templates), and has no word between the
aligned ones or just before them that makes another license of it (VETO, where the template lacks the word).

Two bounds save most alignments and lose none: a text must have the required words, and as many distinct
words of the template as the needed coverage takes at the least; a stretch as many words counted with repeats.

The templates are a fixed list, so they may be broadcast; a text is read whole, on its own. They are whole
texts of short licenses and the notices that stand for long ones; the long ones' full texts are not among
them.

Defined cases: null and empty texts have no license (null, coverage 0, no span); of several licenses the
one with the greatest coverage is named, then the longest, then the first by name; a very long text is
scanned whole, stretch by stretch; a null doc_id stays null; repeated rows give a row each; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.alignment import patience
from lodeweave.llm.common import text_bytes
from lodeweave.llm.decontam import words

_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the *GNU {name}*General *Public License as published by the Free Software Foundation, either version *{version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details."

# Public license texts and notices. A * marks a required word.
TEMPLATES = {
    "Apache-2.0": "Licensed under the *Apache License, Version *2.*0.",
    "Apache-2.0-header": 'Licensed under the *Apache License, Version *2.*0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": f"{_BSD} {_WARRANTY}",
    "BSD-3-Clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to *endorse or *promote products derived from this software without specific prior written permission. {_WARRANTY}",
    "BSL-1.0": "*Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under *CC0.",
    "GPL-2.0": "This work is licensed under the *GNU *General *Public License, version *2.",
    "GPL-3.0": "This work is licensed under the *GNU *General *Public License, version *3.",
    "GPL-2.0-header": _GNU.format(name="", version="2"),
    "GPL-3.0-header": _GNU.format(name="", version="3"),
    "LGPL-2.1-header": _GNU.format(name="*Lesser ", version="2.*1"),
    "LGPL-3.0-header": _GNU.format(name="*Lesser ", version="3"),
    "AGPL-3.0-header": _GNU.format(name="*Affero ", version="3"),
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without *fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": "Released under the *MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, *sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the *Mozilla *Public License, v. *2.*0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the *public *domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "reserved": "*All *rights *reserved.",
}
for _terms in ("", "SA", "NC", "ND", "NC-SA", "NC-ND"):
    _long = "-".join({"SA": "*ShareAlike", "NC": "*NonCommercial", "ND": "*NoDerivatives"}[t] for t in _terms.split("-") if t)
    _id = f"CC-BY{'-' * bool(_terms)}{_terms}-4.0"
    TEMPLATES[_id] = f"Licensed under *CC *BY{''.join(f'-*{t}' for t in _terms.split('-') if t)} *4.*0."
    TEMPLATES[f"{_id}-notice"] = f"This work is licensed under a *Creative *Commons *Attribution{'-' * bool(_long)}{_long} *4.*0 International License."
#: Words that make another license of a text where they stand between a template's words and the template lacks them.
VETO = frozenset(x.encode() for x in ("affero", "domain", "endorse", "lesser", "library", "nc", "nd", "noderivatives", "noderivs", "noncommercial", "not", "promote", "sa", "sharealike"))
MIN_COVERAGE = 0.75


@dataclass
class Template:
    name: str
    words: list[bytes]
    counts: Counter
    required: frozenset[int]  # places
    names: frozenset[bytes]  # the required words
    veto: frozenset[bytes]
    need: int  # aligned words
    distinct: int  # distinct words that so many need at the least

    @classmethod
    def of(cls, name: str, text: str, min_coverage: float) -> Template:
        w, required = [], set()
        for k, part in enumerate(text.split("*")):
            if k:
                required.add(len(w))
            w += words(part.encode())
        counts = Counter(w)
        need = max(1, ceil(len(w) * min_coverage - 1e-9))
        sums = np.cumsum(sorted(counts.values(), reverse=True))
        return cls(name, w, counts, frozenset(required), frozenset(w[i] for i in required), VETO - counts.keys(), need, int(np.searchsorted(sums, need)) + 1)

    def accepts(self, text: list[bytes], pairs: list[tuple[int, int]]) -> bool:
        """Whether an alignment with text has the required words, and no word that vetoes between the aligned ones or just before."""
        aligned = {i for i, _ in pairs}
        return self.required <= {j for _, j in pairs} and not any(text[i] in self.veto and i not in aligned for i in range(max(0, pairs[0][0] - 1), pairs[-1][0] + 1))


def align(template: Template, text: list[bytes]) -> tuple[int, int, int]:
    """The best stretch's number of aligned words, and the first and last of them in the text; (0, -1, -1) if none is accepted."""
    n = len(template.words)
    own = np.fromiter((w in template.counts for w in text), bool, len(text))
    upto = np.concatenate([[0], np.cumsum(own)])
    step, span = max(1, n // 2), n + (n + 1) // 2
    starts = np.arange(0, max(1, len(text) - span + step), step)
    ends = np.minimum(starts + span, len(text))
    best = (0, -1, -1)
    for lo, hi in zip(*(x[upto[ends] - upto[starts] >= template.need].tolist() for x in (starts, ends)), strict=True):
        part = text[lo:hi]
        if sum((Counter(part) & template.counts).values()) < max(template.need, best[0] + 1):
            continue
        pairs = [(lo + i, j) for i, j in patience(part, template.words)]
        if len(pairs) >= max(template.need, best[0] + 1) and template.accepts(text, pairs):
            best = (len(pairs), pairs[0][0], pairs[-1][0])
    return best


def scan_text(templates: list[Template], data: bytes) -> list[tuple[float, int, str, int, int]]:
    """(coverage, template length, name, first word, last word) of each license in a text, the best first."""
    text = words(data)
    there = {*text}
    found = []
    for t in templates:
        if there >= t.names and len(there & t.counts.keys()) >= t.distinct:
            k, lo, hi = align(t, text)
            if k:
                found.append((k / len(t.words), len(t.words), t.name, lo, hi))
    return sorted(found, key=lambda f: (-f[0], -f[1], f[2]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Per document: doc_id, license, coverage, first_word, last_word, licenses (all found, comma-joined, by name)."""
    known = [Template.of(name, text, min_coverage) for name, text in sorted((templates or TEMPLATES).items())]
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "license", "coverage", "first_word", "last_word", "licenses"]
    types = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).cast(pa.binary()):
                found = scan_text(known, t.as_py())
                cover, _, name, lo, hi = found[0] if found else (0.0, 0, None, None, None)
                rows.append((name, cover, lo, hi, ",".join(sorted(f[2] for f in found))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 5, types, strict=True))], names)

    return docs.select("doc_id", text_bytes(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, license string, coverage double, first_word int, last_word int, licenses string")
