"""License scans: patience alignment of texts with license templates.

Words unique to both a stretch of text and a template are anchors; the longest increasing subsequence of their
places is kept, and the gaps between anchors are aligned in the same way. A template is found where the aligned
words cover `COVERAGE` of it or more. Templates are whole license texts, and the short notices that refer to them.

Texts are scanned whole. A stretch with that coverage holds so many of the template's words, each as often as it is
aligned; a text or a window that holds fewer is passed over, which most texts are at once. Windows begin at the
template's words and are wide enough that every stretch lies in one; all others are aligned.

Cases. Null, empty and blank texts have no licenses; the same notice twice is found twice. Spans of one template do not
overlap; where finds of several templates share more than half of the shorter one's words, the one with more aligned words
stays (then the greater coverage, then the name), so that one license is told from another that it holds in part. Very
long texts are scanned like others. Equal rows get equal finds, an empty table gives an empty result; other columns stay,
whatever their names, but for the one that is added.
"""

from __future__ import annotations

import math
import pkgutil
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted

COVERAGE = 0.8
#: How much longer than the template a stretch of text may be.
SLACK = 0.25
TOKEN = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

#: Notices of public licenses.
NOTICES = {
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "MIT (notice)": "Released under the MIT License.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0 (notice)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "GPL-2.0-or-later (notice)": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-or-later (notice)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "Apache-2.0 (file notice)": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
}
#: Public licenses whose whole texts lie beside this module.
WHOLE = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "ISC", "MIT", "MPL-2.0", "Unlicense", "Zlib")


@lru_cache(maxsize=1)
def templates() -> dict[str, str]:
    """Name -> text of all templates."""
    return NOTICES | {name: pkgutil.get_data(__package__, f"licenses/{name}.txt").decode() for name in WHOLE}


def tokens(text: str) -> list[str]:
    return [x.lower() for x in TOKEN.findall(text)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (i, j), ordered by i, whose j increase: piles of patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back[n] = ends[pile - 1] if pile else -1
        tops[pile:pile + 1], ends[pile:pile + 1] = [j], [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, increasing in both."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            found.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        ca, cb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        where = {w: j for j, w in enumerate(b[blo:bhi], blo) if cb[w] == 1}
        anchors = _increasing([(i, where[w]) for i, w in enumerate(a[alo:ahi], alo) if ca[w] == 1 and w in where])
        found += anchors
        edges = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
        if anchors:
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


@lru_cache(maxsize=8)
def _prepared(known: tuple[tuple[str, str], ...]) -> list[tuple[str, list[str], Counter]]:
    """Name, words and how often each occurs, of each template."""
    return [(name, words := tokens(text), Counter(words)) for name, text in known]


def _densest(pairs: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """The most pairs whose places in the text lie within a width."""
    best, lo = (0, 0), 0
    for hi in range(len(pairs)):
        while pairs[hi][0] - pairs[lo][0] >= width:
            lo += 1
        best = max(best, (hi + 1 - lo, -lo))
    return pairs[-best[1] : best[0] - best[1]]


def _stretches(words: list[str], template: list[str], counts: Counter, coverage: float) -> Iterator[tuple[int, int, int]]:
    """First and last word, and aligned words, of the stretches that a template covers."""
    n = len(template)
    need, slack = max(1, math.ceil(coverage * n - 1e-9)), max(2, int(SLACK * n))
    hits = [i for i, w in enumerate(words) if w in counts]
    a = done = 0
    tried = -1
    while a + need <= len(hits):
        lo = max(done, hits[a] // slack * slack)
        hi = lo + n + 2 * slack
        if lo == tried or hits[a + need - 1] >= hi:
            a += 1
            continue
        tried = lo
        held = Counter(words[i] for i in hits[a : bisect_left(hits, hi)])
        pairs = _densest(align(words[lo:hi], template), n + slack) if sum((held & counts).values()) >= need else []
        if len(pairs) >= need:
            # the window may end inside the stretch: look again where most words say that the template begins
            start = lo + sorted(i - j for i, j in pairs)[len(pairs) // 2]
            at = max(done, start - slack)
            again = _densest(align(words[at : start + n + slack], template), n + slack)
            if len(again) >= len(pairs):
                lo, pairs = at, again
            first, last = lo + pairs[0][0], lo + pairs[-1][0]
            yield first, last, len(pairs)
            done, tried = last + 1, -1
            a = bisect_left(hits, done)
        else:
            a += 1


def find(text: str, known: tuple[tuple[str, str], ...], coverage: float = COVERAGE) -> list[dict]:
    """Every stretch of the text that a template covers, with its span in code points."""
    words = tokens(text)
    there = Counter(words)
    found = []
    for name, template, counts in _prepared(known):
        need = coverage * len(template) - 1e-9
        if len(words) < need or sum(min(there[w], k) for w, k in counts.items() if w in there) < need:
            continue
        found += [(-k, -k / len(template), name, first, last) for first, last, k in _stretches(words, template, counts, coverage)]
    if not found:
        return []
    spans, out = [m.span() for m in TOKEN.finditer(text)], []
    for _, covered, name, first, last in sorted(found):
        if all(2 * (min(last, x[1]) - max(first, x[0]) + 1) <= min(last - first, x[1] - x[0]) + 1 for x in out):
            out.append((first, last, {"license": name, "coverage": -covered, "start": spans[first][0], "end": spans[last][1]}))
    return [x[2] for x in sorted(out, key=lambda x: (x[0], x[2]["license"]))]


FOUND = "array<struct<license:string,coverage:double,start:int,end:int>>"
_TYPE = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, text: str = "text", into: str = "licenses", known: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """docs with the licenses found in each whole text."""
    fixed = tuple((known or templates()).items())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([find(x.as_py(), fixed, coverage) if x.is_valid else [] for x in batch], _TYPE)

    return docs.withColumn(into, F.arrow_udf(run, FOUND)(quoted([text])[0].cast("string")))
