"""License scans by patience alignment of texts with license templates.

A template's words and a window of the text are aligned like a patience diff:
words that occur once in both are anchors, the longest increasing subsequence of
their places is kept, and the gaps between kept anchors are aligned the same way;
gaps without an anchor are matched from both ends while words are equal. The
coverage is the share of the template's words that are aligned. A finding has a
coverage of ``COVERAGE`` or more, and the aligned words of the text may hold at
most ``SLACK`` foreign words per template word.

Windows come from a template's key words: its rarest one (fixed below) and the
longest of the others that it holds once, one more of them than words may be
missing. So an alignment of ``COVERAGE`` holds a key word, whichever words are
gone. A window lies around every place of a key word, as far as the template can
reach to either side, and is dropped when it holds too few of the template's
words. Texts of any length are scanned whole, and the alignment's work follows
the number of key words, not the text. Repeats of a notice are cut at places of
the same key word; where the same word stands in a notice twice, the window is
aligned uncut, too. Findings that overlap are one, the best covered.

Defined cases: null and empty texts and texts without a key word have no
findings, hence no rows; repeated notices are counted, and the first of the best
covered ones is reported; rows that repeat a doc_id are reported each; a null
doc_id stays null; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts

COVERAGE = 0.8
SLACK = 1.0
WORD = re.compile(r"[a-z0-9]+(?:[.-][0-9a-z]+)*")

# License notices, as published, with the rarest word of each.
TEMPLATES = {
    "Apache-2.0": ("apache", "Licensed under the Apache License, Version 2.0."),
    "GPL-3.0": ("gnu", "This work is licensed under the GNU General Public License, version 3."),
    "MIT": ("mit", "Released under the MIT License."),
    "CC-BY-NC-4.0": ("by-nc", "Licensed under CC BY-NC 4.0."),
    "MIT-text": ("sublicense", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software."""),
    "Apache-2.0-header": ("www.apache.org", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
        by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    "BSD-3-Clause": ("endorse", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the
        copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission."""),
    "ISC": ("fee", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    "GPL-header": ("redistribute", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    "MPL-2.0": ("mozilla", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def align(a: list[str], b: list[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(a0 + i, b0 + i) for i in range(head)]
    end = [(a0 + len(a) - i, b0 + len(b) - i) for i in range(tail, 0, -1)]
    a, b = a[head: len(a) - tail], b[head: len(b) - tail]
    a0, b0 = a0 + head, b0 + head
    if not a or not b:
        return out + end
    ca, cb = Counter(a), Counter(b)
    where = {w: j for j, w in enumerate(b) if cb[w] == 1 and ca.get(w) == 1}
    anchors = [(i, where[w]) for i, w in enumerate(a) if w in where]
    tops: list[int] = []  # least last place in b of an increasing run of each length
    ends: list[int] = []
    link: list[int] = []
    for n, (_, j) in enumerate(anchors):
        k = bisect_left(tops, j)
        link.append(ends[k - 1] if k else -1)
        tops[k:k + 1], ends[k:k + 1] = [j], [n]
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(anchors[n])
        n = link[n]
    if not chain:
        return out + end
    i0 = j0 = 0
    for i, j in [*reversed(chain), (len(a), len(b))]:
        out += align(a[i0:i], b[j0:j], a0 + i0, b0 + j0)
        if i < len(a):
            out.append((a0 + i, b0 + j))
        i0, j0 = i + 1, j + 1
    return out + end


def least(n: int) -> int:
    """Aligned words that a template of n words needs."""
    return next(k for k in range(n + 1) if k / n >= COVERAGE)


def key_words(rarest: str, template: list[str]) -> dict[str, int]:
    """Place in the template of each key word."""
    times = Counter(template)
    once = sorted((w for w in times if times[w] == 1), key=lambda w: (w != rarest, -len(w), w))
    wanted = len(template) - least(len(template)) + 1
    assert len(once) >= wanted and once[0] == rarest
    return {w: template.index(w) for w in once[:wanted]}


_PLANS = [(name, t, Counter(t), least(len(t)), key_words(key, t)) for name, key, t in ((n, k, words(x)) for n, (k, x) in TEMPLATES.items())]


def _held(times: Counter, there: set[str]) -> int:
    return sum(n for w, n in times.items() if w in there)


def _choose(cut: list[tuple[float, int, int]], whole: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Findings (coverage, first, end) without overlap, by place: the best of ``cut``, then what ``whole`` adds to or betters of one."""
    out: list[tuple[int, int, float]] = []
    for better, found in ((False, cut), (True, whole)):
        for coverage, first, end in sorted(set(found), key=lambda f: (-f[0], f[1], f[2])):
            at = bisect_left(out, (first,))
            at -= at > 0 and out[at - 1][1] > first
            to = at
            while to < len(out) and out[to][0] < end:
                to += 1
            if to == at or better and to == at + 1 and out[at][2] < coverage:
                out[at:to] = [(first, end, coverage)]
    return [(c, a, b) for a, b, c in out]


def scan(text: str | None) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, first word, end word, findings) of a text, words counted from 0."""
    tokens = words(text or "")
    there = set(tokens)
    plans = [p for p in _PLANS if _held(p[2], there) >= p[3]]
    if not plans:
        return []
    places: dict[str, list[int]] = {w: [] for p in plans for w in p[4]}
    for i, w in enumerate(tokens):
        if w in places:
            places[w].append(i)
    out = []
    for name, template, times, needed, keys in plans:
        reach = round(len(template) * (1 + SLACK))
        cut, whole = [], []
        for key, key_at in keys.items():
            at = places[key]
            for n, p in enumerate(at):
                a, b = max(0, p - reach), min(len(tokens), p + reach + 1)
                if _held(times, set(tokens[a:b])) < needed:
                    continue
                lo = max(a, at[n - 1] + 1 if n else a)
                hi = min(b, at[n + 1] if n + 1 < len(at) else b)
                for found, x, y in [(cut, lo, hi), (whole, a, b)][: 1 + ((lo, hi) != (a, b))]:
                    back = align(template[:key_at][::-1], tokens[x:p][::-1])
                    ahead = align(template[key_at + 1:], tokens[p + 1: y])
                    pairs = [p - 1 - j for _, j in back] + [p] + [p + 1 + j for _, j in ahead]
                    coverage, first, end = len(pairs) / len(template), min(pairs), max(pairs) + 1
                    if coverage >= COVERAGE and end - first - len(pairs) <= SLACK * len(template):
                        found.append((coverage, first, end))
        found = _choose(cut, whole)
        if found:
            best = max(found, key=lambda f: (f[0], -f[1]))
            out.append((name, best[0], best[1], best[2], len(found)))
    return out


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, license, coverage, first_word, end_word, findings), a row per document and license found."""

    def run(texts: list) -> tuple[list[int], list]:
        found = [(i, *f) for i, t in enumerate(texts) if t is not None for f in scan(t)]
        rows, *columns = map(list, zip(*found)) if found else [[] for _ in range(6)]
        return rows, columns

    return over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", ["doc_id"], lambda: run,
                      "license string, coverage double, first_word long, end_word long, findings long")
