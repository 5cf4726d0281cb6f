"""License scan by patience alignment with license texts.

Words that only license texts use mark regions of a text; in each region the
license is aligned: words that occur once in both are anchors, the longest
increasing run of anchors is kept, equal words next to an anchor are added, and
the gaps between anchors are aligned in the same way.  A region that holds
several copies has few words that occur once; there, windows of about the
license's length are aligned as well, one for each place that a word of the
license gives for its start.  Coverage is the share of the license's words that
are aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import words_of

# Wording of well-known licenses and license notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "MIT notice": "Released under the MIT License",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "All rights reserved": "All rights reserved",
}
#: common words, which mark no region
COMMON = frozenset(words_of(
    "a all an and any are as at be but by can do either file following for form free from hope if in included including is it list "
    "may met met not notice of on one or other person see shall source subject terms that the this to use useful will with without work you"))
#: coverage from which a license is reported
COVERAGE = 0.8
FOUND = "array<struct<license:string,coverage:double,aligned:int,start:int,end:int>>"


def _runs(a: list[str], b: list[str], lo: int, hi: int, to: int, end: int, out: list[tuple[int, int]]) -> None:
    """Align a[lo:hi] with b[to:end]; pairs of equal words, in order, go to ``out``."""
    stack = [(lo, hi, to, end)]
    while stack:
        lo, hi, to, end = stack.pop()
        while lo < hi and to < end and a[lo] == b[to]:
            out.append((lo, to))
            lo, to = lo + 1, to + 1
        while lo < hi and to < end and a[hi - 1] == b[end - 1]:
            hi, end = hi - 1, end - 1
            out.append((hi, end))
        if lo >= hi or to >= end:
            continue
        in_a, in_b = Counter(a[lo:hi]), Counter(b[to:end])
        at = {b[j]: j for j in range(to, end) if in_b[b[j]] == 1 and in_a.get(b[j]) == 1}
        pairs = [(i, at[a[i]]) for i in range(lo, hi) if a[i] in at]
        if not pairs:
            continue
        # longest increasing run of the places in b: tops of piles, each with the last of the pile before
        tops, held, before = [], [], [-1] * len(pairs)
        for n, (_, j) in enumerate(pairs):
            p = bisect_left(tops, j)
            before[n] = held[p - 1] if p else -1
            if p == len(tops):
                tops.append(j)
                held.append(n)
            else:
                tops[p], held[p] = j, n
        run, n = [], held[-1]
        while n >= 0:
            run.append(pairs[n])
            n = before[n]
        run.reverse()
        last_a, last_b = lo, to
        for i, j in run:
            out.append((i, j))
            stack.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
        stack.append((last_a, hi, last_b, end))


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in the text, place in the template) of the patience alignment."""
    out: list[tuple[int, int]] = []
    _runs(text, template, 0, len(text), 0, len(template), out)
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = [(name, words, frozenset(words) - COMMON) for name, text in templates.items() if (words := words_of(text))]
        # places of the marks in each license: of those that stand in it once, if there are any
        self.offsets = []
        for _, template, own in self.templates:
            once = {w for w in own if template.count(w) == 1} or own
            self.offsets.append([(w, t) for t, w in enumerate(template) if w in once])
        self.marks = frozenset().union(*(own for _, _, own in self.templates)) if self.templates else frozenset()

    def _windows(self, words: list[str], template: list[str], starts: list[int]):
        """Alignments (first word, pairs) of windows that may reach the coverage: as long as the license, then longer on both sides."""
        own, size = Counter(template), len(template)
        for start in starts:
            for more in sorted({0, size // 4, size // 2}):
                lo = max(0, start - more)
                window = words[lo:max(0, start + size + more)]
                if sum((Counter(window) & own).values()) >= self.coverage * size:
                    pairs = align(window, template)
                    yield lo, pairs
                    if len(pairs) == size:
                        return

    def scan(self, text: str) -> list[dict]:
        """The best alignment of each license that reaches the coverage, over the whole text."""
        words = words_of(text)
        here = self.marks.intersection(words)
        if not here:
            return []
        places = [i for i, w in enumerate(words) if w in here]
        found = []
        for (name, template, own), offsets in zip(self.templates, self.offsets):
            # a license of coverage c has at least the share c of its words, so few of its marks can be missing
            if len(own & here) < len(own) - (1 - self.coverage) * len(template):
                continue
            mine = [i for i in places if words[i] in own]
            count, tried = Counter(template), set()
            best, at = None, 0
            while at < len(mine):
                end = at
                while end + 1 < len(mine) and mine[end + 1] - mine[end] <= len(template) and mine[end + 1] - mine[at] <= 2 * len(template):
                    end += 1
                lo = max(0, mine[at] - len(template))
                region = words[lo:mine[end] + len(template)]
                pairs = align(region, template)
                aligned = [(lo, pairs)]
                held = Counter(words[i] for i in mine[at:end + 1])
                if len(pairs) < len(template) and any(n > count[w] for w, n in held.items()):
                    where = defaultdict(list)
                    for i in mine[at:end + 1]:
                        where[words[i]].append(i)
                    starts = {i - t for w, t in offsets for i in where.get(w, ())} - tried
                    tried |= starts
                    aligned = chain(aligned, self._windows(words, template, sorted(starts)))
                for lo, pairs in aligned:
                    if len(pairs) >= self.coverage * len(template) and (best is None or len(pairs) > best["aligned"]):
                        best = {"license": name, "coverage": len(pairs) / len(template), "aligned": len(pairs),
                                "start": lo + pairs[0][0], "end": lo + pairs[-1][0] + 1}
                if best and best["aligned"] == len(template):
                    break
                # the next region starts behind the first mark, so one that straddles two regions is seen whole
                at = end + 1 if end == len(mine) - 1 or mine[end + 1] - mine[end] > len(template) else at + max(1, (end - at) // 2)
            if best:
                found.append(best)
        # of two that share words of the text, the shorter one stays only if it is covered better
        kept: list[dict] = []
        for f in sorted(found, key=lambda f: (-f["aligned"], -f["coverage"])):
            if all(f["end"] <= k["start"] or k["end"] <= f["start"] or f["coverage"] > k["coverage"] for k in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: (f["start"], f["license"]))


def license_report(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, aligned, start, end): one row per document and license found in its whole text.

    ``start`` and ``end`` count words.  Null and empty texts hold no license.
    Needs doc_id and text; other columns are ignored; repeated rows are
    reported alike.  An empty table gives an empty result.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage)

    @F.pandas_udf(FOUND)
    def scan(text: pd.Series) -> pd.Series:
        return text.fillna("").map(scanner.scan)

    return docs.select("doc_id", F.explode(scan("text")).alias("x")).select("doc_id", "x.*")
