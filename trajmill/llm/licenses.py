"""License scans by patience alignment.

A text and a license template are sequences of words. Anchors are words that occur exactly once in both; the longest
increasing subsequence of their places aligns them, and the gaps between neighbours are aligned in the same way. Where a
gap has no anchor, equal words at its two ends are taken, and what is left is aligned by the longest common subsequence. Coverage is
the share of the template's words that are aligned. Wordings of all lengths are found so; what tells licenses apart (NAMES) must be
there word for word.

A text may hold a template anywhere and several times, so the alignment runs in windows around places where the template
may be: as a match misses at most a share 1 - COVERAGE of its words, it holds one of any words that together make up a
larger share, and the rarest such words of the text give the windows: the template's place around each, and a quarter of its length
on either side, so that copies one after the other have a window each. Of matches that overlap that with more aligned words
counts, of equal ones the first in the text, then by name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trajmill.llm.common import slices

COVERAGE = 0.8
#: A point after a digit and before a letter ends a sentence ("version 3.The").
_WORD = re.compile(r"[^\W_]+(?:(?:[\-']|\.(?!(?<=\d\.)[^\W\d_]))[^\W_]+)*")

# Wordings of public licenses and of the notices that name them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "under the MIT License",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU General Public License, version 2",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "GNU Lesser General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU Lesser General Public License, version 2.1",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "CC BY-NC 4.0",
        "Creative Commons Attribution-NonCommercial 4.0 International",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "CC BY 4.0",
        "Creative Commons Attribution 4.0 International",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "CC BY-SA 4.0",
        "Creative Commons Attribution-ShareAlike 4.0 International",
    ],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
#: Words at the ends of a match that are further from the rest are not part of it; those of short wordings are nearer.
APART = 10
#: What tells licenses apart: where a template has these words, a match has them, side by side.
NAMES = [
    "apache license version 2.0", "gnu general public license", "gnu lesser general public license", "gnu affero general public license", "version 2", "version 2.1", "version 3", "mozilla public license v 2.0", "mit license",
    "cc by 4.0", "cc by-nc 4.0", "cc by-sa 4.0", "commons attribution 4.0", "commons attribution-noncommercial 4.0", "commons attribution-sharealike 4.0", "creative commons zero v1.0", "cc0 1.0 universal",
]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (in order of the first) whose second members increase."""
    tails: list[int] = []
    at: list[int] = []
    back = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back.append(at[k - 1] if k else -1)
        tails[k:] = [b, *tails[k + 1 :]]
        at[k:] = [i, *at[k + 1 :]]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. A row of its table is one number with a bit for each word of b, which is 0 where the row
    grows; rows are kept to walk back, so memory is len(a) * len(b) bits."""
    every = (1 << len(b)) - 1
    places: dict[str, int] = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    rows = [every]
    for w in a:
        last = rows[-1]
        both = last & places.get(w, 0)
        rows.append((last + both | last - both) & every)
    length = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif length(i - 1, j) == length(i, j):
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in a, in b) of aligned equal words, increasing in both."""
    done: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            done.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            done.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            if in_a.keys() & in_b.keys():
                done += [(a0 + i, b0 + j) for i, j in common(a[a0:a1], b[b0:b1])]
            continue
        done += anchors
        for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(done)


class Template:
    def __init__(self, name: str, text: str, coverage: float):
        self.name, self.words = name, words_of(text)
        self.counts = Counter(self.words)
        #: Words make up more than this many of the template's: a match holds one of them.
        self.spare = len(self.words) - -(-len(self.words) * coverage // 1)
        self.apart = min(APART, 2 + len(self.words) // 3)
        named = [n.split() for n in NAMES]
        self.names = [(i, len(n)) for n in named for i in range(len(self.words)) if self.words[i : i + len(n)] == n]
        #: A match has all of these words.
        self.must = {w for i, n in self.names for w in self.words[i : i + n]}
        self.signs = [max(self.must, key=lambda w: (len(w), w))] if self.must else self._enough(sorted(self.counts, key=lambda w: (-len(w), w)))

    def _enough(self, words: list[str]) -> list[str]:
        out, total = [], 0
        for w in words:
            out.append(w)
            total += self.counts[w]
            if total > self.spare:
                break
        return out

    def hits(self, text: list[str], places: dict[str, list[int]], coverage: float) -> list[tuple[float, int, int, int]]:
        """(coverage, begin, end, aligned words) in words of matches that don't overlap, the best first."""
        if not places.keys() >= self.must or sum(n for w, n in self.counts.items() if w in places) < len(self.words) - self.spare:
            return []
        rare = self._enough(sorted(self.counts, key=lambda w: (len(places.get(w, ())), w)))
        if self.must:  # or one that any match has
            rare = min(rare, [min(self.must, key=lambda w: (len(places[w]), w))], key=lambda words: sum(len(places.get(w, ())) for w in words))
        wanted, slack = set(rare), len(self.words) // 4 + 3
        found, until, tried = [], 0, None
        begins = sorted({max(0, p - i - slack) for i, w in enumerate(self.words) if w in wanted for p in places.get(w, ())})
        for n, start in enumerate(begins):
            if start < until - slack or (tried is not None and n + 1 < len(begins) and begins[n + 1] - tried < slack // 2):  # the next window shows as much
                continue
            tried = start
            first = max(start, until)
            part = text[first : start + len(self.words) + 2 * slack]
            pairs = align(self.words, part)
            while len(pairs) > 1 and pairs[1][1] - pairs[0][1] > self.apart:
                pairs.pop(0)
            while len(pairs) > 1 and pairs[-1][1] - pairs[-2][1] > self.apart:
                pairs.pop()
            at = dict(pairs)
            named = all(i in at and at.get(i + k) == at[i] + k for i, n in self.names for k in range(n))
            if named and len(pairs) >= len(self.words) - self.spare:
                found.append((len(pairs) / len(self.words), first + pairs[0][1], first + pairs[-1][1] + 1, len(pairs)))
                until = first + pairs[-1][1] + 1
        return sorted(found, key=lambda x: (-x[0], x[1]))


def scan(text: str, templates: list[Template], coverage: float) -> list[tuple[str, float, int, int]]:
    """(license, coverage, begin, end in words) of every match, in order; a match inside one of another license that covers
    more words is left out."""
    low = text.lower()
    likely = [t for t in templates if any(w in low for w in t.signs)]
    if not likely:
        return []
    words = words_of(text)
    wanted = {w for t in likely for w in t.counts}
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in wanted:
            places.setdefault(w, []).append(i)
    found = [(t.name, *hit) for t in likely for hit in t.hits(words, places, coverage)]
    found.sort(key=lambda x: (-x[4], x[2], x[0]))
    kept: list[tuple[str, float, int, int]] = []
    begins: list[int] = []  # of the kept ones, which don't overlap
    for *x, _ in found:
        i = bisect_left(begins, x[2])
        if (i == 0 or kept[i - 1][3] <= x[2]) and (i == len(begins) or begins[i] >= x[3]):
            kept.insert(i, tuple(x))
            begins.insert(i, x[2])
    return kept


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license (of the largest coverage, the first of equals; null if none), coverage (0 if none), n_matches and
    matches (license, coverage, first word, word after the last) for every row's whole text.

    A null or empty text has no match. Of licenses of one coverage the first in the text is named. Rows that share a doc_id have a result each. Other columns are ignored. No rows: no
    rows.
    """
    named = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Template(name, text, coverage) for name, texts in named.items() for text in texts]
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = [scan(t, own, coverage) if t else [] for t in batch.column(1).to_pylist()]
            best = [min(x, key=lambda m: (-m[1], m[2])) if x else (None, 0.0) for x in found]
            matches = pa.array([[dict(zip(("license", "coverage", "begin", "end"), m, strict=True)) for m in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array([len(x) for x in found], pa.int64()), matches], ["doc_id", "license", "coverage", "n_matches", "matches"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, license string, coverage double, n_matches bigint, matches array<struct<license:string,coverage:double,begin:bigint,end:bigint>>")
