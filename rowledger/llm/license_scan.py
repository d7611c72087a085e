"""License scans: winnowed fingerprints pick candidates, banded alignment reports them.

Texts are sequences of normalised words (lower case, no punctuation at the ends). Of
the hashes of every ``GRAM`` words in a row, the smallest of each ``WINDOW`` is a
fingerprint, so a shared run of GRAM + WINDOW - 1 words always shares one. The
fingerprints of the templates are an inverted index: hash -> places. A document's
fingerprints that occur in it vote for a template and a diagonal (place in the
document less place in the template); votes within half a band (and half a short template) are one candidate,
which an alignment within a band of ``BAND`` words about the diagonal confirms: the
longest common subsequence of the words that meet in the band. It
allows for words that were changed, left out or put in, and gives the matched words,
their share of the template (coverage) and the span in the document. What a long
insertion or omission tears apart lies on several diagonals: alignments of one template
that are none by themselves are joined where no more than ``GAP`` words lie between
them, and the words that they match together count. What is left then is joined over the whole
document, however far its pieces lie apart: coverage is over all of them, and only the pieces, not
what lies between, count as taken.

The index is of the size of the templates, which the caller gives and ``most`` bounds;
documents are read in one scan without a shuffle, whole. Defined results: null and
empty texts have no matches; a document with several licenses, or one license twice,
has several rows; null ids are carried and repeated rows each give their matches;
other columns are not read; an empty table or no templates give an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW, BAND, GAP = 3, 2, 8, 64
_EDGES = b"\"'()[]{}<>.,;:!?*#-_=`~|"

#: Public license notices, as they are written in files.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. "
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "LGPL-3.0-notice": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. "
        "You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list "
        "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list "
        "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this "
        "software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
        "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>"
    ),
}


class WordHashes(dict):
    """Word as written -> hash of the normalised word; 0 if nothing is left of it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        w = word.strip(_EDGES)
        h = self[word] = xxhash.xxh3_64_intdigest(w) | 1 if w else 0
        return h


def words(text: str | None, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the normalised words, their places among the words as written)."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(memo.__getitem__, raw), np.uint64, len(raw))
    at = np.flatnonzero(h)
    return h[at], at


def fingerprints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, places of their first words); texts shorter than a window give the smallest of what they have."""
    n = len(h) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(n, np.uint64)
    for i in range(GRAM):
        g = (g ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    if n <= WINDOW:
        at = np.array([int(g.argmin())])
    else:
        views = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
        at = np.unique(views.argmin(1) + np.arange(len(views)))
    return g[at], at


class Index:
    """The inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str], most: int):
        memo = WordHashes()
        self.names, self.words = list(templates), [words(t, memo)[0] for t in templates.values()]
        found = [(int(g), k, int(p)) for k, w in enumerate(self.words) for g, p in zip(*fingerprints(w), strict=True)]
        if len(found) > most:
            raise ValueError(f"the templates have {len(found)} fingerprints, more than {most}")
        found.sort()
        self.hashes = np.array([f[0] for f in found], np.uint64)
        self.template = np.array([f[1] for f in found], np.int64)
        self.place = np.array([f[2] for f in found], np.int64)

    def votes(self, h: np.ndarray) -> list[tuple[int, int]]:
        """Candidates (template, diagonal) of a document."""
        g, at = fingerprints(h)
        if not len(self.hashes) or not len(g):
            return []
        lo, hi = np.searchsorted(self.hashes, g, "left"), np.searchsorted(self.hashes, g, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return []
        pairs = sorted({(int(self.template[j]), int(at[i] - self.place[j])) for i in hit for j in range(lo[i], hi[i])})
        out: list[list[int]] = []
        for t, d in pairs:
            if out and out[-1][0] == t and d - out[-1][1] <= band(self.words[t]) // 2:
                out[-1][2] = d
            else:
                out.append([t, d, d])
        return [(t, (a + b) // 2) for t, a, b in out]


def band(template: np.ndarray) -> int:
    """Words on either side of a diagonal; of a short template half, so that it cannot meet its next copy."""
    return min(BAND, len(template) // 2)


def meetings(doc: np.ndarray, template: np.ndarray, diagonal: int) -> list[tuple[int, int]]:
    """(place in the template, place in the document) of equal words within the band about the diagonal, in order."""
    wide = band(template)
    at = np.arange(len(template))[:, None] + np.arange(diagonal - wide, diagonal + wide + 1)[None, :]
    inside = (at >= 0) & (at < len(doc))
    same = inside & (doc[np.where(inside, at, 0)] == template[:, None])
    i, k = np.nonzero(same)
    return list(zip(i.tolist(), at[i, k].tolist(), strict=True))


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest of the pairs that rise in both places: a longest common subsequence, drawn together towards its end.

    Cost: the logarithm of its length for each pair."""
    ends: list[int] = []
    held: list[int] = []
    before: list[int] = []
    # of equal places in the template, the later one in the document first, so that one of them is taken
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        if k == len(ends):
            ends.append(j)
            held.append(n)
        else:
            ends[k], held[k] = j, n
        before.append(held[k - 1] if k else -1)
    out: list[tuple[int, int]] = []
    n = held[-1] if held else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    where: dict[int, list[int]] = {}
    for i, j in pairs:
        where.setdefault(i, []).append(j)
    limit, tight = 1 << 62, []
    for i, _ in out:  # from the last to the first
        limit = max(j for j in where[i] if j < limit)
        tight.append((i, limit))
    return tight[::-1]


def parts(found: list[tuple[int, int]], words: int) -> list[list[tuple[int, int]]]:
    """A chain cut where more than ``words`` words of the document lie between two of its pairs."""
    out: list[list[tuple[int, int]]] = []
    for p in found:
        if out and p[1] - out[-1][-1][1] - 1 <= words:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", most: int = 200_000) -> DataFrame:
    """(id, license, matched, coverage, first_word, last_word, pieces): a row for each template of which a document
    holds at least the share ``least``, in one piece or in several with more than GAP words between them; places count white-space-separated words from 0. One template's
    overlapping matches are one, the best; of templates on the same words the longer match is kept."""
    index = Index(TEMPLATES if templates is None else templates, most)

    def matches(text: str | None, memo: WordHashes) -> list[tuple[int, int, float, int, int, int]]:
        h, at = words(text, memo)
        whole: list[tuple[int, int, int, int]] = []  # matched words, template, first and last place
        torn: dict[int, list] = {}
        for t, d in index.votes(h):
            met = meetings(h, index.words[t], d)
            c = chain(met)
            if c and len(c) / len(index.words[t]) >= least:
                whole.append((len(c), t, c[0][1], c[-1][1]))
            elif c:
                torn.setdefault(t, []).append((d, met))
        for t, rest in torn.items():
            rest.sort(key=lambda x: x[0])
            group: list[tuple[int, int]] = []
            for k, (d, met) in enumerate(rest):
                group += met
                if k + 1 < len(rest) and rest[k + 1][0] - d <= GAP + 2 * BAND:
                    continue
                for c in parts(chain(sorted(set(group))), GAP):
                    if len(c) / len(index.words[t]) >= least:
                        whole.append((len(c), t, c[0][1], c[-1][1]))
                group = []
        # what is taken lies apart, so its neighbours tell whether a span is free
        first: list[int] = []
        last: list[int] = []
        out: list[tuple[int, int, list[tuple[int, int]]]] = []

        def free(a: int, b: int) -> bool:
            k = bisect_left(first, a)
            return (k == 0 or last[k - 1] < a) and (k == len(first) or b < first[k])

        def take(t: int, m: int, pieces: list[tuple[int, int]]) -> None:
            out.append((t, m, pieces))
            for a, b in pieces:
                k = bisect_left(first, a)
                first.insert(k, a)
                last.insert(k, b)

        for m, t, a, b in sorted(whole, key=lambda x: (-x[0], x[3] - x[2], x[1], x[2])):
            if free(a, b):
                take(t, m, [(a, b)])
        # what no span holds, joined over the whole document; the longest templates first
        for t in sorted(torn, key=lambda t: (-len(index.words[t]), t)):
            n, loose = len(index.words[t]), {p for _, met in torn[t] for p in met}
            while True:
                loose = {p for p in loose if free(p[1], p[1])}
                if len({i for i, _ in loose}) / n < least:
                    break
                # fewer words than a fingerprint has meet by chance
                found = [p for p in parts(chain(sorted(loose)), GAP) if len(p) >= GRAM]
                m, pieces = sum(map(len, found)), [(p[0][1], p[-1][1]) for p in found]
                if m / n < least or not all(free(a, b) for a, b in pieces):
                    break
                take(t, m, pieces)
        return [(t, m, m / len(index.words[t]), int(at[p[0][0]]), int(at[p[-1][1]]), len(p)) for t, m, p in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            found = [(i, *m) for i, t in enumerate(b.column(1)) for m in matches(t.as_py(), memo)]
            if not found:
                continue
            at, t, *rest = zip(*found, strict=True)
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([index.names[k] for k in t]), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], ["id", "license", "matched", "coverage", "first_word", "last_word", "pieces"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, license string, matched long, coverage double, first_word long, last_word long, pieces long").withColumnRenamed("id", id_col)
