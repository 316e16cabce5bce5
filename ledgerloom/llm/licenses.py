"""License scans: winnowed template fingerprints, then banded alignment.

A template's word k-grams are winnowed (Schleimer et al., 2003) into an
inverted index: pairs of words of the short notices, and every second or so triple
of longer texts. All pairs and triples of a text probe it. The index alone
proposes candidates: the diagonals whose band holds a fingerprint that both share,
two of a longer template. Each is aligned with the template within its band of
words, so texts that insert or drop more than `band` words in one place are
beyond it. A run of four words of a longer template always holds a fingerprint.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_or_empty

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
    whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
    permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
    IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
    FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
    CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
    CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_OPENING = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
    list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
    ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
    LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
    CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
    EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Licences and notices as they are worded.
TEMPLATES = {
    "MIT": _MIT,
    "BSD-2-Clause": f"{_BSD_OPENING} {_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD_OPENING} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
        is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program. If not, see
        https://www.gnu.org/licenses/.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-notice": "Licensed under CC BY-NC 4.0.",
}

_WORD = re.compile(r"[^\W_]+")
#: Cells of alignment tables that are filled at once.
_CELLS = 1 << 20


# (k, window) of short templates and of the others.
_SHORT, _LONG = (2, 1), (3, 2)
_SHORT_WORDS, _LEAST_WORDS = 20, 3


class TemplateIndex:
    """Winnowed fingerprints of all templates. A k-gram is exact: the numbers of
    its words, in a vocabulary of the templates' words, in one integer."""

    def __init__(self, templates: dict[str, str], band: int = 8):
        self.band = band
        self.names = sorted(templates)
        words = {n: _WORD.findall(templates[n].lower()) for n in self.names}
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for ws in words.values() for w in ws}))}
        self.base = len(self.vocabulary) + 1
        self.ids = [np.array([self.vocabulary[w] for w in words[n]], np.int64) for n in self.names]
        self.index: dict[int, dict[int, list[tuple[int, int]]]] = {k: defaultdict(list) for k, _ in (_SHORT, _LONG)}
        for t, ids in enumerate(self.ids):
            k, window = _SHORT if len(ids) <= _SHORT_WORDS else _LONG
            if len(ids) < _LEAST_WORDS:
                raise ValueError(f"template {self.names[t]} has under {_LEAST_WORDS} words")
            grams = self.grams(ids, k)
            order = (grams * -7046029254386353131) ^ (grams >> 7)
            width = min(window, len(grams))
            kept = {at + int(np.argmin(order[at : at + width])) for at in range(len(grams) - width + 1)}
            for at in sorted(kept):
                self.index[k][int(grams[at])].append((t, at))
        self.keys = {k: np.array(sorted(found), np.int64) for k, found in self.index.items()}

    def grams(self, ids: np.ndarray, k: int) -> np.ndarray:
        """The k-gram at each place; -1 where it has a word of no template."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(k):
            out = out * self.base + ids[j : j + n]
            known &= ids[j : j + n] > 0
        return np.where(known, out, -1)

    def places(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal) of every candidate: all diagonals whose band holds
        a fingerprint that text and template share."""
        found: dict[int, list[int]] = defaultdict(list)
        for k, keys in self.keys.items():
            grams = self.grams(ids, k)
            for at in np.flatnonzero(np.isin(grams, keys)) if len(grams) else ():
                for t, own in self.index[k][int(grams[at])]:
                    found[t].append(int(at) - own)
        out = []
        for t, diagonals in found.items():
            b, met = self.band_of(t), np.sort(diagonals)
            near = np.unique((np.unique(met)[:, None] + np.arange(-b, b + 1)).ravel())
            held = np.searchsorted(met, near + b, "right") - np.searchsorted(met, near - b)
            out += [(t, int(d)) for d in near[held >= (1 if len(self.ids[t]) <= _SHORT_WORDS else 2)]]
        return out

    def band_of(self, t: int) -> int:
        """Under half a template's length, so that copies in a row stay apart."""
        return min(self.band, max(1, (len(self.ids[t]) - 1) // 2))

    def _tables(self, t: int, ids: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences from each cell on, for all
        diagonals at once: [template word, diagonal, column], where column c of
        row i is the text's word diagonal + i - band + c."""
        own, b = self.ids[t], self.band_of(t)
        width = 2 * b + 1
        lo = len(own) + 2 * b + max(0, -int(diagonals.min()))
        hi = max(0, int(diagonals.max()) + 2 * len(own) + 2 * b - len(ids))
        text = np.concatenate([np.full(lo, -1), ids, np.full(hi, -1)])
        best = np.zeros((len(own) + 1, len(diagonals), width + 1), np.int16)
        columns = np.arange(width) - b + lo
        for i in range(len(own) - 1, -1, -1):
            met = text[diagonals[:, None] + i + columns] == own[i]
            row = np.where(met, best[i + 1, :, :width] + 1, 0)
            row[:, 1:] = np.maximum(row[:, 1:], best[i + 1, :, : width - 1])
            best[i, :, :width] = np.maximum.accumulate(row[:, ::-1], axis=1)[:, ::-1]
        return best

    def align(self, t: int, ids: np.ndarray, diagonal: int, best: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Longest common subsequence of a template and the text near a
        diagonal, as (template word, text word) pairs; best: that diagonal's table."""
        own, b = self.ids[t], self.band_of(t)
        width = 2 * b + 1
        best = self._tables(t, ids, np.array([diagonal]))[:, 0] if best is None else best
        pairs, i, c = [], 0, 0
        while i < len(own) and c < width:
            j = diagonal + i - b + c
            if 0 <= j < len(ids) and ids[j] == own[i] and best[i, c] == best[i + 1, c] + 1:
                pairs.append((i, j))
                i += 1
            elif best[i, c] == best[i, c + 1]:
                c += 1
            else:
                i, c = i + 1, c - 1
        return pairs

    def aligned(self, candidates: list[tuple[int, int]], ids: np.ndarray, least: float) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(template, pairs) of the candidates that cover enough of a template."""
        of_template: dict[int, list[int]] = defaultdict(list)
        for t, diagonal in candidates:
            of_template[t].append(diagonal)
        for t, diagonals in of_template.items():
            own = len(self.ids[t])
            step = max(1, _CELLS // (own * (2 * self.band_of(t) + 2)))
            for at in range(0, len(diagonals), step):
                some = np.array(diagonals[at : at + step])
                best = self._tables(t, ids, some)
                for k in np.flatnonzero(best[0, :, 0] >= least * own - 1e-9):
                    yield t, self.align(t, ids, int(some[k]), best[:, k])

    def scan(self, text: str, least: float) -> list[dict]:
        """Matches that cover at least the share `least` of a template."""
        words = _WORD.findall(text.lower())
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        candidates = sorted(self.places(ids)) if ids.any() else []
        out, where = [], None
        for t, pairs in self.aligned(candidates, ids, least):
            coverage = len(pairs) / len(self.ids[t])
            if where is None:
                where = _positions(text, len(words))
            runs: list[list[int]] = []
            for _, j in pairs:
                if runs and j == runs[-1][1] + 1:
                    runs[-1][1] = j
                else:
                    runs.append([j, j])
            spans = [{"start": where[a][0], "end": where[z][1]} for a, z in runs]
            out.append({"template": self.names[t], "coverage": round(coverage, 6), "start": spans[0]["start"], "end": spans[-1]["end"], "spans": spans})
        return _best(out)


def _positions(text: str, n_words: int) -> list[tuple[int, int]]:
    """Where the words stand. lower() may lengthen a text; then words are found
    in the text as it is, lower-cased letter by letter where that keeps length."""
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    found = [m.span() for m in _WORD.finditer(lowered)]
    return found if len(found) == n_words else found + [(len(text), len(text))] * max(0, n_words - len(found))


def _best(matches: list[dict]) -> list[dict]:
    """Of matches of one template that overlap, the one that covers most, in the
    least space. Kept ones don't overlap, so only the neighbours are looked at."""
    kept: dict[str, list[tuple[int, int, dict]]] = defaultdict(list)
    for m in sorted(matches, key=lambda m: (-m["coverage"], m["end"] - m["start"], m["start"])):
        own, entry = kept[m["template"]], (m["start"], m["end"])
        at = bisect_left(own, entry, key=lambda x: x[:2])
        if (at == 0 or own[at - 1][1] <= m["start"]) and (at == len(own) or m["end"] <= own[at][0]):
            own.insert(at, (*entry, m))
    return sorted((m for own in kept.values() for *_, m in own), key=lambda m: (m["start"], m["template"]))


_MATCH = pa.struct({"template": pa.string(), "coverage": pa.float64(), "start": pa.int32(), "end": pa.int32(), "spans": pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()}))})


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_matches and matches (template,
    coverage, start, end and spans, in code points, end exclusive).

    Null and empty texts have no match; ids may be null or repeat; other columns
    are ignored; an empty table gives no row.
    """
    index = TemplateIndex(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.scan(t.as_py(), least) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int32()), pa.array(found, pa.list_(_MATCH))], names=["doc_id", "n_matches", "matches"]
            )

    kind = dict(docs.dtypes)[id_col]
    match = "struct<template:string,coverage:double,start:int,end:int,spans:array<struct<start:int,end:int>>>"
    narrow = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, n_matches int, matches array<{match}>")
