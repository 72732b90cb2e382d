"""License scans: which license templates a text holds, how much of each, and where.

Texts and templates are words of letters and digits, lower-cased. Of each template, the winnowed hashes of its three-word grams
(the least of each WINDOW in a row) go to an inverted index; as there are few templates, every worker holds it. A text's grams are
looked up, all of them; those found give candidates: a template and about where it begins. Each candidate is aligned with the
text within a band around that place, of BAND words or a quarter of the template's if that is more (match 2, mismatch and gap -1, best local alignment). It is reported if the
matched words cover COVERAGE of the template.

A few edits leave a template of less than SHORT words no gram, so these go by single words: every stretch of text, as long as an
alignment can be, with enough of the template's words is aligned in full. Whatever has an alignment that covers COVERAGE of them is found.

Of overlapping matches of one text, one that lies inside another with more matched words is left out; of equal ones the first by
template stays. Null and empty texts match nothing; an empty table gives no rows. Texts of any length are read whole, a worker holds
one of them; the work grows with the text and with the places where a template's grams are found. Rows are independent: repeated rows
report alike, null ids are kept, extra columns are dropped.
"""

from __future__ import annotations

import bisect
import re
from collections import deque
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import parts

GRAM, WINDOW, BAND = 3, 4, 4
COVERAGE = 0.8
SHORT = 2 * (GRAM + WINDOW)

#: Notices and texts of public licenses.
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. " + _BSD_DISCLAIMER
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of "
        "the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. " + _BSD_DISCLAIMER
    ),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
        "version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "cc0-1.0-notice": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy "
        "of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
        "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "
        "AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/"
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in "
        "a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions "
        "must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the "
        "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
        "so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license "
        "grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and "
        "all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable "
        "object code generated by a source language processor. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND "
        "NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."
    ),
}


def templates_in(folder: str) -> dict[str, str]:
    """The texts in a folder of the driver as templates, by file name: for whole licenses such as the GPL's, which are not kept here."""
    return {p.name: p.read_text(encoding="utf-8", errors="replace") for p in sorted(Path(folder).iterdir()) if p.is_file()}


_WORD = re.compile(rb"[a-z0-9]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


def align(a: np.ndarray, b: np.ndarray, first: int, last: int, need: float = 0) -> tuple[int, int, int]:
    """Best local alignment of a with b on the diagonals first to last (place in b less place in a), of those that match `need`
    words: matched words, and the span in b. Of equal scores, the one that ends first in a and then in b."""
    width = last - first + 1
    none = (0, 0, -1, -1)  # score, matches, begin, end in b
    row, best = [none] * (width + 2), none
    for i, word in enumerate(a.tolist()):
        new = [none] * (width + 2)
        for d in range(width):
            j = i + first + d
            if not 0 <= j < len(b):
                continue
            score, matches, begin, _ = row[d + 1]
            same = int(b[j]) == word
            cell = (score + (2 if same else -1), matches + same, begin if score > 0 else j, j)
            for score, matches, begin, _ in (row[d + 2], new[d]):  # a word of a, or of b, has no partner
                if score - 1 > cell[0]:
                    cell = (score - 1, matches, begin, j)
            new[d + 1] = cell if cell[0] > 0 else none
            if new[d + 1][0] > best[0] and new[d + 1][1] >= need:
                best = new[d + 1]
        row = new
    return best[1], best[2], best[3] + 1


class Spans:
    """Stretches of a text, none inside another, that tell whether they hold a place."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.begins, self.ends = [], []
        for begin, end in sorted(spans):
            self.begins.append(begin)
            self.ends.append(end)

    def add(self, begin: int, end: int) -> None:
        k = bisect.bisect_right(self.begins, begin)
        self.begins.insert(k, begin)
        self.ends.insert(k, end)

    def hold(self, at: int) -> bool:
        k = bisect.bisect_right(self.begins, at) - 1
        return k >= 0 and at < self.ends[k]


def within_earlier(spans: list[tuple[int, int]]) -> list[bool]:
    """For each span: whether one before it in the list holds all of it. A binary indexed tree keeps, for each begin, the greatest
    end of the spans so far that begin there or before."""
    begins = sorted({a for a, _ in spans})
    greatest, out = [-1] * (len(begins) + 1), []
    for begin, end in spans:
        at, most = bisect.bisect_left(begins, begin) + 1, -1
        k = at
        while k:
            most = max(most, greatest[k])
            k &= k - 1
        out.append(most >= end)
        while at < len(greatest):
            greatest[at] = max(greatest[at], end)
            at += at & -at
    return out


class LicenseIndex:
    def __init__(self, templates: dict[str, str]):
        words = {k: words_of(v) for k, v in templates.items()}
        self.number = {w: n for n, w in enumerate(sorted({w for x in words.values() for w in x}))}
        self.names, self.templates, places = list(templates), [], []
        for t, name in enumerate(self.names):
            ids = np.array([self.number[w] for w in words[name]], dtype=np.int64)
            if len(ids) < GRAM:
                raise ValueError(f"template {name} has fewer than {GRAM} words")
            self.templates.append(ids)
            if len(ids) < SHORT:
                continue
            grams = self._grams(ids)
            order = (grams * np.int64(0x5DEECE66D) + 11) & 0xFFFFFFFFFFFF  # the hash that winnowing goes by
            w = min(WINDOW, len(grams))
            for k in sorted({s + int(np.argmin(order[s : s + w])) for s in range(len(grams) - w + 1)}):
                places.append((int(grams[k]), t, k))
        places.sort()
        self.keys = np.array([x[0] for x in places], dtype=np.int64)
        self.of = [(t, k) for _, t, k in places]
        self.short = [t for t, ids in enumerate(self.templates) if len(ids) < SHORT]
        counts = [np.bincount(self.templates[t], minlength=len(self.number)) for t in self.short]
        self.short_words = np.array(counts, dtype=np.int64).reshape(len(self.short), len(self.number))
        self.short_need = np.array([COVERAGE * len(self.templates[t]) for t in self.short])

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        """A number for each gram, -1 where a word is in no template."""
        n = len(self.number)
        parts = [ids[k : len(ids) - GRAM + 1 + k] for k in range(GRAM)]
        out = np.zeros(len(parts[0]), dtype=np.int64)
        for p in parts:
            out = out * n + p
        return np.where(np.minimum.reduce(parts) < 0, -1, out)

    def _aligned(self, ids: np.ndarray, t: int, places: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """Matches of template t (matched words, begin, end, t); places: where it would begin, and the gram that says so."""
        template, found = self.templates[t], []
        size, need = len(template), COVERAGE * len(template)
        own = np.bincount(template, minlength=len(self.number))
        left = []
        for begin, at in places:
            if found and found[-1][1] <= at < found[-1][2]:
                continue
            if begin >= 0 and np.array_equal(ids[begin : begin + size], template):
                found.append((size, begin, begin + size, t))
            else:
                left.append((begin, at))
        spans = Spans(x[1:3] for x in found)
        queue, band = deque(left), max(BAND, size // 4)
        while queue:
            group = [queue.popleft()]
            while queue and queue[0][0] <= group[0][0] + band:
                group.append(queue.popleft())
            group = [x for x in group if not spans.hold(x[1])]
            if not group:
                continue
            low = max(0, group[0][0] - band)
            part = ids[low : group[-1][0] + size + band]
            if np.minimum(np.bincount(part[part >= 0], minlength=len(own)), own).sum() < need:
                continue  # too few words of the template
            matched, a, b = align(template, part, group[0][0] - band - low, group[-1][0] + band - low)
            if matched >= need:
                found.append((matched, a + low, b + low, t))
                spans.add(a + low, b + low)
                queue.extendleft(x for x in reversed(group[1:]) if x[1] >= b + low)
        return found

    def _short(self, ids: np.ndarray, t: int, own: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Matches of the short template t (matched words, begin, end, t); own: how often it has each word."""
        template = self.templates[t]
        size, need = len(template), COVERAGE * len(template)
        reach = 3 * size  # matches count 2 and other words -1, so no alignment is longer
        at = np.flatnonzero(np.append(own > 0, False)[ids])
        words, ends = ids[at], np.searchsorted(at, at + reach)
        held = np.zeros(len(at), dtype=np.int64)
        for w in np.flatnonzero(own):
            upto = np.append(0, np.cumsum(words == w))
            held += np.minimum(upto[ends] - upto[:-1], own[w])
        whole = at[(words == template[0]) & (at + size <= len(ids))]
        for k in range(1, size):
            whole = whole[ids[whole + k] == template[k]]
        starts, found, left, begin = at[held >= need], [], [], 0
        for x in whole.tolist():
            if x >= begin:
                found.append((size, x, x + size, t))
                left.append((begin, x))
                begin = x + size
        left.append((begin, len(ids)))
        while left:
            low, high = left.pop()
            k = np.searchsorted(starts, low)
            if k == len(starts) or starts[k] >= high:
                continue
            low = int(starts[k])
            part = ids[low : min(low + 2 * reach, high)]
            if np.minimum(np.bincount(part[part >= 0], minlength=len(own)), own).sum() >= need:
                matched, a, b = align(template, part, 1 - size, len(part) - 1, need)
                if matched:
                    found.append((matched, low + a, low + b, t))
                    left += [(low, low + a), (low + b, high)]
                    continue
            left.append((low + reach + 1, high))
        return found

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """Matches: template, coverage, matched words, begin and end (code points)."""
        raw = (text or "").encode().lower()
        get = self.number.get
        ids = np.array([get(w, -1) for w in _WORD.findall(raw)], dtype=np.int64)
        if len(ids) < GRAM:
            return []
        grams = self._grams(ids)
        hits = np.flatnonzero((grams >= 0) & np.isin(grams, self.keys))
        starts: dict[int, list[tuple[int, int]]] = {}
        for at in hits.tolist():
            for x in range(np.searchsorted(self.keys, grams[at]), np.searchsorted(self.keys, grams[at], "right")):
                t, k = self.of[x]
                starts.setdefault(t, []).append((at - k, at))
        found = []
        for t, places in starts.items():
            found += self._aligned(ids, t, sorted(places))
        counts = np.bincount(ids[ids >= 0], minlength=len(self.number))
        for k in np.flatnonzero(np.minimum(self.short_words, counts).sum(axis=1) >= self.short_need):
            found += self._short(ids, self.short[k], self.short_words[k])
        if not found:
            return []
        found.sort(key=lambda x: (-x[0], x[3], x[1]))
        kept = [x for x, inside in zip(found, within_earlier([x[1:3] for x in found]), strict=True) if not inside]
        spans = [m.span() for m in _WORD.finditer(raw)]
        ends = np.array([(spans[a][0], spans[b - 1][1]) for _, a, b, _ in kept])
        if not raw.isascii():  # bytes to code points
            starts_char = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
            ends = np.append(0, np.cumsum(starts_char))[ends]
        return sorted((self.names[t], m / len(self.templates[t]), m, a, b) for (m, _, _, t), (a, b) in zip(kept, ends.tolist(), strict=True))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each match: id_col, license, coverage, matched_words, begin, end (code points of the text)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = "license string, coverage double, matched_words long, begin long, end long"
    schema = T.StructType([source.schema.fields[0], *T._parse_datatype_string(kind)])
    types = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(templates)
        for batch in parts(batches):
            rows, at = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = index.scan(text)
                rows += own
                at += [k] * len(own)
            made = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(v, t) for v, t in zip(made, types, strict=True))], names=["id", "license", "coverage", "matched_words", "begin", "end"])

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
