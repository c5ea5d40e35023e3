"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are cut into words (letters and digits, A-Z as a-z). Their runs of ``GRAM`` words are hashed, and of
``WINDOW`` hashes in a row the least is selected: the fingerprints, in an inverted index from hash to (template,
place). The index is as large as the templates, whatever the corpus, and goes to every task.

A document's runs are looked up in the index; hits of one template on neighbouring diagonals (place in the
document less place in the template) make a candidate. A banded local alignment of the template with the words
around (match +2, other word -1, gap -1; the band lies ``BAND`` words and an eighth of the template about the
diagonal) gives the matched words. Coverage is their share of the template; a span from the first to the last
matched word is reported where coverage reaches ``LEAST``. Of overlapping spans of one template the best stays.

There is one row for each document and template with a span. Defined cases: null, empty and license-free texts
give no row; repeated rows give their rows each; texts of any length are read whole. Only doc_id and text are
read, other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxtone.llm.common import small_batches
from fluxtone.llm.textops import _K, joined, mix, parts, words

GRAM, WINDOW = 3, 2
BAND = 4
LEAST = 0.8

_MIT_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_ADVERTISING = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by the organization. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Public license notices, as they are commonly written.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "rights reserved": "All rights reserved.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        + _MIT_DISCLAIMER
    ),
    "BSD text": _BSD_TWO + _BSD_DISCLAIMER,
    "BSD-3-Clause text": _BSD_TWO + _BSD_THIRD + _BSD_DISCLAIMER,
    "BSD-4-Clause text": _BSD_TWO + _BSD_ADVERTISING + _BSD_THIRD + _BSD_DISCLAIMER,
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "LGPL header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. "
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>."
    ),
    "AGPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. "
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
        "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Unlicense dedication": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to "
        "the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "MIT disclaimer": _MIT_DISCLAIMER,
    "BSD disclaimer": _BSD_DISCLAIMER,
}



def whole_texts() -> dict[str, str]:
    """Whole long licenses, from the files beside this module. Only the driver reads them."""
    return {f"{x.stem} text": x.read_text(encoding="utf-8") for x in sorted(Path(__file__).with_name("licenses").glob("*.txt"))}


#: Everything in ASCII but letters and digits parts words; a line feed between texts does so too.
_BLANK = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def grams(h: np.ndarray) -> np.ndarray:
    n = len(h) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(GRAM):
        out += h[j : n + j] * _K[20 + j]
    return mix(out)


class Index:
    """Fingerprints of templates, sorted by hash."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words = [], []
        prints, owner, place = [], [], []
        for name, text in templates.items():
            h = words(text.encode().translate(_BLANK))[2]
            g = grams(h)
            if not len(g):
                continue
            w = min(WINDOW, len(g))
            view = np.lib.stride_tricks.sliding_window_view(g, w)
            for p in np.unique(np.arange(len(view)) + view.argmin(axis=1)):
                prints.append(g[p])
                owner.append(len(self.names))
                place.append(p)
            self.names.append(name)
            self.words.append(h)
        order = np.argsort(np.array(prints, np.uint64), kind="stable")
        self.prints, self.owner, self.place = (np.array(x, t)[order] for x, t in ((prints, np.uint64), (owner, np.int64), (place, np.int64)))

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in g, templates, and places in them."""
        low, high = np.searchsorted(self.prints, g, "left"), np.searchsorted(self.prints, g, "right")
        found = np.flatnonzero(high > low)
        each = (high - low)[found]
        at = np.repeat(low[found], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return np.repeat(found, each), self.owner[at], self.place[at]


#: Alignments of one template advance together, as many as have about so many columns in all.
COLUMNS = 1 << 18


def align_all(template: np.ndarray, doc: np.ndarray, diagonals: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each diagonal the best local alignment with j - i within ``band`` of it: matched words, first and last matched place in doc."""
    n, width, m = len(template), 2 * band + 1, len(diagonals)
    column, big, row = np.arange(width), 2 * width, np.arange(m)
    start = np.asarray(diagonals)[:, None] - band + column  # of the first template word; the next has the next places
    score, matched = np.zeros((m, width), np.int64), np.zeros((m, width), np.int64)
    first, last = np.full((m, width), -1), np.full((m, width), -1)
    best = np.zeros((4, m), np.int64)
    best[2:] = -1
    for i in range(n):
        place = start + i
        inside = (place >= 0) & (place < len(doc))  # places outside of doc match nothing
        same = inside & (doc[np.where(inside, place, 0)] == template[i])
        base = np.where(same, score + 2, score - 1)
        held, f, e = matched + same, np.where(same & (first < 0), place, first), np.where(same, place, last)
        up = np.zeros((m, width), bool)
        up[:, :-1] = score[:, 1:] - 1 > base[:, :-1]  # a word of the template left out
        for new, old in ((base, score - 1), (held, matched), (f, first), (e, last)):
            new[:, :-1] = np.where(up[:, :-1], old[:, 1:], new[:, :-1])
        none = base <= 0
        base[none], held[none], f[none], e[none] = 0, 0, -1, -1
        # words of the document left out: the best column at or before each, the last of equal ones
        origin = np.maximum.accumulate((base + column) * big + column, axis=1) % big
        score, matched, first, last = np.take_along_axis(base, origin, 1) - (column - origin), *(np.take_along_axis(x, origin, 1) for x in (held, f, e))
        none = score <= 0
        score[none], matched[none], first[none], last[none] = 0, 0, -1, -1
        top = score.argmax(axis=1)
        better = score[row, top] > best[0]
        best[:, better] = np.stack([x[row, top] for x in (score, matched, first, last)])[:, better]
    return best[1], best[2], best[3]


def align(template: np.ndarray, doc: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    return tuple(int(x[0]) for x in align_all(template, doc, np.array([diagonal]), band))


def most_matched(template: np.ndarray, doc: np.ndarray) -> int:
    """No alignment matches more words than the two have in common, each as often as both have it."""
    x, n = np.unique(template, return_counts=True)
    y, k = np.unique(doc, return_counts=True)
    _, a, b = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[a], k[b]).sum())


def scan_text(index: Index, h: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, float, int, int]]:
    """(template, coverage, first word, last word) of every match; h: the text's words, found: its hits."""
    out = []
    place, owner, inner = found
    for t in np.unique(owner):
        own = np.flatnonzero(owner == t)
        template = index.words[t]
        band = BAND + len(template) // 8
        diagonals = np.sort(place[own] - inner[own])
        cuts = np.flatnonzero(np.diff(diagonals) > band) + 1
        spans, wanted = [], []
        for cluster in np.split(diagonals, cuts):
            # a long cluster of shifting diagonals is read in steps of the band
            low, high = int(cluster[0]), int(cluster[-1])
            for diagonal in [(low + high) // 2] if high - low <= band else range(low, high + 1, band):
                part = h[max(0, diagonal - band) : diagonal + len(template) + band]
                if len(part) >= LEAST * len(template) and most_matched(template, part) >= LEAST * len(template):
                    wanted.append(diagonal)
        many = max(1, COLUMNS // (2 * band + 1))
        for at in range(0, len(wanted), many):
            for matched, first, last in zip(*align_all(template, h, np.array(wanted[at : at + many]), band), strict=True):
                if matched >= LEAST * len(template):
                    spans.append((int(matched) / len(template), int(first), int(last)))
        starts, ends = [], []  # of the spans taken, which don't overlap, in order
        for coverage, first, last in sorted(set(spans), key=lambda s: (-s[0], s[2] - s[1], s[1])):
            at = bisect_right(starts, last)  # the spans before this place begin where this one ends, or earlier
            if not at or ends[at - 1] < first:
                starts.insert(at, first)
                ends.insert(at, last)
                out.append((int(t), coverage, first, last))
    return sorted(out, key=lambda x: (x[0], x[2]))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each document and template found: doc_id, license, coverage (of the best span), n_spans, spans.

    A span has start and stop (code points of the text, stop exclusive) and coverage.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES | whole_texts()))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for offset, texts in parts(batch["text"]):
                data, starts = joined(texts)
                at, end, h = words(data.translate(_BLANK))
                found = index.hits(grams(h))
                if not len(found[0]):
                    continue
                bound = np.searchsorted(at, starts)
                order = np.argsort(found[0], kind="stable")
                found = tuple(x[order] for x in found)
                text_of = np.searchsorted(bound, found[0], "right") - 1
                rows, inner_of, inner = [], None, None
                for i in np.unique(text_of):
                    a, b = bound[i], bound[i + 1]
                    s = slice(*np.searchsorted(text_of, (i, i + 1)))
                    own = found[0][s] + GRAM <= b  # runs that end in the next text are none
                    hits = (found[0][s][own] - a, found[1][s][own], found[2][s][own])
                    for t in np.unique(hits[1]):
                        pick = hits[1] == t
                        spans = scan_text(index, h[a:b], tuple(x[pick] for x in hits))
                        if spans:
                            begin = starts[i]
                            if i != inner_of:
                                inner_of, inner = i, np.flatnonzero((np.frombuffer(texts[i], np.uint8) & 0xC0) == 0x80)
                            # bytes before a place that begin a character
                            point = lambda byte: int(byte - begin - np.searchsorted(inner, byte - begin))  # noqa: B023, E731
                            rows.append((offset + int(i), index.names[t], [{"start": point(at[a + f]), "stop": point(end[a + e]), "coverage": c} for _, c, f, e in spans]))
                if rows:
                    who, names, spans = zip(*rows, strict=True)
                    yield pa.record_batch({"doc_id": batch["doc_id"].take(pa.array(who, pa.int64())), "license": pa.array(names), "coverage": pa.array([max(s["coverage"] for s in x) for x in spans]), "n_spans": pa.array([len(x) for x in spans], pa.int64()), "spans": pa.array(spans, kind)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, coverage double, n_spans long, spans array<struct<start:long,stop:long,coverage:double>>")
