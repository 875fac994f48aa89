"""License scans by patience alignment of a text's words with the words of licence notices.

Words that occur once in the text and once in the notice are anchors; the longest increasing subsequence of them
is kept, and the gaps between anchors are aligned the same way. A gap without anchors is aligned by its common
prefix and suffix and then by the longest common subsequence. The share of the notice's words that are aligned
close together in the text is its coverage. A notice of under SHORT_WORDS words differs from another licence's by a
word or two, so that the words in its brackets, which name the licence, must be there in one run; the others are aligned
outward from there. A short notice without brackets must be there whole and in one run.

Before that, a text is compared with a notice only if it holds enough of the notice's words, counted with
repetition, for the coverage asked: an exact bound, taken for all texts of a slice at once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .arrays import byte_slices, sound, span_hash, text_bytes, words
from .common import batch, id_text, released

COVERAGE = 0.8
SPREAD = 12
SHORT_WORDS = 20

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_FREE = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
_NO_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_AS_IS = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'


def _tag(*ids: str) -> tuple[str, ...]:
    """Machine-readable tags: the identifier follows at once, or after another one and a word."""
    return tuple(t for x in ids for t in (f"[SPDX-License-Identifier: {x}]", f"SPDX-License-Identifier: [OR {x}]", f"SPDX-License-Identifier: [AND {x}]"))


def _creative(name: str, short: str, version: str = "4") -> tuple[str, ...]:
    return (f"Licensed under [{short} {version}].0.", f"This work is licensed under a [Creative Commons {name} {version}].0 International License.", *_tag(f"{short.replace(' ', '-')}-{version}.0"))


#: Licences by their name: whole texts, file headers, one-line notices with the words in brackets that name the licence, tags.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the [Apache License, Version 2].0.", _APACHE, f"{_APACHE} {_APACHE_AS_IS}", "Licensed under the [Apache 2].0 License.", "Released under the [Apache License 2].0.", *_tag("Apache-2.0")),
    "MIT": ("Released under the [MIT License].", "Licensed under the [MIT License].", _MIT_GRANT, f"{_MIT_GRANT} {_AS_IS}", *_tag("MIT")),
    "GPL-3.0": ("This work is licensed under the [GNU General Public License, version 3].", _FREE.format(":", "General", ",", 3), f"{_FREE.format(':', 'General', ',', 3)} {_NO_WARRANTY.format('General')}", *_tag("GPL-3.0")),
    "GPL-2.0": (_FREE.format(";", "General", ";", 2), f"{_FREE.format(';', 'General', ';', 2)} {_NO_WARRANTY.format('General')}", "This work is licensed under the [GNU General Public License, version 2].", *_tag("GPL-2.0")),
    "LGPL-3.0": (_FREE.format(":", "Lesser General", ",", 3), f"{_FREE.format(':', 'Lesser General', ',', 3)} {_NO_WARRANTY.format('Lesser General')}", "This work is licensed under the [GNU Lesser General Public License, version 3].", *_tag("LGPL-3.0")),
    "LGPL-2.1": (_FREE.format(";", "Lesser General", ";", "2.1"), f"{_FREE.format(';', 'Lesser General', ';', '2.1')} {_NO_WARRANTY.format('Lesser General')}", "This work is licensed under the [GNU Lesser General Public License, version 2.1].", *_tag("LGPL-2.1")),
    "AGPL-3.0": (_FREE.format(":", "Affero General", ",", 3), f"{_FREE.format(':', 'Affero General', ',', 3)} {_NO_WARRANTY.format('Affero General')}", "This work is licensed under the [GNU Affero General Public License, version 3].", *_tag("AGPL-3.0")),
    "CC-BY-NC-4.0": _creative("Attribution-NonCommercial", "CC BY-NC"),
    "CC-BY-4.0": _creative("Attribution", "CC BY"),
    "CC-BY-SA-4.0": _creative("Attribution-ShareAlike", "CC BY-SA"),
    "CC-BY-ND-4.0": _creative("Attribution-NoDerivatives", "CC BY-ND"),
    "CC-BY-NC-SA-4.0": _creative("Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA"),
    "CC-BY-NC-ND-4.0": _creative("Attribution-NonCommercial-NoDerivatives", "CC BY-NC-ND"),
    "CC0-1.0": ("To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under [CC0 1].0.", *_tag("CC0-1.0")),
    "BSD-2-Clause": (f"{_BSD_GRANT} {_BSD_AS_IS}", "Licensed under the [BSD 2-Clause License].", *_tag("BSD-2-Clause")),
    "BSD-3-Clause": (f"{_BSD_GRANT} {_BSD_NAMES}", f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_AS_IS}", "Licensed under the [BSD 3-Clause License].", *_tag("BSD-3-Clause")),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the [Mozilla Public License, version 2].0.", *_tag("MPL-2.0")),
    "ISC": (_ISC_GRANT, f"{_ISC_GRANT} {_ISC_AS_IS}", "Licensed under the [ISC License].", *_tag("ISC")),
    "0BSD": (f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_AS_IS}", *_tag("0BSD")),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.", *_tag("Zlib")),
    "BSL-1.0": ("Distributed under the [Boost Software License, Version 1].0.", *_tag("BSL-1.0")),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", *_tag("EPL-2.0")),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        *_tag("Unlicense"),
    ),
    "All-Rights-Reserved": ("[All rights reserved].",),
}

_WORD = regex.compile(r"[0-9a-z\x80-\U0010FFFF]+")


def split(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _lcs(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence by bit vectors over a (the text's gap), one step for each word of b."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, [full]
    for w in b:
        m = where.get(w, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    width = len(a) // 8 + 1
    flat = [r.to_bytes(width, "little") for r in rows]  # a bit of a long number in constant time
    i, j, out = len(a), len(b), []
    while i and j:
        at, bit = i - 1 >> 3, 1 << (i - 1 & 7)
        if flat[j][at] & bit:  # no longer match ends at a[i - 1]
            i -= 1
        elif flat[j - 1][at] & bit:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        else:
            j -= 1
    return out[::-1]


def align(text: list, notice: list) -> list[tuple[int, int]]:
    """Aligned (text word, notice word) places, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(notice))]
    while work:
        a, z, p, q = work.pop()
        while a < z and p < q and text[a] == notice[p]:
            out.append((a, p))
            a, p = a + 1, p + 1
        while a < z and p < q and text[z - 1] == notice[q - 1]:
            z, q = z - 1, q - 1
            out.append((z, q))
        if a >= z or p >= q:
            continue
        wanted = Counter(notice[p:q])
        places: dict = {}
        for i in range(a, z):
            w = text[i]
            if wanted.get(w) == 1:
                places[w] = -1 if w in places else i
        anchors = [(i, j) for j in range(p, q) if wanted[notice[j]] == 1 and (i := places.get(notice[j], -1)) >= 0]
        chain = [anchors[k] for k in increasing([i for i, _ in anchors])]
        if not chain:
            out += [(a + i, p + j) for i, j in _lcs(text[a:z], notice[p:q])]
            continue
        edges = [(a - 1, p - 1), *chain, (z, q)]
        out += chain
        work += [(x + 1, y, s + 1, t) for (x, s), (y, t) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def stretches(pairs: list[tuple[int, int]], spread: int) -> list[list[tuple[int, int]]]:
    """The aligned words, cut wherever more than ``spread`` other words stand between two."""
    cuts = [0, *(k for k in range(1, len(pairs)) if pairs[k][0] - pairs[k - 1][0] > spread + 1), len(pairs)]
    return [pairs[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True) if a < z]


def covers(text: list, notice: list, coverage: float = COVERAGE, spread: int = SPREAD) -> list[tuple[float, int, int]]:
    """(coverage, first word, last word + 1) of the aligned stretches that meet the coverage, by place.

    The whole text is aligned, and also, as words of a notice may occur elsewhere and pull the alignment apart, the
    text around each place of a rare word. One word more is taken than may be missing, so that each stretch that meets
    the coverage holds one of them.
    """
    n = len(notice)
    least = coverage * n - 1e-9
    found = {(s[0][0], s[-1][0] + 1): len(s) for s in stretches(align(text, notice), spread) if len(s) >= least}
    where: dict = {w: [] for w in notice}
    for i, w in enumerate(text):
        if w in where:
            where[w].append(i)
    rare = sorted(where, key=lambda w: (len(where[w]), -len(str(w)), str(w)))[: int(n - least) + 1]
    reach = 2 * n + spread
    done = 0
    for i in sorted(i for w in rare for i in where[w]):
        a, z = max(done, i - reach), min(len(text), i + reach)
        while a <= i < z and z - a >= least:
            near = max(stretches(align(text[a:z], notice), spread), key=len, default=[])
            if len(near) < least:
                break
            first, last = a + near[0][0], a + near[-1][0] + 1
            found[first, last] = len(near)
            if first > i:
                z = first
            else:
                a = done = last
    return [(c / n, x, y) for (x, y), c in sorted(found.items())]


def outward(near: list, notice: list, spread: int) -> list[tuple[int, int]]:
    """Places (in both, from 1) of the most words of the notice that follow in the text, at most ``spread`` others between
    two; of equally many the nearest."""
    chains: list[list[tuple[int, int]]] = [[(0, 0)]]
    for i, w in enumerate(near[: len(notice) * (spread + 1)], 1):
        new = []
        for j, v in enumerate(notice, 1):
            if v == w:
                before = [c for c in chains if c[-1][1] < j and i - c[-1][0] <= spread + 1]
                if before:
                    new.append(max(before, key=len) + [(i, j)])
        chains += new
    return max(chains, key=len)[1:]


def named(text: list, notice: list, core: tuple[int, int], spread: int = SPREAD) -> Iterator[tuple[float, int, int, int, int]]:
    """(coverage, first word, last word + 1, first word and last word + 1 of the core) for each place of a notice's core."""
    p, q = core
    want = notice[p:q]
    for a, w in enumerate(text):
        if w == want[0] and text[a : a + q - p] == want:
            z = a + q - p
            reach = len(notice) * (spread + 1)
            left = outward(text[max(0, a - reach) : a][::-1], notice[:p][::-1], spread)
            right = outward(text[z : z + reach], notice[q:], spread)
            yield (q - p + len(left) + len(right)) / len(notice), a - (left[-1][0] if left else 0), z + (right[-1][0] if right else 0), a, z


class Catalogue:
    """Notices with their words' hashes, for the bound."""

    def __init__(self, notices: dict[str, tuple[str, ...]], short_words: int = SHORT_WORDS):
        every = [(name, t) for name, texts in notices.items() for t in texts if split(t)]
        self.notices = [(name, split(t)) for name, t in every]
        self.cores = [self.core(t, short_words) for _, t in every]
        vocabulary = sorted({w for _, ws in self.notices for w in ws})
        raw = [w.encode() for w in vocabulary]
        at = np.r_[0, np.cumsum([len(w) for w in raw])]
        h = span_hash(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:]) if raw else np.zeros(0, np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        number = {w: i for i, w in enumerate(vocabulary)}
        self.need = np.zeros((len(self.notices), len(vocabulary)), np.int32)
        for k, (_, ws) in enumerate(self.notices):
            for w in ws:
                self.need[k, number[w]] += 1
        self.must = np.zeros_like(self.need)
        for k, core in enumerate(self.cores):
            for w in self.notices[k][1][slice(*core)] if core else ():
                self.must[k, number[w]] += 1
        self.size = np.array([len(ws) for _, ws in self.notices])

    @staticmethod
    def core(notice: str, short_words: int = SHORT_WORDS) -> tuple[int, int] | None:
        """The words of a short notice that must stand in one run: those in brackets, else all; None for a long one."""
        n = len(split(notice))
        if n >= short_words:
            return None
        before, _, rest = notice.partition("[")
        inside = split(rest.partition("]")[0])
        return (len(split(before)), len(split(before)) + len(inside)) if inside else (0, n)

    def possible(self, data: np.ndarray, offsets: np.ndarray, coverage: float) -> Iterator[tuple[int, int]]:
        """(row, notice) whose words can give the coverage."""
        start, end, first = words(data, offsets)
        rows = len(offsets) - 1
        if not len(start) or not len(self.hashes):
            return
        h = span_hash(data, start, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        row = np.searchsorted(first, hit, side="right") - 1
        have = np.bincount(row * len(self.hashes) + self.order[at[hit]], minlength=rows * len(self.hashes)).reshape(rows, -1)
        for k in range(len(self.notices)):
            used = np.flatnonzero(self.need[k])
            got = np.minimum(have[:, used], self.need[k][used][None, :]).sum(axis=1)
            named = (have[:, used] >= self.must[k][used][None, :]).all(axis=1)
            for r in np.flatnonzero((got >= coverage * self.size[k] - 1e-9) & named).tolist():
                yield r, k


def licenses(docs: DataFrame, notices: dict[str, tuple[str, ...]] | None = None, coverage: float = COVERAGE, spread: int = SPREAD, short_words: int = SHORT_WORDS) -> DataFrame:
    """doc_id, license, coverage, start, length: the licences whose notices a text holds, in code points of the text.

    Of a licence's places the best covered that stays counts, the first of equals. A text that holds several licences has
    a row for each; where their stretches (of short notices, the words that name the licence) overlap, only the best covered, of
    equally covered ones that of most words, and its equals. ``notices`` bounds what is found: a licence outside it has no row. A notice of under ``short_words``
    words must have the words that name it (all, where none are marked) in one run; ``coverage`` and ``spread`` hold for
    the rest of it. Texts are searched whole, of any length. Texts without a notice, null and empty texts and an empty
    table have no row; a null doc_id is kept; repeated rows give repeated findings; extra columns are ignored, whatever
    their names. Case and punctuation don't matter. Bytes that aren't UTF-8 count as U+FFFD.
    """
    if not 0 < coverage <= 1:
        raise ValueError("coverage is over 0 and at most 1")
    shared = docs.sparkSession.sparkContext.broadcast(Catalogue(NOTICES if notices is None else notices, short_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book: Catalogue = shared.value
        for b in batches:
            data, off = text_bytes(pc.utf8_lower(sound(b.column("text"))))
            ids = b.column("doc_id")
            for lo, hi in byte_slices(off):
                part, rel = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                found: dict[int, list[tuple[float, int, int, str, int, int, int]]] = {}
                spans: dict[int, list[tuple[str, int, int]]] = {}
                for r, k in book.possible(part, rel, coverage):
                    if r not in spans:
                        text = part[rel[r] : rel[r + 1]].tobytes().decode()
                        spans[r] = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]
                    name, notice = book.notices[k]
                    ws = [w for w, _, _ in spans[r]]
                    if book.cores[k]:
                        places = list(named(ws, notice, book.cores[k], spread))
                    else:
                        places = [(c, x, y, x, y) for c, x, y in covers(ws, notice, coverage, spread)]
                    found.setdefault(r, []).extend((c, round(c * len(notice)), spans[r][x][1], name, spans[r][y - 1][2], spans[r][p][1], spans[r][q - 1][2]) for c, x, y, p, q in places if c >= coverage - 1e-9)
                best: dict[tuple[int, str], tuple[float, int, int]] = {}
                for r, every in found.items():
                    kept: list[tuple[tuple[float, int], str, int, int]] = []
                    for c, m, x, name, y, p, q in sorted(every, key=lambda f: (-f[0], -f[1], f[2])):
                        if not any(d > (c, m) and other != name and p < v and u < q for d, other, u, v in kept):
                            kept.append(((c, m), name, p, q))
                            best.setdefault((r, name), (c, x, y))
                keys = list(best)
                yield batch(
                    doc_id=ids.take(pa.array([lo + r for r, _ in keys], pa.int64())),
                    license=pa.array([name for _, name in keys], pa.string()),
                    coverage=pa.array([round(best[k][0], 6) for k in keys], pa.float64()),
                    start=pa.array([best[k][1] for k in keys], pa.int32()),
                    length=pa.array([best[k][2] - best[k][1] for k in keys], pa.int32()),
                )

    return id_text(docs).mapInArrow(released(run), "doc_id long, license string, coverage double, start int, length int")
