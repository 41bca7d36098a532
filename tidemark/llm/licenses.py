"""License scans by patience alignment of a text's words with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

# Wordings of licenses, of the notices that name them, and names of the SPDX list.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License v3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "Licensed under the GNU General Public License v2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", "{BSD} {BSD_END}"),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License",
        "{BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. {BSD_END}",
    ),
    "ISC": (
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not "
        "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. This notice may not be removed or altered from any source distribution.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Licensed under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
    "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY "
    "OF SUCH DAMAGE."
)
TEMPLATES = {name: tuple(t.replace("{BSD}", BSD).replace("{BSD_END}", BSD_END) for t in texts) for name, texts in TEMPLATES.items()}
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 "
    "CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only "
    "GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA ODbL-1.0 OFL-1.1 PSF-2.0 Python-2.0 "
    "Unlicense UPL-1.0 WTFPL Zlib"
).split()
for _name in SPDX:  # versions without "only" or "or later" in the licenses' own names
    _license = _name.removesuffix("-only").removesuffix("-or-later")
    TEMPLATES[_license] = (*TEMPLATES.get(_license, ()), f"SPDX-License-Identifier: {_name}")
PLAIN = re.compile(rb"[a-z0-9]+(?:\.[0-9]+)*")
WORDS = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

#: Share of a template that a notice covers, and of a template of LONG words or more that a part of it covers.
COVERAGE, PART, LONG = 0.85, 0.3, 30
#: A gap may be so many times the template's words longer than the template.
SLACK = 0.25
#: Words of an anchor.
ANCHOR = 3


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word in lower case, start, end) of a text; numbers keep their points."""
    return [(m[0].lower(), m.start(), m.end()) for m in WORDS.finditer(text)]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places at which a and b are aligned, rising in both.

    Equal ends are paired; between them the words that occur once in both are anchors where they form the longest rising
    sequence, and each gap between anchors is aligned in the same way.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        once_a, once_b = ({w for w, n in Counter(x).items() if n == 1} for x in (a[i:j], b[k:m]))
        at = {w: k + y for y, w in enumerate(b[k:m]) if w in once_b}
        pairs = [(x, at[a[x]]) for x in range(i, j) if a[x] in once_a and a[x] in at]
        anchors = longest_rising(pairs)
        edges = [(i - 1, k - 1), *anchors, (j, m)]
        out += anchors
        if anchors:
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, which rise in their first place, that rises in the second: patience piles with links back."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(ends[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [y]
        ends[pile : pile + 1] = [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


@lru_cache(maxsize=1)
def _templates() -> tuple[list[tuple[str, list[str]]], dict[tuple, list[tuple[int, int]]], frozenset[bytes]]:
    """Templates as words, the (template, place) of each run of ANCHOR words that a template has once, and those runs' rarest words.

    Runs without a word of six letters are too common to be anchors. The rarest word of a run is, of those long ones, the
    longest that fewest templates have. A text without any of them has no anchor.
    """
    every = [(name, [w for w, _, _ in words_of(t)]) for name, texts in TEMPLATES.items() for t in texts]
    spread = Counter(w for _, words in every for w in set(words))
    at: dict[tuple, list[tuple[int, int]]] = {}
    rare = set()
    for k, (_, words) in enumerate(every):
        runs = [tuple(words[p : p + ANCHOR]) for p in range(len(words) - ANCHOR + 1)]
        count = Counter(runs)
        for p, run in enumerate(runs):
            long = [w for w in run if len(w) >= 6]
            if count[run] == 1 and long:
                at.setdefault(run, []).append((k, p))
                rare.add(min(long, key=lambda w: (spread[w], -len(w), w)).encode())
    return every, at, frozenset(rare)


def scan(text: str, coverage: float = COVERAGE, part: float = PART) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of the notices in a text, by start; places are code points.

    Runs of words that are unique in a template and in what it is laid over anchor it: runs on about the same diagonal are
    one window, and the patience alignment of window and template covers a share of the template. Shares of `coverage` are
    notices; of templates of LONG words or more, shares of `part` are parts of one and are given with what they cover. Of
    overlapping notices that with the most words covered stays, of equal ones that of which more is covered.
    """
    every, at, _ = _templates()
    found = words_of(text)
    plain = [w for w, _, _ in found]
    votes: dict[int, list[tuple[int, int]]] = {}
    for p in range(len(plain) - ANCHOR + 1):
        for k, offset in at.get(tuple(plain[p : p + ANCHOR]), ()):
            votes.setdefault(k, []).append((p - offset, p))
    hits = []
    for k, places in votes.items():
        name, words = every[k]
        slack = max(1, int(SLACK * len(words)))
        for low, high in _windows(sorted(places), slack):
            begin = max(0, low - slack)
            pairs = patience(words, plain[begin : high + len(words) + slack])
            share = len(pairs) / len(words)
            if share >= (min(part, coverage) if len(words) >= LONG else coverage):
                first, last = begin + pairs[0][1], begin + pairs[-1][1]
                if last - first < (1 + SLACK) * (pairs[-1][0] - pairs[0][0] + 1) + 1:
                    hits.append((-len(pairs), -share, first, name, found[first][1], found[last][2], last))
    kept: list[tuple] = []
    spans: list[tuple[int, int]] = []
    for _, share, first, name, start, end, last in sorted(hits):
        k = bisect_left(spans, (first, -1))
        if (k and spans[k - 1][1] >= first) or (k < len(spans) and spans[k][0] <= last):
            continue
        spans.insert(k, (first, last))
        kept.append((name, -share, start, end))
    return sorted(kept, key=lambda x: (x[2], x[0]))


def _windows(places: list[tuple[int, int]], slack: int) -> list[tuple[int, int]]:
    """(least, greatest) diagonal of each group of anchors, which are sorted, that lie within `slack` of the group's first."""
    out: list[list[int]] = []
    for diagonal, _ in places:
        if out and diagonal - out[-1][0] <= slack:
            out[-1][1] = diagonal
        else:
            out.append([diagonal, diagonal])
    return [(a, b) for a, b in out]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Per row of docs: doc_id, notices: array<struct<license, coverage, start, end>> by start.

    Texts without any word that an anchor needs are settled by their set of words. Null and empty texts have no notices.
    Of notices that overlap the better one counts; a coverage under the given one is that of a part of a long license. Rows that repeat an id or a text have a result each; other columns,
    whatever their names, are ignored. One narrow pass: nothing is shuffled.
    """
    kind = dict(docs.dtypes)[id_col]

    def make(cols):
        out, (_, _, rare) = [], _templates()
        for t in cols["text"].to_pylist():
            hits = scan(t.decode(errors="replace"), coverage) if t and not rare.isdisjoint(PLAIN.findall(t.lower())) else []
            out.append([{"license": n, "coverage": c, "start": s, "end": e} for n, c, s, e in hits])
        return {"doc_id": cols["doc_id"], "notices": out}

    return in_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")), make, f"doc_id {kind}, notices array<struct<license:string,coverage:double,start:bigint,end:bigint>>")
