"""License scans by patience alignment.

Words that occur once in a template and once in the stretch of text beside it are anchors; the longest run of anchors in
the same order in both is kept, and the gaps between them are aligned in the same way. Coverage is the share of the
template's words that are matched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatedframe.llm.words import ASCII_LOWER, pieces, utf8

#: Least coverage that counts as a find.
COVERAGE = 0.8

#: What permissive licenses end with.
MIT_WARRANTY = "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
BSD_WARRANTY = "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
ISC_WARRANTY = "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."

#: Notices and texts of widespread licenses. Of those that run to many pages there are the notices that they tell users to add.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "Zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": ["Licensed under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3"],
    "LGPL-2.1": ["licensed under the GNU Lesser General Public License, version 2.1"],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"],
}
for _name, _grant, _end in (("MIT", 2, MIT_WARRANTY), ("BSD-3-Clause", 0, BSD_WARRANTY), ("BSD-2-Clause", 0, BSD_WARRANTY), ("ISC", 0, ISC_WARRANTY), ("BSL-1.0", 0, MIT_WARRANTY)):
    TEMPLATES[_name].append(f"{TEMPLATES[_name][_grant]} {_end}")

#: Words that set licenses apart: a find matches each of these that its template has, ...
MARKS = frozenset(b"mit apache cc0 gnu lesser affero mozilla cc nc sa nd creative commons noncommercial sharealike noderivatives endorse promote 1 2 3 4 0".split())
#: ... and has none of these among its first to last mark that the template hasn't.
OTHERS = MARKS - frozenset(b"cc creative commons endorse promote".split()) | frozenset(b"commercial alike derivatives".split())

WORD = regex.compile(rb"[a-z0-9]+")


def _longest_rise(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence (patience sorting)."""
    tops, piles, back = [], [], []
    for k, v in enumerate(values):
        at = bisect_left(tops, v)
        tops[at : at + 1] = [v]
        piles[at : at + 1] = [k]
        back.append(piles[at - 1] if at else -1)
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(template: list[bytes], text: list[bytes]) -> list[tuple[int, int]]:
    """Matched places (in the template, in the text), rising in both."""
    pairs, gaps = [], [(0, len(template), 0, len(text))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and template[a] == text[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(template[a:b]), Counter(text[c:d])
        place = {text[k]: k for k in range(c, d) if right[text[k]] == 1}
        anchors = [(k, place[template[k]]) for k in range(a, b) if left[template[k]] == 1 and template[k] in place]
        kept = [anchors[k] for k in _longest_rise([y for _, y in anchors])]
        if not kept:
            continue
        pairs += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(pairs)


@dataclass(frozen=True)
class _Template:
    name: str
    words: list[bytes]
    marks: frozenset[bytes]
    #: Places of words of which every find matches one.
    keys: dict[bytes, list[int]]
    #: Texts with fewer of the template's distinct words aren't aligned; a find has more.
    distinct: int
    vocabulary: frozenset[bytes]


def _prepared(coverage: float = COVERAGE) -> list[_Template]:
    made = [(name, WORD.findall(text.lower().encode())) for name, texts in TEMPLATES.items() for text in texts]
    common = Counter(w for _, words in made for w in set(words))
    out = []
    for name, words in made:
        missed = max(k for k in range(len(words) + 1) if k == 0 or (len(words) - k) / len(words) >= coverage)
        times = Counter(words)
        marks = frozenset(w for w in times if w in MARKS or (w == b"by" and b"cc" in times))
        if marks:
            chosen = {min(marks, key=lambda w: (len(w) < 2, common[w], w))}
        else:  # more places than a find can miss, those of the rarer words first
            chosen, n = set(), 0
            for w in sorted(times, key=lambda w: (common[w], -len(w), w)):
                if n > missed:
                    break
                chosen.add(w)
                n += times[w]
        keys = {w: [k for k, x in enumerate(words) if x == w] for w in chosen}
        out.append(_Template(name, words, marks, keys, len(times) - missed if marks else len(times) // 2, frozenset(times)))
    return out


def _laid(template: list[bytes], words: list[bytes], at: int, place: int, spare: int) -> list[tuple[int, int]]:
    """Alignment in which word ``place`` of the template meets word ``at``, with ``spare`` words more to either side."""
    lo, hi = max(0, at - place - spare), at + len(template) - place + spare
    left = align(template[:place], words[lo:at])
    right = align(template[place + 1 :], words[at + 1 : hi])
    return [*((a, lo + b) for a, b in left), (place, at), *((place + 1 + a, at + 1 + b) for a, b in right)]


def scan(text: bytes, prepared: list[_Template], coverage: float = COVERAGE) -> tuple[int, list[tuple[float, int, str, int, int]]]:
    """(words, best find of each license: coverage, matched words, name, first and behind last word).

    A template is laid beside the text so that a key word of the template meets the same word of the text, once with a
    quarter of its length to spare at either end and once with all of it, for insertions. A find of another license whose
    marks (without any, most of whose matched words) are all matched by a find of more words is none.
    """
    words = WORD.findall(text.translate(ASCII_LOWER))
    present, where = frozenset(words), {}
    hopeful = [t for t in prepared if len(t.vocabulary & present) >= t.distinct and t.marks <= present]
    wanted = {w for t in hopeful for w in t.keys}
    if wanted:
        for k, w in enumerate(words):
            if w in wanted:
                where.setdefault(w, []).append(k)
    partial: dict[str, tuple[float, int, str, int, int]] = {}
    finds: dict[tuple[str, tuple[int, ...]], tuple[int, int, int, float, frozenset[int]]] = {}
    for t in hopeful:
        n, done = len(t.words), set()
        for word, places in t.keys.items():
            for at, place in ((a, p) for a in where.get(word, ()) for p in places):
                if at - place in done:
                    continue
                for spare in (n // 4 + 1, n):
                    pairs = _laid(t.words, words, at, place, spare)
                    marked = [b for a, b in pairs if t.words[a] in t.marks]
                    if not t.marks <= {words[b] for b in marked}:
                        continue
                    if marked and not OTHERS.isdisjoint(set(words[marked[0] : marked[-1] + 1]) - t.marks):
                        continue
                    cover, first, last = len(pairs) / n, pairs[0][1], pairs[-1][1] + 1
                    if cover >= coverage:
                        spots = tuple(b for _, b in pairs)
                        finds.setdefault((t.name, spots), (len(pairs), first, last, cover, frozenset(marked)))
                        if cover == 1:
                            done.add(at - place)
                            break
                    elif (cover, len(pairs)) > partial.get(t.name, (0.0, 0))[:2]:
                        partial[t.name] = (cover, len(pairs), t.name, first, last)
    best: dict[str, tuple[float, int, str, int, int]] = {}
    owner: dict[int, set[str]] = {}
    for (name, spots), (n, first, last, cover, marked) in sorted(finds.items(), key=lambda f: (-f[1][0], -f[1][3], f[0])):
        held = marked or spots
        by = Counter(o for k in held for o in owner.get(k, ()) if o != name)
        if any(c == len(held) if marked else c >= 0.8 * len(held) for c in by.values()):
            continue
        for k in spots:
            owner.setdefault(k, set()).add(name)
        if (cover, n) > best.get(name, (0.0, 0))[:2]:
            best[name] = (cover, n, name, first, last)
    return len(words), list(best.values()) or list(partial.values())


def license_scan(docs: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, matched_words, start_word, end_word, licenses) for every row of ``docs``.

    ``licenses`` holds the names found with at least ``coverage``, sorted; ``license`` is that of the highest coverage, then of most
    matched words, then the first by name, with where it lies among the text's words (letters a-z and digits). Without a find
    they are null and ``coverage`` is the best that was reached by a template whose marks are all matched (of one without marks, if half of its words are there). A null text counts as empty, a null id stays null, and texts
    of any length are scanned whole. Repeated rows each get a row, an empty table gives none, and other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = _prepared(coverage)
        for batch in pieces(batches):
            rows = []
            for text in utf8(batch.column(1)):
                _, finds = scan(text, prepared, coverage)
                finds.sort(key=lambda f: (-f[0], -f[1], f[2]))
                good = [f for f in finds if f[0] >= coverage]
                top = good[0] if good else (finds[0][0] if finds else 0.0, None, None, None, None)
                rows.append((top[2], top[0], top[1], top[3], top[4], sorted(f[2] for f in good)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            labels = ["doc_id", "license", "coverage", "matched_words", "start_word", "end_word", "licenses"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], labels)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, license string, coverage double, matched_words long, start_word long, end_word long, licenses array<string>")
