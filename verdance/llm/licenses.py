"""License scans by patience alignment.

Words that occur once in a stretch of text and once in a template anchor an
alignment; the longest increasing subsequence of anchors is kept, and the gaps
between anchors are aligned in turn.  Gaps without anchors take their common
rims and a longest common subsequence.  A template is found where the
aligned words cover at least ``COVERAGE`` of it.

Where to align: a covered stretch must hold one of a template's trigger words,
chosen so that the words left over are fewer than the coverage asks for.  Around
each trigger, windows that place it where the template has it are aligned, with
growing slack on either side, if they share enough words, counted with repeats,
with the template: a bound on any alignment.  The work is linear in the text.

What counts: of an alignment the stretch with most aligned words that fill at
least ``DENSITY`` of it.  The words that name a license and its version
(``NAMES``) must be aligned; a word that makes another license of it
(``MODIFIERS``) must not stand between aligned words, nor a negation between
those of a short notice or among the three words before it in its sentence:
``not licensed under ...`` is no finding.

Defined results: whole texts are scanned; null and blank texts have no finding
and so no row; repeated rows give their findings once each; null ids are kept;
of overlapping findings the one with more aligned words is reported, ties going
to the shorter, the earlier, then to the name that sorts first; an empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

COVERAGE = 0.8
#: Least share of a finding's words that are aligned.
DENSITY = 0.6
#: Words beyond which a template is no short notice.
SHORT = 40

# Public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause-notice": "Released under the BSD 2-Clause License.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        'to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF '
        "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the "
        "License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "LGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
}
# The words of each template that name the license and its version.
NAMES = {
    "MIT-notice": "mit", "Apache-2.0-notice": "apache 2 0", "GPL-3.0-notice": "general public 3", "GPL-2.0-notice": "general public 2",
    "LGPL-3.0-notice": "lesser 3", "AGPL-3.0-notice": "affero 3", "CC-BY-NC-4.0-notice": "cc by nc 4 0", "CC-BY-4.0-short": "cc by 4 0",
    "CC-BY-SA-4.0-short": "cc by sa 4 0", "CC-BY-ND-4.0-short": "cc by nd 4 0", "CC-BY-NC-SA-4.0-short": "cc by nc sa 4 0",
    "CC-BY-NC-ND-4.0-short": "cc by nc nd 4 0", "CC0-1.0-notice": "cc0 1 0", "BSD-3-Clause-notice": "bsd 3", "BSD-2-Clause-notice": "bsd 2",
    "CC-BY-4.0-notice": "creative commons attribution 4 0", "CC-BY-SA-4.0-notice": "creative commons attribution sharealike 4 0",
    "MPL-2.0": "mozilla 2 0", "Apache-2.0": "apache 2 0", "GPL-3.0-or-later": "3", "GPL-2.0-or-later": "2", "LGPL-2.1-or-later": "lesser 2 1",
    "LGPL-3.0-or-later": "lesser 3", "AGPL-3.0-or-later": "affero 3",
}
# Words that make another license of a named one, and words that deny.
MODIFIERS = frozenset("nc nd sa noncommercial noderivatives noderivs sharealike lesser library affero".split())
NEGATIONS = frozenset("not never neither nor no isn aren wasn weren without unless except".split())

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of pairs, given by first place, whose second places increase (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before[n] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(j)
            piles.append(n)
        else:
            tops[at], piles[at] = j, n
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence by dynamic programming."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of equal words, increasing in both; gaps wait on a stack, so depth is no limit."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ours, theirs = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if theirs[w] == 1}
        chain = increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if ours[w] == 1 and w in place])
        if not chain:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        out += chain
        i0, j0 = a0, b0
        for i, j in chain:
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    return sorted(out)


class Template:
    """A license text with its words, triggers and the words it must have aligned."""

    def __init__(self, name: str, text: str, coverage: float, names: str = ""):
        self.name, self.words = name, words_of(text)
        self.need = max(1, math.ceil(coverage * len(self.words) - 1e-9))
        self.counts = counts = Counter(self.words)
        self.must = Counter(words_of(names))
        held, self.triggers = 0, []
        for word in sorted(counts, key=lambda w: (-len(w), w)):
            if held > len(self.words) - self.need:
                break
            self.triggers.append(word)
            held += counts[word]
        self.known = set(self.words)
        self.at = {w: [i for i, x in enumerate(self.words) if x == w] for w in self.triggers}
        #: Words between the ends of an alignment that void it, unless they are aligned.
        self.void = MODIFIERS | NEGATIONS if len(self.words) < SHORT else MODIFIERS


def dense_part(places: list[int], need: int, density: float) -> tuple[int, int] | None:
    """``i, j``: the run of ascending places with most of them that fill ``density`` of its stretch; then the shortest, the first."""
    best = None
    for i in range(len(places) - need + 1):
        if best and len(places) - i < best[0]:
            break
        for j in range(len(places) - 1, i + max(need, best[0] if best else 0) - 2, -1):
            if j - i + 1 >= density * (places[j] - places[i] + 1):
                key = (j - i + 1, places[i] - places[j], -i)
                best = max(best, key) if best else key
                break
    return (-best[2], -best[2] + best[0] - 1) if best else None


class Scanner:
    """Finds templates in texts."""

    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE, density: float = DENSITY, names: dict[str, str] | None = None):
        names = NAMES if names is None and templates is None else names or {}
        self.density = density
        self.templates = [Template(n, t, coverage, names.get(n, "")) for n, t in (templates or TEMPLATES).items() if words_of(t)]
        self.triggers = sorted({w for t in self.templates for w in t.triggers})
        self.known = {w for t in self.templates for w in t.known}

    def judged(self, words: list[str], low: int, high: int, template: Template) -> tuple[int, int, int, int, int] | None:
        """``aligned, first, last`` of the template in ``words[low:high]`` and the template's first and last aligned word, if it counts."""
        pairs = align(words[low:high], template.words)
        part = dense_part([i for i, _ in pairs], template.need, self.density)
        if part is None:
            return None
        pairs = pairs[part[0] : part[1] + 1]
        first, last = low + pairs[0][0], low + pairs[-1][0] + 1
        if template.must and template.must - Counter(template.words[j] for _, j in pairs):
            return None
        aligned = {low + i for i, _ in pairs}
        if any(words[i] in template.void and i not in aligned for i in range(first, last)):
            return None
        return len(pairs), first, last, pairs[0][1], pairs[-1][1]

    def _found(self, words: list[str], template: Template, places: dict[str, list[int]]) -> Iterator[tuple[str, int, int, int, int]]:
        size, done = len(template.words), 0
        slack = math.ceil(size / self.density) - size
        known = sorted(i for w in template.known for i in places.get(w, ()))

        def possible(low: int, high: int) -> bool:
            if bisect_right(known, high - 1) - bisect_left(known, low) < template.need:
                return False
            here = Counter(words[low:high])
            return sum(min(n, here[w]) for w, n in template.counts.items()) >= template.need

        for hit, word in sorted((i, w) for w in template.triggers for i in places.get(w, ())):
            spots = template.at[word]
            if hit < done or not possible(max(done, hit - spots[-1] - slack), hit - spots[0] + size + slack):
                continue
            best, todo, seen = None, [(hit - at - more, hit - at + size + more) for at in spots for more in (0, slack // 4, slack)], set()
            for low, high in todo:
                low, high = max(done, low), min(len(words), high)
                if (low, high) in seen or not possible(low, high):
                    continue
                seen.add((low, high))
                got = self.judged(words, low, high, template)
                if got and (best is None or (got[0], got[1] - got[2], -got[1]) > (best[0], best[1] - best[2], -best[1])):
                    best = got  # then where the rest of the template would be
                    todo.append((got[1] - got[3] - slack // 4, got[2] + size - got[4] + slack // 4))
                    todo.append((got[1] - got[3] - slack, got[2] + size - got[4] + slack))
                if best and best[0] == best[2] - best[1] == size:
                    break
            if best:
                done = best[2]
                yield template.name, best[1], best[2], best[0], size

    def findings(self, text: str | None) -> list[tuple[str, int, int, int, int]]:
        """``(name, start, end, aligned words, template words)``, places in code points, by start."""
        text = text or ""
        low = text.lower()
        if not any(w in low for w in self.triggers):
            return []
        spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [text[i:j].lower() for i, j in spans]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.known:
                places.setdefault(w, []).append(i)
        found = [f for t in self.templates if any(w in places for w in t.triggers) for f in self._found(words, t, places)]
        found = [f for f in found if not denied(text[max(0, spans[f[1]][0] - 60) : spans[f[1]][0]])]
        kept: list[tuple[int, int, str, int, int]] = []  # by start; none overlap
        for name, first, last, got, size in sorted(found, key=lambda f: (-f[3], f[2] - f[1], f[1], f[0])):
            at = bisect_left(kept, (first,))
            if (at == 0 or kept[at - 1][1] <= first) and (at == len(kept) or last <= kept[at][0]):
                kept.insert(at, (first, last, name, got, size))
        return [(name, spans[first][0], spans[last - 1][1], got, size) for first, last, name, got, size in kept]


def denied(before: str) -> bool:
    """Whether one of the last three words of the sentence that ``before`` ends in denies what follows."""
    return not NEGATIONS.isdisjoint(words_of(_SENTENCE.split(before)[-1])[-3:])


_SENTENCE = re.compile(r"[.!?;:\n]")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE, density: float = DENSITY) -> DataFrame:
    """One row per finding: ``id_col, license, start, end, matched, words, coverage``."""
    source = docs.select(id_col, F.col(text_col).alias("__text"))
    names = [id_col, "license", "start", "end", "matched", "words", "coverage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage, density)
        for batch in batches:
            found = [(i, *f) for i, text in enumerate(batch.column(1)) for f in scanner.findings(text.as_py())]
            if found:
                at, name, start, end, got, size = zip(*found)
                columns = [batch.column(0).take(pa.array(at)), pa.array(name), *(pa.array(c, pa.int64()) for c in (start, end, got, size))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([g / s for g, s in zip(got, size)])], names)

    fields = [source.schema.fields[0], T.StructField("license", T.StringType()), *(T.StructField(n, T.LongType()) for n in names[2:6]), T.StructField("coverage", T.DoubleType())]
    return map_arrow(source, run, T.StructType(fields))
