"""Licence scans: passages against templates by Dice over word bigrams.

Text is lower-cased and cut into alphanumeric words.  A passage is a run of
words; its likeness to a template is the Dice coefficient of their bigram
multisets.  At a threshold t only passages of t/(2-t) to (2-t)/t times a
template's bigrams can match it, and at least t/(2-t) of the template's bigrams
must stand in the passage.  A hash bitmap over all template bigrams leaves the
few places where a passage can begin; at each the number of template bigrams
within the longest passage allowed, repeats counted no oftener than in the
template, prunes templates, and the ends of what is left are tried at once by
cumulative sums.  All steps are linear in a text's words for a given template.

The templates are short published texts, notices and statements; more can be
passed.  Bodies of the long licences are found where their notice stands.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kbloom.llm import _text
from kbloom.llm._io import Shared, shielded, table

THRESHOLD = 0.8
_BITS = 20

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GPL = """This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by
the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This {what} is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which
is available at https://www.eclipse.org/legal/epl-2.0/"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution."""
_CC0 = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
work."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""
_CREATIVE = "This work is licensed under a Creative Commons {name} International License."

_GPL_NAME, _LGPL_NAME, _AGPL_NAME = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
#: Licences as statements name them.
NAMES = [
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", f"{_GPL_NAME}, version 2"),
    ("GPL-3.0", f"{_GPL_NAME}, version 3"),
    ("LGPL-2.1", f"{_LGPL_NAME}, version 2.1"),
    ("LGPL-3.0", f"{_LGPL_NAME}, version 3"),
    ("AGPL-3.0", f"{_AGPL_NAME}, version 3"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("Zlib", "zlib License"),
]
#: Other names of licences in statements.
SHORT_NAMES = [
    ("BSD", "BSD License"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Apache 2.0 License"),
    ("GPL-2.0", "GPL version 2"),
    ("GPL-2.0", "GNU GPL v2"),
    ("GPL-3.0", "GPL version 3"),
    ("GPL-3.0", "GNU GPL v3"),
    ("LGPL-2.1", "LGPL version 2.1"),
    ("LGPL-3.0", "LGPL version 3"),
    ("AGPL-3.0", "AGPL version 3"),
    ("MPL-2.0", "MPL 2.0"),
]
#: Identifiers of the SPDX list that a source line may give.
SPDX = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "CC0-1.0", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0"]
_CREATIVE_NAMES = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives")]

_GPL_NOTICES = [("GPL-2.0", "program", _GPL_NAME, 2), ("GPL-3.0", "program", _GPL_NAME, 3), ("LGPL-2.1", "library", _LGPL_NAME, 2.1), ("LGPL-3.0", "program", _LGPL_NAME, 3), ("AGPL-3.0", "program", _AGPL_NAME, 3)]

#: Published licence texts, notices and statements, (licence, text).
TEMPLATES = [
    ("MIT", _MIT),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("ISC", _ISC),
    ("BSD-2-Clause", f"{_BSD2} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD2} {_BSD3} {_BSD_END}"),
    ("Apache-2.0", _APACHE),
    *[(key, _GPL.format(what=what, name=name, v=v)) for key, what, name, v in _GPL_NOTICES],
    ("MPL-2.0", _MPL),
    ("EPL-2.0", _EPL),
    ("BSL-1.0", _BOOST),
    ("Zlib", _ZLIB),
    ("CC0-1.0", _CC0),
    ("Unlicense", _UNLICENSE),
    *[(key, notice[: notice.index("This {what} is distributed")].format(what=what, name=name, v=v)) for notice in [_GPL.replace("This {what} is\ndistributed", "This {what} is distributed")] for key, what, name, v in _GPL_NOTICES],
    *[(key, f"SPDX-License-Identifier: {key}") for key in SPDX],
    *[(key, f"{verb} under the {name}.") for key, name in NAMES + SHORT_NAMES for verb in ("Released", "Licensed", "Distributed")],
    *[(key, f"This work is licensed under the {name}.") for key, name in NAMES if key.startswith("GPL")],
    *[(f"CC-{key}-4.0", f"Licensed under CC {key} 4.0.") for key, _ in _CREATIVE_NAMES],
    *[(f"CC-{key}-4.0", _CREATIVE.format(name=f"{name} 4.0")) for key, name in _CREATIVE_NAMES],
]

_MATCHES = "array<struct<license: string, dice: double, start: int, stop: int>>"


def _hashes(data: np.ndarray, offsets: np.ndarray):
    data = _text.LOWER[data]
    starts, ends, first = _text.split_words(data, offsets, _text.ALNUM_WORDS)
    words = _text.word_hashes(data, starts, ends)
    at = np.arange(max(0, len(words) - 1))
    return data, starts, ends, first, _text.range_hashes(words, _text.FIRST_BASE)(at, at + 2)


class Templates:
    """Bigram multisets of the templates in order of size, and their bitmap."""

    def __init__(self, held: list[tuple[str, str]], threshold: float):
        self.threshold, self.own = threshold, threshold / (2 - threshold)
        rows = []
        for name, text in held:
            raw = np.frombuffer(text.encode(), np.uint8)
            grams = _hashes(raw, np.array([0, len(raw)]))[4]
            if len(grams):
                rows.append((len(grams), name, Counter(grams.tolist())))
        rows.sort(key=lambda r: (r[0], r[1]))
        self.sizes, self.names = [r[0] for r in rows], [r[1] for r in rows]
        self.known = np.unique(np.array([g for r in rows for g in r[2]], np.uint64))
        self.counts = [np.array([r[2].get(g, 0) for g in self.known.tolist()], np.int64) for r in rows]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.known & np.uint64((1 << _BITS) - 1)] = True

    def places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of template bigrams, and which of ``known`` each is."""
        at = np.flatnonzero(self.bitmap[grams & np.uint64((1 << _BITS) - 1)])
        if len(at) == 0:
            return at, at
        which = np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)
        true = self.known[which] == grams[at]
        return at[true], which[true]


class Ends:
    """Passages of one template: where they begin, and the best end of each.

    ``at`` are the positions of the template's bigrams and ``doc`` their rows.
    A bigram counts for a passage if fewer of its kind than the template has
    stand before it in the passage, so if the last but so many lies before it.
    """

    def __init__(self, at: np.ndarray, kind: np.ndarray, doc: np.ndarray, count: np.ndarray, size: int, own: float):
        self.at, self.size = at, size
        order = np.lexsort((at, kind))
        back = np.arange(len(at)) - count[order]
        same = (back >= 0) & (kind[order][np.maximum(back, 0)] == kind[order])
        self.before = np.full(len(at), -1, np.int64)
        self.before[order[same]] = at[order[back[same]]]
        longest = int(size / own + 1e-9)
        self.stop = np.minimum(np.searchsorted(at, at + longest), np.searchsorted(doc, doc, "right"))
        # bigram j counts for starts from low[j] to itself
        low = np.maximum(np.searchsorted(at, np.maximum(self.before, at - longest), "right"), np.searchsorted(doc, doc))
        step = np.bincount(low, minlength=len(at) + 1) - np.bincount(np.arange(len(at)) + 1, minlength=len(at) + 1)
        self.starts = np.flatnonzero(np.cumsum(step[:-1]) >= own * size - 1e-9)

    def best(self, starts: np.ndarray, limit: int | None = None):
        """(dice, end, shared bigrams) for each start: the likest passage, the longest of equals.

        An end is the index of the last bigram; passages end before the word ``limit``.
        """
        stop = self.stop[starts]
        if limit is not None:
            stop = np.minimum(stop, np.searchsorted(self.at, limit - 1))
        dice, ends, shared = np.zeros(len(starts)), starts.copy(), np.zeros(len(starts), np.int64)
        width = max(1, int((stop - starts).max(initial=0)))
        block = max(1, (1 << 20) // width)
        for lo in range(0, len(starts), block):
            s = starts[lo : lo + block]
            j = s[:, None] + np.arange(width)
            inside = j < stop[lo : lo + len(s), None]
            j = np.minimum(j, len(self.at) - 1)
            first = self.at[s][:, None]
            both = np.cumsum(inside & (self.before[j] < first), axis=1)
            value = np.where(inside, 2 * both / (self.at[j] - first + 1 + self.size), 0.0)
            k = width - 1 - value[:, ::-1].argmax(1)
            own = np.arange(len(s)), k
            dice[lo : lo + len(s)], ends[lo : lo + len(s)], shared[lo : lo + len(s)] = value[own], s + k, both[own]
        return dice, ends, shared


def _matches(templates: Templates, at: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> dict[int, list[tuple]]:
    """Non-overlapping passages (start, stop, licence, dice) of each row, in words.

    What shares the most bigrams with its template goes first, so a notice isn't
    split by a statement that is a part of it.
    """
    waiting: dict[int, list] = {}
    found = []
    for k, (size, count) in enumerate(zip(templates.sizes, templates.counts, strict=True)):
        mine = np.flatnonzero(count[kind] > 0)
        if len(mine) < templates.own * size - 1e-9:
            found.append(None)
            continue
        ends = Ends(at[mine], kind[mine], doc[mine], count[kind[mine]], size, templates.own)
        found.append(ends)
        dice, stop, shared = ends.best(ends.starts)
        for i in np.flatnonzero(dice >= templates.threshold).tolist():
            s, e = int(ends.starts[i]), int(stop[i])
            a, b = int(ends.at[s]), int(ends.at[e]) + 2
            waiting.setdefault(int(doc[mine[s]]), []).append((-int(shared[i]), -float(dice[i]), a - b, a, templates.names[k], k, s, b))
    out = {}
    for row, heap in waiting.items():
        heapq.heapify(heap)
        begun, taken = [], []
        while heap:
            _, dice, _, a, name, k, s, b = heapq.heappop(heap)
            i = bisect_right(begun, a)
            if i and taken[i - 1][1] > a:
                continue
            if i < len(begun) and begun[i] < b:
                # the end is taken: the best passage up to there waits instead
                new, e, both = found[k].best(np.array([s]), begun[i])
                if new[0] >= templates.threshold:
                    b = int(found[k].at[e[0]]) + 2
                    heapq.heappush(heap, (-int(both[0]), -float(new[0]), a - b, a, name, k, s, b))
                continue
            begun.insert(i, a)
            taken.insert(i, (a, b, name, -dice))
        out[row] = taken
    return out


def _scan(shared: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates: Templates = shared.once(lambda x: Templates(*x))
        for batch in batches:
            for lo, hi, data, offsets in _text.chunks(batch.column(0)):
                _, _, _, first, grams = _hashes(data, offsets)
                matches = [[] for _ in range(hi - lo)]
                at, kind = templates.places(grams)
                doc = np.searchsorted(first, at, "right") - 1
                within = at + 1 < first[doc + 1]
                for r, got in _matches(templates, at[within], kind[within], doc[within]).items():
                    matches[r] = [{"license": name, "dice": dice, "start": int(a - first[r]), "stop": int(b - first[r])} for a, b, name, dice in got]
                part = batch.slice(lo, hi - lo)
                kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(matches, kind), *part.columns[1:]], ["matches", *part.schema.names[1:]])

    return run


def scan(spark: SparkSession, docs: DataFrame, others: list[str], templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """matches and the columns ``others`` of each row.

    A match has its licence, its Dice coefficient and its range of words.
    Matches of a row don't overlap: what shares the most bigrams with its template
    goes first, then the likest, the longer, the earlier, then the one whose
    licence is first by name.  Null and empty
    texts, and texts of one word, match nothing.  A column of ``others`` that is
    itself called matches is ``_kept_matches``.
    """
    docs, old = shielded(docs.select("text", *[c for c in others if c != "text"]), "matches")
    now = {v: k for k, v in old.items()}
    others = [now.get(c, c) for c in others]
    schema = StructType([*StructType.fromDDL(f"matches {_MATCHES}").fields, *(docs.schema[c] for c in others)])
    return docs.select("text", *others).mapInArrow(_scan(Shared(spark, (templates, threshold))), schema)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its matches, their licences and the best one.

    Of matches of equal Dice the licence that is first by name is the best.
    """
    found = scan(spark, table(spark, sf_dir, "documents"), ["doc_id"])
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("l"))))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        best["l"].alias("license"),
        (-best["d"]).alias("dice"),
    )
