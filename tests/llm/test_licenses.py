"""Licence passages against brute force, and their running time."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from kbloom.llm import _text, licenses


def brute(words, held, threshold=0.8):
    """Choice one by one: for each free start and template the likest passage, of these the one that shares most."""
    sides = []
    for name, text in held:
        t = text.split()
        sides.append((name, Counter(zip(t, t[1:], strict=False)), len(t) - 1))
    taken = []
    while True:
        found = []
        for name, other, size in sides:
            for a in range(len(words)):
                if any(x <= a < y for x, y, *_ in taken):
                    continue
                best = None
                for b in range(a + 2, min([x for x, *_ in taken if x > a], default=len(words)) + 1):
                    own = Counter(zip(words[a:b], words[a + 1 : b], strict=False))
                    both = sum((own & other).values())
                    best = max(best or (0, 0, 0), (2 * both / (b - a - 1 + size), b - a, both))
                if best and best[0] >= threshold:
                    found.append((-best[2], -best[0], -best[1], a, name))
        if not found:
            return sorted(taken)
        _, dice, n, a, name = min(found)
        taken.append((a, a - n, name, -dice))


def matches(texts, templates):
    """What the scan gives for each text of one chunk."""
    out = []
    for lo, hi, data, offsets in _text.chunks(pa.array(texts)):
        _, _, _, first, grams = licenses._hashes(data, offsets)
        at, kind = templates.places(grams)
        doc = np.searchsorted(first, at, "right") - 1
        within = at + 1 < first[doc + 1]
        got = licenses._matches(templates, at[within], kind[within], doc[within])
        out += [[(a - int(first[r]), b - int(first[r]), n, d) for a, b, n, d in got.get(r, [])] for r in range(hi - lo)]
    return out


def test_choice_equals_brute_force():
    r = random.Random(7)
    held = [("a", "one two three four five six"), ("b", "one two four five"), ("c", "six five four three two one zero"), ("d", "two three"), ("e", "one two one two one two three"), ("a2", "one two three four five six")]
    templates = licenses.Templates(held, 0.8)
    words = "one two three four five six zero".split()
    texts = []
    for k in range(200):
        text = []
        while len(text) < r.randint(0, 30):
            text += r.choice(held)[1].split()[r.randrange(3) :] if r.random() < 0.4 else [r.choice(words)]
        texts.append(" ".join(text[:40]))
    assert matches(texts, templates) == [brute(t.split(), held) for t in texts]
    for threshold in (0.6, 0.9):
        assert matches(texts[:60], licenses.Templates(held, threshold)) == [brute(t.split(), held, threshold) for t in texts[:60]]


def test_statements_in_running_text_and_nearest_families():
    templates = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    text = lambda x: [m[2] for m in matches([x], templates)[0]]
    assert text("We know that this package is released under the MIT License. It has more to it.") == ["MIT"]
    assert text("this software is licensed under the mit license and nothing else") == ["MIT"]
    assert text("# SPDX-License-Identifier: Apache-2.0\nimport os") == ["Apache-2.0"]
    assert text("SPDX-License-Identifier: GPL-3.0-or-later") == ["GPL-3.0"]
    assert text("It is licensed under the Apache License 2.0 by us") == ["Apache-2.0"]
    assert text("Licensed under the GPL version 3") == ["GPL-3.0"]
    assert text("Licensed under the BSD License") == ["BSD"]
    assert text(licenses._BSD2 + " " + licenses._BSD_END) == ["BSD-2-Clause"]
    changed = licenses._APACHE.replace("limitations", "limits").replace("compliance", "agreement")
    assert [m[2] for m in matches([changed], templates)[0]] == ["Apache-2.0"]
    assert text("the licence of the house is under the stairs") == []
    for key, held in licenses.TEMPLATES:
        assert text(f"some words. {held} other words") == [key], held
        assert text("Foreword\n" + held.upper().replace(" ", "\n * ")) == [key], held
    assert matches(["", "license", "a b"], templates) == [[], [], []]


def test_long_dumps_take_seconds():
    templates = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    line = "Licensed under the MIT License.\n"
    dump = line * ((1 << 18) // len(line))
    began = time.process_time()
    (got,) = matches([dump], templates)
    assert len(got) == dump.count("\n") and {m[2] for m in got} == {"MIT"}
    assert time.process_time() - began < 15
    words = licenses._MIT.split()
    r = random.Random(1)
    cuts = []
    while sum(map(len, cuts)) < 1 << 18:
        k = r.randrange(len(words) - 1)
        cuts.append(f"{words[k]} {words[k + 1]}\n")
    began = time.process_time()
    matches(["".join(cuts)], templates)
    whole = (licenses._MIT + "\n") * 200
    assert len(matches([whole], templates)[0]) == 200
    assert time.process_time() - began < 15
