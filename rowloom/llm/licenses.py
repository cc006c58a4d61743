"""License scans by conditional compression.

Texts with a trigger word are cut into sentences. Sentences with a trigger,
and those between two that are at most ``GAP`` apart, form candidate blocks.
Blocks are widened by the words of the longest template on both sides, across
lines, since notices over many lines reach beyond them. Every wide block is
compressed alone and with each template as a raw zstandard dictionary, and
templates are ranked by how much they shorten it. All that do are aligned in
it, as often as they occur. What a template covers is compressed with it in
turn and confirmed by its exact words: those of the template that it lacks, in
order, and those that it puts between. Up to ``DIFFERENT`` of the template's
words may differ, but no version number and no word that tells variants apart.
A block that its template confirms only as a whole is returned whole.

Names with their versions (``MIT License``, ``CC BY-SA 4.0``), whatever their
case, and identifiers behind ``SPDX-License-Identifier:``, each of an
expression, are templates of a few words, all of which must be there. They are
looked for by their first words, compressed with what they cover, and returned
as ``<id>-name`` and ``<id>-spdx`` where no confirmed notice holds them; of
names that start at one word, the longest. A name of a few bytes may have no
reduction; its words alone confirm it. Short templates are also part of
longer ones (the first words of BSD-3-Clause-full are BSD-3-Clause): both are
returned.

Places are code points, end exclusive. Null and empty texts have no blocks,
blocks that no template confirms are not returned. Templates that shorten a
block equally go by name. Repeated rows get equal results, an empty table
gives an empty one, other columns are ignored; very long texts are read whole,
and aligned only around their triggers.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches

GAP = 2
DIFFERENT = 0.15
_TRIGGER = r"(?i)licen[cs]e|copyright|permission is hereby|redistribution|warrant(?:y|ies)|all rights reserved|public domain|\bcc[ -](?:by|0)|\bcc0\b|creative commons|\b[al]?gpl"

# Wording of public license notices, by SPDX identifier.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer."
)
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": _MIT,
    "MIT-full": f"{_MIT} {_MIT_WARRANTY}",
    "MIT-0": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        f"permit persons to whom the Software is furnished to do so. {_MIT_WARRANTY}"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": _BSD,
    "BSD-2-Clause-full": f"{_BSD} {_BSD_BINARY} {_BSD_WARRANTY}",
    "BSD-3-Clause-full": f"{_BSD} {_BSD_BINARY} {_BSD_NAMES} {_BSD_WARRANTY}",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty. You should have "
        "received a copy of the CC0 Public Domain Dedication along with this software. If not, see "
        "<http://creativecommons.org/publicdomain/zero/1.0/>."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
}
# Name and version of each GNU license, as their notices have them.
_GNU = {
    "GPL-2.0-header": ("program", "GNU General Public License", "either version 2 of the License"),
    "GPL-3.0-header": ("program", "GNU General Public License", "either version 3 of the License"),
    "LGPL-2.1-header": ("library", "GNU Lesser General Public License", "either version 2.1 of the License"),
    "LGPL-3.0-header": ("program", "GNU Lesser General Public License", "either version 3 of the License"),
    "AGPL-3.0-header": ("program", "GNU Affero General Public License", "either version 3 of the License"),
}
TEMPLATES |= {
    k: (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by "
        f"the Free Software Foundation, {version}, or (at your option) any later version."
    )
    for k, (what, name, version) in _GNU.items()
}
# The parts of the Creative Commons licenses' names, and their versions.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"3.0": "Unported", "4.0": "International"}
TEMPLATES |= {
    f"CC-{k}-{v}" + ("-notice" if f"CC-{k}-{v}" in TEMPLATES else ""): f"This work is licensed under a Creative Commons {name} {v} {scope} License."
    for k, name in _CC.items()
    for v, scope in _CC_VERSIONS.items()
}
# Usual names of licenses, by identifier.
_NAMES = {
    "MIT": ["MIT License", "MIT Licence"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache License v2.0", "Apache Software License 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License - v 2.0", "EPL-2.0"],
    "Unlicense": ["The Unlicense"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "Zlib": ["zlib License"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0"],
}
# Names, short names and versions of the GNU licenses; versions of Creative Commons.
_GNU_NAMES = {
    "GPL": ("GNU General Public License", ("1.0", "2.0", "3.0")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3.0")),
    "AGPL": ("GNU Affero General Public License", ("3.0",)),
}
_CC_ALL = ("1.0", "2.0", "2.5", "3.0", "4.0")
for _short, (_long, _all) in _GNU_NAMES.items():
    for _v in _all:
        _forms = {_v, _v.removesuffix(".0")}
        _NAMES[f"{_short}-{_v}"] = [
            x
            for v in sorted(_forms)
            for x in (f"{_long} v{v}", f"{_long} {v}", f"{_long} version {v}", f"{_long} as published by the Free Software Foundation version {v}",
                      f"{_short}v{v}", f"{_short} v{v}", f"{_short}-{v}", f"{_short} {v}", f"{_short} version {v}")
        ]
for _part, _long in _CC.items():
    for _v in _CC_ALL:
        _NAMES[f"CC-{_part}-{_v}"] = [f"CC {_part} {_v}", f"CC-{_part} {_v}", f"CC-{_part}-{_v}", f"Creative Commons {_long} {_v}"]
_TAG = "spdx-license-identifier"
#: Identifiers of tags, in lower case.
_TAGGED = {k.lower(): k for k in (*_NAMES, "MIT-0", *(f"{k}-{x}" for k in _NAMES if "GPL" in k for x in ("only", "or-later")))}
#: Words that no difference may touch: versions of a template's, and what tells variants apart.
_VERSION = re.compile(r"v?\d{1,2}(?:\.\d+)*")
_VARIANT = re.compile(r"sharealike|noncommercial|noderiv|lesser|affero|(?:^|-)(?:nc|nd|sa)(?:-|$)")
_WORD = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?](?=\s)|\n|$)\s*", re.S)
SCHEMA = "block_start long, block_end long, license string, reduction double, n_words long, n_different long, differences string"


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@lru_cache(maxsize=1)
def _compressors():
    raw = zstandard.DICT_TYPE_RAWCONTENT
    made = {
        k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=raw)) for k, t in TEMPLATES.items()
    }
    return zstandard.ZstdCompressor(level=3), made, {k: _words(t) for k, t in TEMPLATES.items()}


def blocks(text: str) -> list[tuple[int, int]]:
    """Candidate blocks of a text."""
    trigger = re.compile(_TRIGGER)
    spans = [m.span() for m in _SENTENCE.finditer(text) if m.end() > m.start()]
    hits = sorted({i for i, (a, b) in enumerate(spans) if trigger.search(text, a, b)})
    out: list[list[int]] = []
    for i in hits:
        if out and i - out[-1][1] <= GAP:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [(spans[a][0], spans[a][0] + len(text[spans[a][0] : spans[b][1]].rstrip())) for a, b in out]


def _ranked(block: str) -> list[tuple[float, str]]:
    """Templates that shorten a block, the best first."""
    plain, by, _ = _compressors()
    raw = block.encode()
    alone = len(plain.compress(raw))
    found = ((1 - len(c.compress(raw)) / alone, k) for k, c in by.items())
    return sorted(((r, k) for r, k in found if r > 0), key=lambda x: (-x[0], x[1]))


def _confirm(name: str, have: list[str]) -> tuple[int, int, str] | None:
    """Words of a template, how many differ and which, if a block's words have about its wording."""
    want = _compressors()[2][name]
    steps = SequenceMatcher(None, want, have, autojunk=False).get_opcodes()
    while steps and steps[0][0] == "insert":  # before and after the notice
        steps.pop(0)
    while steps and steps[-1][0] == "insert":
        steps.pop()
    changed = [s for s in steps if s[0] != "equal"]
    differ = sum(max(i2 - i1, j2 - j1) for _, i1, i2, j1, j2 in changed)
    lost, new = ([w for s in changed for w in words[s[k] : s[k + 1]]] for words, k in ((want, 1), (have, 3)))
    if differ > DIFFERENT * len(want) or any(_VERSION.fullmatch(w) for w in lost) or any(_VARIANT.search(w) for w in lost + new):
        return None
    return len(want), differ, "; ".join(f"{' '.join(want[i1:i2])} -> {' '.join(have[j1:j2])}" for _, i1, i2, j1, j2 in changed)


def judge(block: str) -> list[tuple[str, float, int, int, str]]:
    """Confirmed templates of a block, the best first: name, reduction, words, differing words, differences."""
    have = _words(block)
    found = ((name, reduction, _confirm(name, have)) for reduction, name in _ranked(block))
    return [(name, reduction, *c) for name, reduction, c in found if c]


def _can_hold(want: list[str], have: Counter) -> bool:
    """Whether enough of a template's words are there, in any order."""
    return sum(min(n, have[w]) for w, n in Counter(want).items()) >= len(want) - int(DIFFERENT * len(want))


def _aligned(want: list[str], have: list[str]) -> tuple[int, int] | None:
    """Where ``have`` holds about the words of ``want``."""
    slack = int(DIFFERENT * len(want))
    if not _can_hold(want, Counter(have)):
        return None
    best = SequenceMatcher(None, want, have, autojunk=False).find_longest_match()
    at = max(0, best.b - best.a - slack)
    steps = SequenceMatcher(None, want, have[at : best.b - best.a + len(want) + slack], autojunk=False).get_opcodes()
    for end in (0, -1):  # words that only happen to occur before and after
        while steps and (steps[end][0] != "equal" or (len(steps) > 1 and _extra(steps[1 if end == 0 else -2]) > steps[end][2] - steps[end][1])):
            steps.pop(end)
    return (at + steps[0][3], at + steps[-1][4]) if steps else None


def _extra(step: tuple) -> int:
    """Words put in beyond those of the template."""
    return (step[4] - step[3]) - (step[2] - step[1])


@lru_cache(maxsize=1)
def _by_first() -> dict[str, list[tuple[list[str], str]]]:
    """Words and identifiers of names by their first word, longer names first."""
    out: dict[str, list[tuple[list[str], str]]] = {}
    for k, names in _NAMES.items():
        for words in map(_words, names):
            out.setdefault(words[0], []).append((words, k))
    return {w: sorted(names, key=lambda x: (-len(x[0]), x[1])) for w, names in out.items()}


@lru_cache(maxsize=1024)
def _shortening(template: str) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(template.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=raw)


def _named(text: str, places: list[tuple[int, int]], low: list[str]) -> list[tuple[int, int, str, float, int, int, str]]:
    """Names and tags among some words of a text."""
    plain, found = _compressors()[0], []

    def keep(i: int, j: int, name: str, template: list[str]) -> None:
        a, b = places[i][0], places[j - 1][1]
        raw = " ".join(low[i:j]).encode()
        found.append((a, b, name, 1 - len(_shortening(" ".join(template)).compress(raw)) / len(plain.compress(raw)), j - i, 0, ""))

    i = 0
    while i < len(low):
        if low[i] == _TAG:
            start, j = i, i + 1
            while j < len(low) and "\n" not in text[places[j - 1][1] : places[j][0]]:
                if low[j] in _TAGGED:
                    keep(start, j + 1, f"{_TAGGED[low[j]]}-spdx", [_TAG, low[j]] if start == i else [low[j]])
                j += 1
                if j >= len(low) or low[j] not in ("or", "and", "with"):
                    break
                start = j = j + 1
            i = max(j, i + 1)
            continue
        hit = next(((w, k) for w, k in _by_first().get(low[i], ()) if low[i : i + len(w)] == w), None)
        if hit:
            keep(i, i + len(hit[0]), f"{hit[1]}-name", hit[0])
        i += len(hit[0]) if hit else 1
    return found


def notices(text: str) -> list[tuple[int, int, str, float, int, int, str]]:
    """Confirmed templates of a text with their places."""
    _, by, wording = _compressors()
    plain, spans = _compressors()[0], blocks(text)
    places = [m.span() for m in _WORD.finditer(text)]
    starts, reach = [a for a, _ in places], max(map(len, wording.values()))
    wide: list[list[int]] = []
    for a, b in spans:
        lo, hi = max(0, bisect_left(starts, a) - reach), min(len(places), bisect_left(starts, b) + reach)
        if wide and lo <= wide[-1][1]:
            wide[-1][1] = max(hi, wide[-1][1])
        else:
            wide.append([lo, hi])
    found, named = [], []
    for first, last in wide:
        if first == last:
            continue
        low = [text[a:b].lower() for a, b in places[first:last]]
        counts = Counter(low)
        named += _named(text, places[first:last], low)
        for _, name in _ranked(text[places[first][0] : places[last - 1][1]]):
            todo = [(first, last)] if _can_hold(wording[name], counts) else []
            while todo:
                lo, hi = todo.pop()
                at = _aligned(wording[name], low[lo - first : hi - first])
                if at is None or at[0] == at[1]:
                    continue
                i, j = lo + at[0], lo + at[1]
                todo += [(lo, i), (j, hi)]
                a, b = places[i][0], places[j - 1][1]
                b += len(text[b : b + 1].strip()) if text[b : b + 1] in ".!?" else 0
                raw, confirmed = text[a:b].encode(), _confirm(name, low[i - first : j - first])
                reduction = 1 - len(by[name].compress(raw)) / len(plain.compress(raw))
                if confirmed and reduction > 0:
                    found.append((a, b, name, reduction, *confirmed))
    whole = [(a, b, *v) for a, b in spans for v in judge(text[a:b])]
    found += [x for x in whole if not any(y[2] == x[2] and y[0] < x[1] and x[0] < y[1] for y in found)]
    return found + [x for x in named if not any(y[0] <= x[0] and x[1] <= y[1] for y in found)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, SCHEMA): every confirmed template of every block."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(_TRIGGER))
    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(i, *v) for i, t in zip(f.doc_id, f.text, strict=True) for v in notices(t)]
            yield pd.DataFrame(found, columns=names)

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {SCHEMA}")
