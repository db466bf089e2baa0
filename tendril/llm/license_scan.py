"""License scan by conditional compression.

A block of text is compressed with zstandard alone and with each license template as a raw dictionary, and the templates
are ranked by what they save. The best are compared with the block word by word: the exact differences are listed, and a
license is confirmed if they are few and touch none of its telling words (names and versions). A version or family that
differs is another license, whatever the compression says.

Blocks come from two places:

- Windows: where words of a template stand in the text, they say where the whole template would begin. Every window in
  which half of the template's words stand is a block for it, wherever lines, paragraphs or other notices begin and end.
  Overlapping blocks are confirmed in the order of the bytes that their templates save.
- Mentions, outside confirmed windows: each sentence with a cue word, and each run of lines between cue lines (at most
  GAP lines apart). A run that is confirmed takes the place of the sentences within it. Those that are not confirmed are
  reported with the license they come nearest to.

Defined cases: a null or empty text has no block; repeated rows are scanned each; an empty table gives an empty result;
equal savings go to the template first by name; very long texts and blocks are compared whole; other columns are not read.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Mapping
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import map_columns

LEVEL = 3
#: Share of differing words up to which a block is the license, and least share of bytes saved.
MOST_DIFFERENT, LEAST_SAVED = 0.2, 0.25
GAP = 4
#: A window is a block, and a mention is compared with a template, where this share of the template's words stands in it.
LEAST_SHARED = 0.5
#: A run of lines of over so many times the words of the longest template is looked at sentence by sentence.
LONGEST_RUN = 2

# Wordings by which licenses are named, and the words that tell one from another.
_GNU_TERMS = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    'including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is '
    'furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE '
    'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    'NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT '
    'OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
)
_ISC = (
    'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice '
    'appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN '
    'NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF '
    'CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    'WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
)
_ZLIB = (
    'This software is provided \'as-is\', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is '
    'granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of '
    'this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would '
    'be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed '
    'or altered from any source distribution.'
)
_UNLICENSE = (
    'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or '
    'as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'
)
_BOOST = (
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, '
    'reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, '
    'all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be '
    'included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable '
    'object code generated by a source language processor.'
)
_BSD_CONDITIONS = (
    'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain '
    'the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the '
    'following disclaimer in the documentation and/or other materials provided with the distribution.'
)
_BSD_NAMES = (
    '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    'FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL '
    'DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, '
    'WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
)


def _under(name: str) -> tuple[str, ...]:
    """A short name alone is too little to compress."""
    return tuple(f"{verb} under {name}" for verb in ("Licensed", "Released", "Distributed", "Available"))


def _gnu(short: str, name: str, version: int | str) -> tuple[str, ...]:
    return (
        f"This work is licensed under the GNU {name}, version {version}.",
        _GNU_TERMS.format(name=f"GNU {name}", version=version),
        f"GNU {name} version {version}",
        f"GNU {name} v{version}",
        *_under(f"{short} v{version}"),
        f"Licensed under the {short}v{version}.",
        f"SPDX-License-Identifier: {short}-{version}{'' if '.' in str(version) else '.0'}",
    )


def _creative(kind: str, name: str) -> tuple[str, ...]:
    return (f"Licensed under CC {kind} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License.", *_under(f"CC {kind} 4.0")[1:], f"SPDX-License-Identifier: CC-{kind}-4.0")


TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", _APACHE, "Apache License, Version 2.0", "Apache 2.0 license", "License: Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", _MIT, "MIT License", "This project is MIT licensed.", "License: MIT", "SPDX-License-Identifier: MIT"),
    "ISC": (_ISC, "ISC License", "SPDX-License-Identifier: ISC"),
    "Zlib": (_ZLIB, "zlib License", "SPDX-License-Identifier: Zlib"),
    "BSL-1.0": (_BOOST, "Boost Software License", "SPDX-License-Identifier: BSL-1.0"),
    "Unlicense": (_UNLICENSE, "SPDX-License-Identifier: Unlicense"),
    "GPL-3.0": _gnu("GPL", "General Public License", 3),
    "GPL-2.0": _gnu("GPL", "General Public License", 2),
    "LGPL-2.1": (*_gnu("LGPL", "Lesser General Public License", "2.1"), "LGPL version 2.1"),
    "LGPL-3.0": _gnu("LGPL", "Lesser General Public License", 3),
    "AGPL-3.0": _gnu("AGPL", "Affero General Public License", 3),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}",
        "BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSD-2-Clause": (f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "CC-BY-4.0": _creative("BY", "Attribution"),
    "CC-BY-SA-4.0": _creative("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _creative("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _creative("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _creative("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _creative("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "EPL-2.0": ("Licensed under the Eclipse Public License 2.0.", "Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0"),
    "Proprietary": ("All rights reserved.",),
    "CC0-1.0": ("This work has been dedicated to the public domain under CC0 1.0 Universal.", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"),
}
CUES = ("licens", "licenc", "permission is hereby", "redistribution and use", "public domain", "all rights reserved", "spdx-")

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _telling() -> frozenset[str]:
    """Words of which a difference makes another license, from the templates: the parts of license names, and for two licenses of like wordings the words by which their likest short ones differ."""
    parts = {w for name in TEMPLATES for w in words(name)} - {"proprietary"}
    out = set(parts) | {f"{stem}v{w}" for stem in ("", "gpl", "lgpl", "agpl") for w in parts if w.isdigit()}
    short = {name: [set(words(t)) for t in texts if len(words(t)) <= 16] for name, texts in TEMPLATES.items()}
    for name, ones in short.items():
        for other, twos in short.items():
            alike = [one ^ two for one in ones for two in twos if len(one & two) >= 3 and len(one ^ two) <= 4] if name < other else []
            least = min(map(len, alike), default=0)
            out.update(*(x for x in alike if len(x) == least))
    # of the long notices, the clause by which the two BSD licenses differ
    return frozenset(out | {"endorse", "promote", "reserved"})


@cache
def _compressor(template: str | None) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(template.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) if template else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def saved(block: bytes, template: str) -> float:
    """Share of the compressed size that a template as dictionary saves."""
    alone = len(_compressor(None).compress(block))
    return 1 - len(_compressor(template).compress(block)) / alone


@cache
def _listed(templates: tuple[tuple[str, tuple[str, ...]], ...]) -> list[tuple[str, str, frozenset[str]]]:
    return [(name, t, frozenset(words(t))) for name, texts in templates for t in texts]


def ranked(block: str, templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[float, str, str]]:
    """(saved, license, template), the largest saving first, of the templates half of whose words stand in the block; of those that hold most of theirs where none does.

    A template of which fewer words stand there differs in over MOST_DIFFERENT of them, so none is left out that could be
    confirmed.
    """
    raw, held = block.lower().encode("utf-8", "surrogatepass"), set(words(block))
    shares = [(len(own & held) / len(own), name, t) for name, t, own in _listed(tuple(templates.items()))]
    least = min(LEAST_SHARED, max(share for share, _, _ in shares))
    found = [(saved(raw, t), name, t) for share, name, t in shares if share >= least]
    return sorted(found, key=lambda x: (-x[0], x[1], x[2]))


@cache
def telling_words() -> frozenset[str]:
    return _telling()


def differences(block: str, template: str) -> tuple[list[str], float, bool]:
    """Exact wording differences, their share of the template's words, and whether they touch telling words."""
    ours, theirs = words(block), words(template)
    listed, count, telling, known = [], 0, False, telling_words()
    for kind, a, b, c, d in difflib.SequenceMatcher(None, theirs, ours, autojunk=False).get_opcodes():
        if kind != "equal":
            listed.append(f"-{' '.join(theirs[a:b])} +{' '.join(ours[c:d])}")
            count += 0 if kind == "insert" and a in (0, len(theirs)) else max(b - a, d - c)  # words around the notice are no difference
            telling |= bool(known.intersection(theirs[a:b]) or known.intersection(ours[c:d]))
    return listed, count / max(len(theirs), 1), telling


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the blocks that mention licensing: runs of lines first, then sentences."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: places must hold in the text itself
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    if not any(cue in low for cue in CUES):
        return []
    cued, at = [], 0
    sentences = []
    for number, line in enumerate(low.split("\n")):
        if any(cue in line for cue in CUES):
            cued.append((number, at, at + len(line)))
            start = 0
            for gap in [*_SENTENCE.finditer(line), None]:
                stop = gap.start() if gap else len(line)
                if any(cue in line[start:stop] for cue in CUES):
                    sentences.append((at + start, at + stop))
                start = gap.end() if gap else stop
        at += len(line) + 1
    runs, k = [], 0
    while k < len(cued):
        last = k
        while last + 1 < len(cued) and cued[last + 1][0] - cued[last][0] <= GAP:
            last += 1
        runs.append((cued[k][1], cued[last][2]))
        k = last + 1
    return [*runs, *(s for s in sentences if s not in runs)]


@cache
def _anchors(templates: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[list[tuple[str, str, list[str]]], dict[str, list[tuple[int, int]]]]:
    """Templates as (license, text, words), and for each anchor word the (template, place in it). The anchors of a template are its rarest words among all."""
    listed = [(name, t, words(t)) for name, texts in templates for t in texts]
    spread = Counter(w for _, _, found in listed for w in set(found))
    anchors: dict[str, list[tuple[int, int]]] = {}
    for k, (_, _, found) in enumerate(listed):
        # cue words first: they are what ordinary text seldom has
        chosen = sorted(set(found), key=lambda w: (not any(w.startswith(c) for c in ("licen", "cc", "spdx", "redistribut", "sublicens", "warrant", "merchantab", "reserved", "gpl", "lgpl", "agpl", "misrepresent", "unencumbered")), spread[w], w))
        for place, w in enumerate(found):
            if w in chosen[:4]:
                anchors.setdefault(w, []).append((k, place))
    return listed, anchors


#: Each template has one of these, so a text without them holds none.
GATES = ("licens", "licenc", "permission", "redistribut", "domain", "reserved", "spdx", "gpl", "free software", "as-is", "unencumbered")
_CREATIVE = re.compile(r"\bcc(?:0|\s+by)\b")


def may_hold(text: str) -> bool:
    low = text.lower()
    return any(gate in low for gate in GATES) or "cc" in low and _CREATIVE.search(low) is not None


def common_words(theirs: list[str], window: list[tuple[int, int, str]]) -> tuple[list[str], list[difflib.Match]]:
    """The words of a window, and the runs that they have in common with a template."""
    ours = [w for _, _, w in window]
    return ours, [m for m in difflib.SequenceMatcher(None, theirs, ours, autojunk=False).get_matching_blocks() if m.size]


def windows(text: str, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, gate: bool = True) -> list[tuple[int, int, str, float, str, float, bool]]:
    """Confirmed blocks by windows, none of which overlap: as scan_text."""
    if gate and not may_hold(text):
        return []
    listed, anchors = _anchors(tuple(templates.items()))
    spans = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
    starts: dict[tuple[int, int], None] = {}
    for at, (_, _, w) in enumerate(spans):
        for k, place in anchors.get(w, ()):
            starts[k, max(0, at - place)] = None
    found = []
    for k, start in starts:
        name, template, theirs = listed[k]
        slack = len(theirs) // 8
        first, last = max(0, start - slack), min(len(spans), start + len(theirs) + slack)
        held = {w for _, _, w in spans[first:last]}
        if sum(w in held for w in theirs) < LEAST_SHARED * len(theirs):
            continue
        a, b = spans[first][0], spans[last - 1][1]
        raw = text[a:b].lower().encode("utf-8", "surrogatepass")
        alone = len(_compressor(None).compress(raw))
        less = alone - len(_compressor(template).compress(raw))
        found.append((-less, name, first, last, less / alone, template))
    out: list[tuple[int, int, str, float, str, float, bool]] = []
    taken: list[tuple[int, int]] = []
    for less, name, first, last, gain, template in sorted(found):
        theirs = words(template)
        slack = len(theirs) // 8
        ours, matched = common_words(theirs, spans[first:last])
        if not matched:
            continue
        if matched[0].a or matched[-1].a + matched[-1].size < len(theirs):  # the window may lie beside the notice
            last = min(len(spans), first + matched[-1].b + matched[-1].size + len(theirs) - matched[-1].a - matched[-1].size + slack)
            first = max(0, first + matched[0].b - matched[0].a - slack)
            ours, matched = common_words(theirs, spans[first:last])
        # the words of the block from the first to the last that it has in common with the template
        begin, end = first + matched[0].b, first + matched[-1].b + matched[-1].size
        place = bisect_left(taken, (begin, end))
        if place < len(taken) and taken[place][0] < end or place and taken[place - 1][1] > begin:
            continue
        a, b = spans[begin][0], spans[end - 1][1]
        while a and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        listed_, share, telling = differences(" ".join(ours[matched[0].b : end - first]), template)
        if gain >= LEAST_SAVED and share <= MOST_DIFFERENT and not telling:
            taken.insert(place, (begin, end))
            out.append((a, b, name, gain, "; ".join(listed_), share, True))
    return sorted(out)


def scan_text(text: str, templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[int, int, str, float, str, float, bool]]:
    """(start, end, license, saved, differences, share that differs, confirmed) of each block."""
    out = windows(text, templates)
    covered = [(a, b) for a, b, *_ in out]
    starts = [a for a, _ in covered]

    def overlaps(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return k > 0 and covered[k - 1][1] > start

    longest = LONGEST_RUN * max(len(words(t)) for texts in templates.values() for t in texts)
    mentioned: list[tuple[int, int, str, float, str, float, bool]] = []
    whole: list[tuple[int, int]] = []
    every = blocks(text)
    begins = sorted(a for a, _ in every)
    for start, end in every:
        if overlaps(start, end) or whole and any(a <= start and end <= b for a, b in whole):
            continue
        block = text[start:end]
        if bisect_left(begins, end) - bisect_left(begins, start) > 2 and block.count(" ") + block.count("\n") > longest:
            continue  # its sentences are blocks too
        order = ranked(block, templates)
        # a template that saves less is not confirmed; without one, the block is reported with the first
        tried = [(*differences(block, template), gain, name) for gain, name, template in order if gain >= LEAST_SAVED] or [(*differences(block, order[0][2]), order[0][0], order[0][1])]
        listed, share, telling, gain, name = min(tried, key=lambda x: (x[2], x[1]))  # templates keep their order among equals
        confirmed = gain >= LEAST_SAVED and share <= MOST_DIFFERENT and not telling
        if confirmed:
            whole.append((start, end))
        mentioned.append((start, end, name, gain, "; ".join(listed), share, confirmed))
    # a run without a license of its own stands only where no sentence in it was looked at by itself
    spans = [(a, b) for a, b, *_ in mentioned]
    return sorted([*out, *(x for x in mentioned if x[-1] or not any((x[0], x[1]) != (a, b) and x[0] <= a and b <= x[1] for a, b in spans))])


SCHEMA = "doc_id long, start long, end long, license string, saved double, differences string, different double, confirmed boolean"


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """A row for each block of each text that mentions licensing."""
    known = dict(templates)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(d, *x) for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in scan_text(text.as_py() or "", known)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.bool_())
        columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return map_columns(docs, ["doc_id", "text"], run, SCHEMA)
