"""License scans by conditional compression: which license notice makes a block cheapest to write down."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted

#: Wording that several notices share.
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
    " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = "it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Notices of public licenses, (license, wording). "BSD" is what BSD-2-Clause and BSD-3-Clause begin with, where no more is there.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD", _BSD),
    ("BSD-2-Clause", _BSD + _BSD_CLAUSES),
    ("BSD-2-Clause", _BSD + _BSD_CLAUSES + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD + _BSD_CLAUSES + _BSD_THIRD),
    ("BSD-3-Clause", _BSD + _BSD_CLAUSES + _BSD_THIRD + _BSD_WARRANTY),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify " + _GNU.format("General Public License", "3")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify " + _GNU.format("General Public License", "2")),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify " + _GNU.format("Lesser General Public License", "3")),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify " + _GNU.format("Lesser General Public License", "2.1")),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify " + _GNU.format("Affero General Public License", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MIT", _MIT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        + _WARRANTY + " OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    *(
        (name, f"SPDX-License-Identifier: {said}")
        for name, said in (
            ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"), ("Apache-2.0", "Apache-2.0"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"),
            ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC0-1.0", "CC0-1.0"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0-or-later"), ("ISC", "ISC"), ("LGPL-2.1", "LGPL-2.1-only"),
            ("LGPL-2.1", "LGPL-2.1-or-later"), ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"), ("MIT", "MIT"), ("MPL-2.0", "MPL-2.0"), ("Unlicense", "Unlicense"), ("Zlib", "Zlib"),
        )
    ),
)
#: What a block has to hold to be a candidate, any case.
CUES = ("licen[sc]e", "copyright", "permission is hereby", "redistribution and use", "spdx", "creative commons", "\\bcc by", "unencumbered software", "permission is granted to anyone")
_PUNCTUATION = " \t\r\n.,;:!?\"'()[]{}<>*#/|-"
_SPACE = "\\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_GAP = f"[{re.escape(_PUNCTUATION)}]*[{_SPACE}][{re.escape(_PUNCTUATION)}{_SPACE}]*"  # between words of a cue: line ends and comment marks too
_CUE = re.compile("|".join(c.replace(" ", _GAP) for c in CUES), re.IGNORECASE | re.ASCII)
_MAYBE = "(?i)" + "|".join(c.replace(" ", "[^0-9A-Za-z]+").replace("\\b", "") for c in CUES)  # finds all that _CUE finds


_TAG = "SPDX-License-Identifier: "
_ID = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
_SPDX = re.compile(rf"SPDX-License-Identifier:[ \t]*(\(*{_ID}\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*{_ID}\)*)*)")


def wording(text: str) -> list[str]:
    """Lower-cased words without the punctuation around them."""
    return [w for w in (x.strip(_PUNCTUATION) for x in text.lower().split()) if w]


def alignments(template: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end (excluded) in the block: the least number of words to add, drop or replace that turns the template into a stretch
    that ends there, and the start of the shortest such stretch."""
    one = 1 << 32
    row = one - 1 - np.arange(len(block) + 1)  # cost * one + (one - 1 - start); a stretch may begin anywhere
    step = np.arange(len(block) + 1) * one
    for w in template:
        cost = np.concatenate(([row[0] + one], np.minimum(row[1:] + one, row[:-1] + one * (block != w))))
        row = np.minimum.accumulate(cost - step) + step  # words of the block that the template lacks
    return row // one, one - 1 - row % one


def differences(template: list[str], block: list[str]) -> int:
    """The least number of words to add, drop or replace that turns the template into some stretch of the block."""
    codes: dict[str, int] = {}
    t, b = (np.array([codes.setdefault(w, len(codes)) for w in words], np.int64) for words in (template, block))
    return int(alignments(t, b)[0].min())


@dataclass(frozen=True)
class Verdict:
    license: str | None
    template: int
    saved: int
    diffs: int
    confirmed: bool = False


@dataclass(frozen=True)
class Notice:
    start: int
    end: int
    line: int
    verdict: Verdict


class Scanner:
    """Finds notices around the cues of a text: of the templates whose wording is there, the one that saves most as a raw dictionary."""

    def __init__(self, templates: tuple[tuple[str, str], ...], level: int = 3, tolerance: float = 0.1) -> None:
        import zstandard

        self.names = [name for name, _ in templates]
        self.spdx = {*self.names, *(text.removeprefix(_TAG) for _, text in templates if text.startswith(_TAG))}
        self.wordings = [wording(text) for _, text in templates]
        self.codes: dict[str, int] = {}
        self.coded = [np.array([self.codes.setdefault(w, len(self.codes)) for w in words], np.int64) for words in self.wordings]
        self.tolerance = tolerance
        self.reach = max((len(w) + int(tolerance * len(w)) for w in self.wordings), default=0)  # words that a notice can have
        raw = [zstandard.ZstdCompressionDict((" " + text).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, text in templates]
        small = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(level=level, **small)
        self.primed = [zstandard.ZstdCompressor(level=level, dict_data=d, **small) for d in raw]

    def rank(self, block: str) -> list[tuple[int, int]]:
        """(bytes saved, template), the best first; equal savings in the order of the templates."""
        data = block.encode()
        whole = len(self.plain.compress(data))
        saved = [(whole - len(c.compress(data)), i) for i, c in enumerate(self.primed)]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def judge(self, stretch: str) -> Verdict:
        """Of the templates in the order of what they save of a stretch, the first with at most tolerance of its words differing; the first
        at all where there is none, and none if no template saves bytes."""
        ranked, said = [(saved, i) for saved, i in self.rank(stretch) if saved > 0], wording(stretch)
        there = set(said)
        for saved, i in ranked:
            most = self.tolerance * len(self.wordings[i])
            if sum(w not in there for w in self.wordings[i]) <= most and (diffs := differences(self.wordings[i], said)) <= most:
                return Verdict(self.names[i], i, saved, diffs)
        if not ranked:
            return Verdict(None, -1, 0, 0)
        saved, i = ranked[0]
        return Verdict(self.names[i], i, saved, differences(self.wordings[i], said))

    def expressions(self, text: str) -> list[tuple[int, int, Verdict]]:
        """SPDX tags that aren't one known identifier, which is a template of its own: their places, and the expression as it is written where
        all its licenses are known."""
        out = []
        for m in _SPDX.finditer(text):
            said = " ".join(m.group(1).rstrip(".").split())
            ids = re.findall(rf"(WITH )?\(*({_ID})", re.sub(r"\b(AND|OR) ", "", said))
            known = all(exception or i in self.spdx for exception, i in ids)
            if len(ids) > 1 or not known:
                out.append((m.start(), m.start(1) + len(m.group(1).rstrip(".")), Verdict(said if known else None, -1, 0, 0, known)))
        return out

    def _occurrences(self, i: int, block: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(differences, start, end) of template i in the block, within tolerance, the best of those that overlap."""
        template = self.coded[i]
        most = self.tolerance * len(template)
        if len(template) - np.isin(template, block).sum() > most:
            return
        costs, starts = alignments(template, block)
        taken: list[tuple[int, int]] = []
        for end in sorted(np.flatnonzero(costs <= most).tolist(), key=lambda e: (costs[e], e)):
            start = int(starts[end])
            if start < end and all(end <= a or b <= start for a, b in taken):
                taken.append((start, end))
                yield int(costs[end]), start, end

    def notices(self, text: str) -> list[Notice]:
        """The notices of a text in their order, then what is left of the cues, one for those near each other."""
        said, starts, ends = array("q"), array("q"), array("q")
        was = ""
        for m in re.finditer(r"\S+", text):
            if w := m.group().lower().strip(_PUNCTUATION):
                if ends and text[ends[-1] - 1] == "-" and (whole := f"{was}-{w}") in self.codes and "\n" in text[ends[-1] : m.start()]:
                    said[-1], ends[-1], was = self.codes[whole], m.end(), whole  # wrapped at its hyphen
                    continue
                was = w
                said.append(self.codes.get(w, -1))
                starts.append(m.start())
                ends.append(m.end())
        words = np.frombuffer(said, np.int64) if said else np.zeros(0, np.int64)
        cues = sorted({bisect_right(starts, m.start()) - 1 for m in _CUE.finditer(text)})
        found: set[tuple[int, int, int, int]] = set()
        at = 0
        while at < len(cues):  # overlapping stretches that hold every notice with a cue; at most 3 times the longest notice
            to = bisect_right(cues, cues[at] + self.reach)
            low = max(0, cues[at] - self.reach)
            block = words[low : cues[to - 1] + self.reach + 1]
            found |= {(i, cost, low + a, low + b) for i in range(len(self.coded)) for cost, a, b in self._occurrences(i, block)}
            at = to
        # occurrences that overlap are one candidate: all their templates are compared by what they save of it
        ranked: list[tuple[int, float, int, int, int]] = []
        together: list[tuple[int, int, int, int]] = []
        for x in [*sorted(found, key=lambda x: x[2:]), None]:
            if together and (x is None or x[2] >= max(t[3] for t in together)):
                data = text[starts[together[0][2]] : ends[max(t[3] for t in together) - 1]].encode()
                whole = len(self.plain.compress(data))
                saved = {i: whole - len(self.primed[i].compress(data)) for i in {t[0] for t in together}}
                ranked += [(-saved[i], cost / len(self.coded[i]), i, a, b) for i, cost, a, b in together]
                together = []
            if x:
                together.append(x)
        held = bytearray(len(words))
        taken: list[tuple[int, int]] = []
        out: list[tuple[int, int, Verdict]] = []
        for low, high, v in self.expressions(text):
            a, b = bisect_left(starts, low), bisect_left(starts, high)
            held[a:b] = b"\1" * (b - a)
            insort(taken, (a, b))
            out.append((a, b, v))
        for saved, share, i, a, b in sorted(ranked):
            held[a:b] = b"\1" * (b - a)
            near = taken[bisect_left(taken, (a - self.reach, 0)) : bisect_left(taken, (b, 0))]
            if all(2 * (min(b, d) - max(a, c)) <= min(b - a, d - c) for c, d in near):
                insort(taken, (a, b))
                out.append((a, b, Verdict(self.names[i], i, -saved, round(share * len(self.wordings[i])), True)))
        cues = [c for c in cues if not held[c]]
        while cues:
            to = 1
            while to < len(cues) and cues[to] <= cues[0] + self.reach and held.find(1, cues[to - 1], cues[to]) < 0:
                to += 1
            first, last = cues[0], cues[to - 1]
            low, high = max(0, first - self.reach), min(len(words), last + self.reach + 1)
            low = max(low, held.rfind(1, low, first) + 1)
            high = after if (after := held.find(1, last, high)) >= 0 else high
            out.append((first, last + 1, self.judge(text[starts[low] : ends[high - 1]])))
            cues = cues[to:]
        made, line, seen = [], 0, 0
        for a, b, v in sorted(out, key=lambda x: x[:2]):
            line += text.count("\n", seen, starts[a])
            seen = starts[a]
            made.append(Notice(starts[a], ends[b - 1], line, v))
        return made


def scan_licenses(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.1,
) -> DataFrame:
    """One row per notice: id_col, block_no (its first line, from 0), license, nearest, template, saved_bytes, n_diffs, exact, confirmed, start, end.

    Texts are looked at as words, so a notice may be wrapped over lines (at hyphens too) and carry comment marks. Candidate blocks are stretches around
    cues in which the wording of templates occurs: n_diffs are the words to add, drop or replace to find a template's wording, exact means none,
    and at most tolerance of its words confirms it. The templates of a block are ranked by the bytes that each saves of it as a zstandard raw
    dictionary; the confirmed one that saves most is its license (of equal ones the one with the smaller share of differing words, then the
    earlier), and others in the block only where they share half of the shorter notice with it at most: they have a row each. start and end
    (excluded) are a notice's place in the text, in characters from 0.

    Cues outside any confirmed notice give a row that isn't confirmed, one for those within the longest notice of each other with no
    notice between, with the place of the cues; its license is null, and nearest names the template that saves most of the stretch around them, null
    if none saves bytes. An SPDX tag with an expression of several licenses has that expression as its license, confirmed if all its licenses are
    known, and a tag with an unknown one isn't confirmed; both without a template. Null and empty texts have no rows, and no rows give no rows; rows
    that repeat, or share an id, are looked at each by itself; other columns are ignored, whatever their names. Texts are taken whole.

    The cue filter runs in Spark before any text leaves the JVM; there is no shuffle.
    """
    texts = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text")).where(F.col("_text").rlike(_MAYBE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, tolerance=tolerance)
        for batch in batches:
            rows = [(k, n) for k, text in enumerate(batch.column("_text")) for n in scanner.notices(text.as_py())]
            v = [n.verdict for _, n in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(pa.array([k for k, _ in rows], pa.int64())),
                    pa.array([n.line for _, n in rows], pa.int32()),
                    pa.array([x.license if x.confirmed else None for x in v], pa.string()),
                    pa.array([None if x.confirmed else x.license for x in v], pa.string()),
                    pa.array([x.template if x.template >= 0 else None for x in v], pa.int32()),
                    pa.array([x.saved for x in v], pa.int64()),
                    pa.array([x.diffs for x in v], pa.int64()),
                    pa.array([x.confirmed and not x.diffs for x in v], pa.bool_()),
                    pa.array([x.confirmed for x in v], pa.bool_()),
                    pa.array([n.start for _, n in rows], pa.int64()),
                    pa.array([n.end for _, n in rows], pa.int64()),
                ],
                ["_id", "block_no", "license", "nearest", "template", "saved_bytes", "n_diffs", "exact", "confirmed", "start", "end"],
            )

    id_type = texts.schema["_id"].dataType.simpleString()
    out = texts.mapInArrow(run, f"_id {id_type}, block_no int, license string, nearest string, template int, saved_bytes bigint, n_diffs bigint, exact boolean, confirmed boolean, start bigint, end bigint")
    return out.withColumnRenamed("_id", id_col)
