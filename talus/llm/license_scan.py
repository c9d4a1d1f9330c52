"""Licence scans by conditional compression.

Segments of a text (lines, or parts of very long ones) that hold a cue such as "license" or "warranty" make candidate
blocks: a segment's cues with as many words before and after as the longest template may take, across lines and segments,
so that consecutive blocks overlap. A block's words are compressed plain and with each template as zstandard raw
dictionary; what a template saves, as a share of what it saves on itself, ranks the templates. Every template that saves
enough in a block, however many there are, is confirmed by its exact wording: its words are matched in order within the block, and
the differences (template words that are missing, other words in between) are few or the place is no notice.

Defined results: a null or empty text has no blocks. All cues of a text of any length are looked at, and `licence` is spelt like
`license`; whatever stands between two words, they are neighbours. All notices of a text are returned, with the place of their
first word; where notices overlap, the one with the most words of its template (less the differences) stays, and of equal
ones the one with fewer differences, then the earlier in the list. A segment with a cue that no notice touches is returned with a null licence and the
differences of its block from the best template. A null doc_id stays null. Repeated rows give repeated results; an empty table gives
none; columns other than doc_id and text, of any name, are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUES = r"(?i)licen[sc]|copyright|warrant|redistribut|spdx|creative[\W_]+commons|public[\W_]+domain|permission[\W_]+is[\W_]+hereby"
#: Characters of a segment.
SEGMENT = 2000
#: Least share of what a template saves on itself, in a block and at its place, and most template words (share) that may
#: be missing or strange. A block's letters are coded in fewer bits than a template's alone, hence the low share there.
LEAST_IN_BLOCK, LEAST_SAVED, MOST_DIFFERENT = 0.2, 0.4, 0.1

# Wording and notices of public licences.
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_1_2 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
APACHE = "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
GNU_TERMS = "under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
GNU_KINDS = (("GPL", "General Public License", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",)))
UNLICENSE = "This is free and unencumbered software released into the public domain."
UNLICENSE_REST = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
CC0 = "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
SHORT = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is MIT licensed."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", MPL),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
)
# Identifiers that an SPDX tag may name.
SPDX = (
    "MIT", "MIT-0", "ISC", "Zlib", "Unlicense", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "BSL-1.0", "EPL-2.0", "WTFPL",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)

TEMPLATES = (
    *SHORT,
    ("BSD-3-Clause", BSD),
    ("BSD-2-Clause", f"{BSD} 1. {BSD_1_2} {BSD_AS_IS}"),
    ("BSD-3-Clause", f"{BSD} 1. {BSD_1_2} 3. {BSD_3} {BSD_AS_IS}"),
    ("ISC", ISC),
    ("ISC", f"{ISC} {ISC_AS_IS}"),
    ("MIT", GRANT),
    ("MIT", f"{GRANT}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS} OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", f"Licensed under the Apache License, Version 2.0 (the \"License\"); {APACHE} See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", f"{MPL} If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", UNLICENSE),
    ("Unlicense", f"{UNLICENSE} {UNLICENSE_REST}"),
    ("Zlib", ZLIB),
    ("CC0-1.0", CC0),
    *((f"{kind}-{version}", wording.format(name, version.removesuffix(".0"), name)) for kind, name, versions in GNU_KINDS for version in versions for wording in (GNU_TERMS, GNU)),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
)


WORD = re.compile(r"[^\W_]+")


def spelled(word: str) -> str:
    """A word as it is compared: lower-cased, `licence` as `license`."""
    return word.lower().replace("licenc", "licens")


def normal(text: str) -> list[str]:
    return [spelled(w) for w in WORD.findall(text)]


def segments(text: str) -> list[tuple[int, str]]:
    """(place, segment): lines, and pieces of at most SEGMENT characters of longer ones, cut behind white space if there is any."""
    out = []
    for line in re.finditer(r"[^\n]*", text):
        at, end = line.start(), line.end()
        while end - at > SEGMENT:
            cut = text.rfind(" ", at, at + SEGMENT)
            cut = cut + 1 if cut > at else at + SEGMENT
            out.append((at, text[at:cut]))
            at = cut
        out.append((at, text[at:end]))
    return out


def blocks(text: str, reach: int) -> Iterator[tuple[list[tuple[int, int]], list[tuple[str, int, int]]]]:
    """(segments with cues as (place, end), words as (word, place, end)): `reach` words before the first and behind the last cue are in the block.

    Segments share a block while their cues lie within `reach` words, so that a word is in three blocks at most, about.
    """
    cues = [m.span() for m in re.finditer(CUES, text)]
    if not cues:
        return
    spans = [m.span() for m in WORD.finditer(text)]
    begins, ends = [a for a, _ in spans], [b for _, b in spans]

    def words(first: int, last: int) -> list[tuple[str, int, int]]:
        return [(spelled(text[a:b]), a, b) for a, b in spans[max(first - reach, 0) : last + reach + 1]]

    k, here, first, last = 0, [], 0, 0
    for at, part in segments(text):
        low = k
        while k < len(cues) and cues[k][0] < at + len(part):
            k += 1
        if k == low:
            continue
        a, b = bisect.bisect_right(ends, cues[low][0]), bisect.bisect_left(begins, cues[k - 1][1])
        if here and b - first > reach:
            yield here, words(first, last)
            here = []
        if not here:
            first = a
        here.append((at, at + len(part)))
        last = b
    yield here, words(first, last)


class Scanner:
    """Templates as dictionaries; made once in each task."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.templates = []
        for name, text in templates:
            words = normal(text)
            data = " ".join(words).encode()
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=9)
            primed = zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=dictionary)
            self.templates.append((name, words, primed, len(self.plain.compress(data)) - len(primed.compress(data))))
        self.reach = max(len(words) + int(MOST_DIFFERENT * len(words)) for _, words, _, _ in self.templates)

    def rank(self, have: list[str]) -> list[tuple[float, int]]:
        """(share saved, template) of all templates, best first."""
        data = " ".join(have).encode("utf-8", "replace")
        size = len(self.plain.compress(data))
        return sorted(((size - len(primed.compress(data))) / saved, -i) for i, (_, _, primed, saved) in enumerate(self.templates))[::-1]

    def saved(self, have: list[str], template: int) -> float:
        """Share saved of the words at one place."""
        data, (_, _, primed, saved) = " ".join(have).encode("utf-8", "replace"), self.templates[template]
        return (len(self.plain.compress(data)) - len(primed.compress(data))) / saved

    def differences(self, have: list[str], template: int) -> tuple[list[str], list[str], int, int]:
        """Template words that are lacking, other words between those there are, the place of the first and that behind the last."""
        want = self.templates[template][1]
        same = [m for m in difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if m.size]
        missing, extra, at, place = [], [], 0, None
        for m in same:
            missing += want[at : m.a]
            extra += have[place : m.b] if place is not None else []
            at, place = m.a + m.size, m.b + m.size
        return missing + want[at:], extra, same[0].b if same else 0, place or 0

    def found(self, have: list[str], template: int) -> Iterator[tuple[int, int, list[str], list[str]]]:
        """(first word, word behind the last, missing, extra) of each place where the template's wording stands."""
        want = self.templates[template][1]
        most = int(MOST_DIFFERENT * len(want))
        # So many words in a row stand unchanged somewhere, as `most` differences part the others into most + 1 runs.
        run = -(-(len(want) - most) // (most + 1))
        matcher = difflib.SequenceMatcher(None, have, want, autojunk=False)
        open_ = [(0, len(have))]
        while open_:
            low, high = open_.pop()
            m = matcher.find_longest_match(low, high, 0, len(want))
            if m.size < run:
                continue
            a, b = max(low, m.a - m.b - most), min(high, m.a - m.b + len(want) + most)
            missing, extra, first, last = self.differences(have[a:b], template)
            good = len(missing) + len(extra) <= most
            if good:
                yield a + first, a + last, missing, extra
            open_ += [(low, a + first), (a + last, high)] if good else [(low, m.a), (m.a + m.size, high)]

    def scan(self, text: str) -> Iterator[tuple[int, str | None, str, float, list[str], list[str]]]:
        """(place, licence or None, best template's licence, share saved, missing, extra) for each notice, and for each segment with a cue but no notice."""
        notices, segments_ = {}, []
        for here, words in blocks(text, self.reach):
            have = [w for w, _, _ in words]
            ranked = self.rank(have)
            for i in (-i for share, i in ranked if share >= LEAST_IN_BLOCK):
                for first, last, missing, extra in self.found(have, i):
                    low, high = words[first][1], words[last - 1][2]
                    unlike, saved = len(missing) + len(extra), self.saved(have[first:last], i)
                    if saved >= LEAST_SAVED:
                        notices[unlike - len(self.templates[i][1]), unlike, i, low, high] = (saved, missing, extra)
            segments_ += [(at, end, have, *ranked[0]) for at, end in here]
        taken: list[tuple[int, int]] = []
        rows = []
        for (_, _, i, low, high), (saved, missing, extra) in sorted(notices.items()):
            at = bisect.bisect(taken, (low, high))
            if (at == 0 or taken[at - 1][1] <= low) and (at == len(taken) or taken[at][0] >= high):
                taken.insert(at, (low, high))
                rows.append((low, self.templates[i][0], self.templates[i][0], saved, missing, extra))
        nearest = None
        for at, end, have, saved, i in segments_:
            before = bisect.bisect(taken, (end,))
            if before == 0 or taken[before - 1][1] <= at:
                if nearest is None or nearest[0] is not have:
                    nearest = (have, *self.differences(have, -i)[:2])
                _, missing, extra = nearest
                rows.append((at, None, self.templates[-i][0], saved, missing, extra))
        yield from sorted(rows, key=lambda r: r[0])


SCHEMA = "doc_id long, start long, licence string, nearest string, saved double, missing array<string>, extra array<string>"


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row for each notice, and each segment with a cue but no notice: doc_id, start (code points), licence, nearest template, share saved, wording differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, names = Scanner(templates), [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
        for batch in batches:
            rows = [(doc_id, *found) for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for found in scanner.scan(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    # Most texts have no cue and never leave the JVM.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(CUES)).mapInArrow(run, SCHEMA)
