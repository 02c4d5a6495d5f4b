"""License notices by conditional compression.

Blocks around licence cues are compressed with zstandard, once alone and once
with each template as a raw dictionary.  The reduction in size is reported as
the gain and orders the templates; every template is held against the block by
the exact differences in wording: short notices must occur word for word, long
texts may differ in a tenth of their words (names, years).

Whole texts are searched.  A block is the cue's line, for short notices, or the
stretch of lines around it that could hold the longest template; the rest of
the text plays no part, so memory follows the templates, not the document.

Defined cases: null and empty texts, and texts without a confirmed notice, give
no row; the same notice at several places gives a row for each; templates with
equal gain keep the list's order, and where notices overlap the longest, then the
first, then the one with fewer differences, then the first by name stays; repeated
rows give repeated results; extra input columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import slices

#: Names and wording of common licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
CUES = ("licen", "permission", "redistribut", "public domain")
SHORT = 24
"""Templates of up to so many words must occur exactly."""
TOLERANCE = 0.1
WORDS = re.compile(r"[A-Za-z0-9]+(?:[.'+-][A-Za-z0-9]+)*")


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORDS.finditer(text)]


class Template:
    def __init__(self, name: str, text: str) -> None:
        self.name = name
        self.words = [w for w, _, _ in words_of(text)]
        self.counts = Counter(self.words)
        self.short = len(self.words) <= SHORT
        self.span = len(text)
        self.size = len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(text.lower().encode()))
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)

    def differences(self, block: list[tuple[str, int, int]]) -> tuple[int, int, int, int] | None:
        """(missing, added, first word, last word) against the best place in the block, if near enough."""
        own = [w for w, _, _ in block]
        n = len(self.words)
        if self.short:
            for i in range(len(own) - n + 1):
                if own[i] == self.words[0] and own[i : i + n] == self.words:
                    return 0, 0, i, i + n - 1
            return None
        if (self.counts & Counter(own)).total() < n - TOLERANCE * n:  # too few of its words are there in any order
            return None
        matches = [m for m in difflib.SequenceMatcher(None, self.words, own, autojunk=False).get_matching_blocks() if m.size >= 2]
        if not matches:
            return None
        same = sum(m.size for m in matches)
        first, last = matches[0].b, matches[-1].b + matches[-1].size - 1
        missing, added = n - same, last - first + 1 - same
        return (missing, added, first, last) if missing + added <= TOLERANCE * n else None

    def places(self, block: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """``differences`` of every place that passes: the words before and behind one are searched again."""
        todo = [(0, len(block))]
        while todo:
            a, b = todo.pop()
            if got := self.differences(block[a:b]) or self._among(block[a:b]):
                missing, added, first, last = got
                yield missing, added, a + first, a + last
                todo += [(a, a + first), (a + last + 1, b)]

    def _among(self, block: list[tuple[str, int, int]]) -> tuple[int, int, int, int] | None:
        """A place that the longest runs of a block hide, as when several changed copies share them.

        A place that passes keeps all but two of its pairs of words for each
        difference, and they start within the tolerance of each other.
        """
        n = len(self.words)
        slack = int(TOLERANCE * n)
        if self.short or len(block) <= n + slack:
            return None
        pairs: dict[tuple[str, str], list[int]] = {}
        for i, pair in enumerate(zip(self.words, self.words[1:])):
            pairs.setdefault(pair, []).append(i)
        starts = sorted(j - i for j, (x, y) in enumerate(zip(block, block[1:])) for i in pairs.get((x[0], y[0]), ()))
        upto, tried = 0, None
        for k, start in enumerate(starts):
            while upto < len(starts) and starts[upto] <= start + slack:
                upto += 1
            if start != tried and upto - k >= n - 1 - 2 * slack:
                tried, low = start, max(start, 0)
                if got := self.differences(block[low : start + slack + n]):
                    return got[0], got[1], got[2] + low, got[3] + low
        return None


@lru_cache(maxsize=1)
def prepared() -> tuple[list[Template], zstandard.ZstdCompressor, int]:
    found = [Template(name, text) for name, text in TEMPLATES]
    return found, zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False), 2 * max(t.span for t in found)


def _ranked(block: str, short: bool) -> list[tuple[float, Template]]:
    """Templates by the reduction each brings to the block's size, as a share of its own size or the block's, the lesser."""
    templates, plain, _ = prepared()
    data = block.lower().encode("utf-8", "surrogatepass")
    alone = len(plain.compress(data))
    gains = [((alone - len(t.compressor.compress(data))) / min(alone, t.size), i, t) for i, t in enumerate(templates) if t.short == short]
    return [(g, t) for g, _, t in sorted(gains, key=lambda x: (-x[0], x[1]))]


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, for short notices) of the stretches around cues, merged where they meet."""
    low = text.lower()
    if len(low) != len(text) or not any(c in low for c in CUES):
        if len(low) == len(text):
            return []
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    reach = prepared()[2]
    places = sorted({m.start() for c in CUES for m in re.finditer(re.escape(c), low)})
    lines: list[list[int]] = []
    wide: list[list[int]] = []
    for p in places:
        a = max(text.rfind("\n", max(0, p - reach), p) + 1, p - reach, 0)
        b = text.find("\n", p, p + reach)
        b = min(len(text), p + reach) if b < 0 else b
        for held, start, end in ((lines, a, b), (wide, max(0, p - reach), min(len(text), p + reach))):
            # overlapping stretches become one; cues follow each other in order
            if held and start < held[-1][1]:
                held[-1][1] = max(held[-1][1], end)
            else:
                held.append([start, end])
    return [(a, b, True) for a, b in lines] + [(a, b, False) for a, b in wide]


def find(text: str | None) -> list[tuple[str, int, int, float, int, int]]:
    """(licence, start, end, gain, missing, added) of each confirmed notice, longest first where they overlap."""
    found = []
    for a, b, short in blocks(text) if text else []:
        step = 2 * prepared()[2]
        for at in range(a, b, step):  # long runs of cues are taken piece by piece, overlapping by the reach
            end = min(b, at + step + prepared()[2])
            block = text[at:end]
            own = words_of(block)
            for gain, template in _ranked(block, short):
                for missing, added, first, last in template.places(own):
                    found.append((template.name, at + own[first][1], at + own[last][2], round(gain, 4), missing, added, len(template.words)))
    found = sorted(set(found), key=lambda f: (-f[6], f[1], f[4] + f[5], f[0]))
    kept: list[tuple] = []
    for f in found:
        if not any(f[1] < k[2] and k[1] < f[2] for k in kept):
            kept.append(f)
    return sorted((f[:6] for f in kept), key=lambda f: (f[1], f[2]))


SCHEMA = "license string, start bigint, end bigint, gain double, missing int, added int"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per confirmed notice: ``doc_id`` and SCHEMA.  No shuffle."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                at, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    for f in find(text):
                        at.append(i)
                        rows.append(f)
                if rows:
                    columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *columns], ["doc_id", "license", "start", "end", "gain", "missing", "added"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
