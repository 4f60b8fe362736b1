"""License scans: conditional compression against templates, confirmed by exact wording."""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklathe.llm._shared import table

HOLDER = "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_END = f"THIS SOFTWARE IS PROVIDED BY {HOLDER} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
MIT = f"{MIT_GRANT}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS}"
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
UNLICENSE = f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. {AS_IS}"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
IDENTIFIERS = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC MPL-2.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later"
#: Production parameters: the wordings looked for, by license: full texts, notices and identifiers. Several wordings of one
#: license are ranked separately. A clause that two licenses share is filed under both names.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", MIT_GRANT),
    ("MIT", MIT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", GPL.format("", 2)),
    ("GPL-3.0", GPL.format("", 3)),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", GPL.format("Lesser ", 3)),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", GPL.format("Affero ", 3)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause or BSD-3-Clause", BSD_OPENING),
    ("BSD-2-Clause", BSD_OPENING + BSD_END),
    ("BSD-3-Clause", BSD_OPENING + BSD_THIRD + BSD_END),
    ("BSD-3-Clause", BSD_OPENING + BSD_THIRD),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", ISC),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", UNLICENSE),
    *((name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS.split()),
]
#: Least share of its window's compressed size that a template must save.
SAVING = 0.15
#: Least share of the template's words that must stand in the block in order.
WORDING = 0.9
#: Least share of the template's words that must stand in a window, in any order, for it to be a candidate.
LIKELY = 0.5
LEVEL = 19
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Words that tell licenses apart: none may be missing from the block, and none may be added within the wording.
TELLING = frozenset("mit apache bsd gnu gpl lgpl agpl lesser affero general library mozilla cc cc0 by by-sa by-nc by-nd by-nc-sa by-nc-nd creative commons attribution noncommercial sharealike noderivatives not".split())
SCHEMA = "doc_id long, block_start long, license string, template int, saving double, wording double, missing array<string>, added array<string>, confirmed boolean"


def words(text: str) -> list[str]:
    return [w.strip(".-") for w in WORD.findall(text.lower())]


def cues(own: list[str]) -> list[tuple[str, int]]:
    """Words of a template and their places, one more than a confirmed wording may lack, so it has one of them; the longest."""
    most = math.floor((1 - WORDING) * len(own) + 1e-9)
    return [(own[j], j) for j in sorted(range(len(own)), key=lambda j: (-len(own[j]), j))[: most + 1]]


def normal(own: list[str]) -> bytes:
    return " ".join(own).encode("utf-8", "replace")


@lru_cache(4)
def machines(templates: tuple[tuple[str, str], ...]) -> tuple:
    """A compressor without and one with each template as raw dictionary, the templates' words, places of their cues by word, and a search for any cue."""
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    having, texts = [], [words(t) for _, t in templates]
    marks: dict[str, list[tuple[int, int]]] = {}
    search = ahocorasick.Automaton()
    for k, own in enumerate(texts):
        raw = zstandard.ZstdCompressionDict(normal(own), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        having.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False))
        for word, j in cues(own):
            marks.setdefault(word, []).append((k, j))
            search.add_word(word, word)
    search.make_automaton()
    return plain, having, texts, marks, search


def compare(template: list[str], block: list[str]) -> tuple[float, list[str], list[str], list[int]]:
    """Share of the template's words that stand in the block in order; words missing; words added within the wording; places matched."""
    match = difflib.SequenceMatcher(None, template, block, autojunk=False)
    runs = [m for m in match.get_matching_blocks() if m.size]
    if not runs:
        return 0.0, template, [], []
    missing, added, t, b = [], [], 0, runs[0].b
    for m in runs:
        missing += template[t : m.a]
        added += block[b : m.b]
        t, b = m.a + m.size, m.b + m.size
    tail = template[t:]
    missing += tail
    added += block[b : b + len(tail)]  # what stands in place of the end
    return 1 - len(missing) / len(template), missing, added, [j for m in runs for j in range(m.b, m.b + m.size)]


def windows(own: list[str], texts: list[list[str]], marks: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
    """Template and first word of each window in which a cue of the template stands at its place."""
    seen = set()
    for i, word in enumerate(own):
        for k, j in marks.get(word, ()):
            if (k, i - j) not in seen:
                seen.add((k, i - j))
                yield k, i - j


def placed(text: str, templates: tuple[tuple[str, str], ...]) -> list[tuple]:
    """Start and row of each wording in the text.

    A template is compared, by words and by compression, with windows of its own length around each of its cues,
    narrow ones first, so the text around doesn't count.
    """
    plain, having, texts, marks, _ = machines(templates)
    spans = list(WORD.finditer(text))
    own = [m[0].lower().strip(".-") for m in spans]
    bags = [Counter(t) for t in texts]
    sure, unsure = [], []

    def saved(k: int, lo: int, hi: int) -> tuple[int, float]:
        raw = normal(own[lo:hi])
        size = len(plain.compress(raw))
        less = size - len(having[k].compress(raw))
        return less, less / size

    for k, lo in windows(own, texts, marks):
        n = len(texts[k])
        hi, reach = lo + n, n // 2 + 2
        there = 0
        for more in (n // 10 + 1, reach):
            first, last = max(lo - more, 0), hi + more
            there = (Counter(own[first:last]) & bags[k]).total()
            if there < WORDING * n - 1e-9:
                continue
            share, missing, added, at = compare(texts[k], own[first:last])
            if share >= WORDING - 1e-9 and not any(w in TELLING or any(c.isdigit() for c in w) for w in missing + added):
                less, saving = saved(k, first + at[0], first + at[-1] + 1)
                if saving >= SAVING:
                    sure.append((-less, k, first + at[0], (templates[k][0], k, round(saving, 6), round(share, 6), missing, added, True), frozenset(first + j for j in at)))
                    break
        else:
            less, saving = saved(k, max(lo, 0), hi) if there >= LIKELY * n and hi > 0 else (0, 0.0)
            if saving >= SAVING:
                unsure.append((-less, k, max(lo, 0), min(hi, len(own)), reach, saving))
    rows, taken = [], set()
    for _, _, first, row, at in sorted(sure, key=lambda x: x[:3]):
        if taken.isdisjoint(at):
            taken |= at
            rows.append((spans[first].start(), row))
    for _, k, lo, hi, reach, saving in sorted(unsure):
        near = range(max(lo - reach, 0), hi + reach)
        if taken.isdisjoint(near):
            taken.update(near)
            share, missing, added, _ = compare(texts[k], own[near.start : near.stop])
            rows.append((spans[lo].start(), (templates[k][0], k, round(saving, 6), round(share, 6), missing, added, False)))
    return sorted(rows, key=lambda x: (x[0], x[1][1]))


def examine(text: str, templates: tuple[tuple[str, str], ...]) -> list[tuple]:
    return [row for _, row in placed(text, templates)]


def found(text: str, templates: tuple[tuple[str, str], ...]) -> Iterator[tuple]:
    """Rows for one text, which is split into words only if some cue is in it."""
    search = machines(templates)[-1]
    if len(search) and next(search.iter(text.lower()), None) is not None:
        yield from ((at, *row) for at, row in placed(text, templates))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Places of documents that have a license's wording: a row for each place.

    Columns: doc_id, block_start (character at which the wording, or the window compared, begins), license and template
    (place in the list), saving (share of the compressed size of the wording's own place, in lower-case words, that the
    template as raw dictionary saves), wording (share of the template's words that stand there in order), missing and
    added words, confirmed. A wording is confirmed if it holds with no telling word (names, versions, "not") missing or
    added. Each wording
    takes only the words that it matched; of those that share words, the one that saves most bytes is given. Where none is confirmed, the template that saves most is given unconfirmed. Ties in saving
    go to the earlier template.

    A window is a candidate if one of the template's cues stands at its place in it. The cues come from the templates: so
    many words of each that no wording with the share WORDING can lack them all. A window with less than the share LIKELY
    of the template's words is not compressed. Windows run over lines, blank ones too.

    Whole texts are read, in one pass without a shuffle; one search for all cues at once spares the texts without any.

    Defined results: null and empty texts and texts without cues give no rows; null doc_id is kept; repeated rows give
    their rows again; an empty table, or no templates, gives an empty table; a template without words is never found.
    Other columns are ignored.
    """
    wanted = tuple((str(a), str(b)) for a, b in templates)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("block_start", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("saving", pa.float64()), ("wording", pa.float64()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string())), ("confirmed", pa.bool_())])
        for b in batches:
            rows = [(i, *row) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for row in found(t.as_py(), wanted)]
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], schema=kind)

    return docs.where("length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
