"""License scans by conditional compression.

Blocks around the words that licenses use are compressed twice: alone, and with a template as raw Zstandard dictionary.
What a template saves is what of it the block holds. Templates are ranked by the bytes saved, and a winner counts only
if its exact wording is there but for few words, which are reported. Short notices and whole license texts are sought
in blocks of their own size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlens.llm.common import query, table, text_batches

# Names of licenses as notices give them.
NAMES = {
    "MIT": ["the MIT License"], "ISC": ["the ISC License"], "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"], "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2"], "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"], "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"], "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0"], "BSL-1.0": ["the Boost Software License, Version 1.0"], "Zlib": ["the zlib License"], "Unlicense": ["the Unlicense"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"],
}
VERBS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "Available under the terms of")
# The wording of licenses, without their copyright lines.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}
_THIRD_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

#: What a block of a license has; sought in lower case first.
CUES = ("licen", "copyright", "permission", "redistribut", "public domain", "warrant", "cc by", "cc0", "creative commons", "spdx")
_CUE = re.compile("|".join(CUES), re.I)
_WORD = re.compile(r"[^\W_]+")
#: Share of a template's words that may be missing or added, and share of its bytes that must be saved.
MAX_DIFFERENT, LEAST_SAVED = 0.1, 0.25
# Words of the notices that don't tell which license is meant.
_NAME_WORDS = frozenset("gnu lesser library affero mozilla mpl apache eclipse boost zlib gpl lgpl agpl bsd mit isc".split())
_VERSION = re.compile(r"v?[0-9]{1,2}")
# What one line says exactly, by SPDX identifier or a name made of it; "+", "-only" and "-or-later" are a part of it.
_SHORT = {
    **{i: re.escape(i).replace(r"\-", "[ -]") for i in NAMES},
    **{f"{g}-{v}": rf"{g}[ -]?v?{re.escape(v).removesuffix('0').removesuffix(chr(92) + '.')}(?:\.0)?" for g, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"))},
}
_SHORT_ID = "|".join(f"(?P<x{n}>{p})" for n, p in enumerate(_SHORT.values()))
_IDENTIFIER = re.compile(rf"(?<![\w.-])(?:{_SHORT_ID})(?:-only|-or-later|\+)?(?![\w+-]|\.[0-9])")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.I)
_SPDX_WORD = re.compile(r"[ \t(]*(?:(AND|OR|WITH)(?![\w-])|([A-Za-z0-9.+:-]+))[ \t)]*", re.I)
_NAMED = re.compile(rf"(?i:\b(?:licensed|released|distributed|available)[ ]under[ ](?:the[ ])?(?:terms[ ]of[ ](?:the[ ])?)?){_IDENTIFIER.pattern}(?i:[ ]licen[sc]e\b)?")
_UNDER = ("released under ", "distributed under ", "available under ")
_COMMON = frozenset("a the this work is licensed released distributed available under terms of license version v international public".split())


class Template:
    def __init__(self, license_id: str, text: str):
        self.license_id, self.text = license_id, text
        self.words = [m.group().lower() for m in _WORD.finditer(text)]
        data = text.encode()
        self.compressor = zstandard.ZstdCompressor(
            level=9, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False
        )
        self.own = _size(data)

    def saved(self, block: bytes, alone: int) -> int:
        return alone - len(self.compressor.compress(block))


@cache
def _plain_compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9, write_checksum=False, write_content_size=False)


def _size(data: bytes) -> int:
    return len(_plain_compressor().compress(data))


@cache
def templates() -> tuple[tuple[int, tuple[Template, ...]], ...]:
    """(longest, templates) of the short notices and of the license texts."""
    texts = dict(TEXTS)
    clauses = texts["BSD-2-Clause"].split("\n\n")
    texts["BSD-3-Clause"] = "\n\n".join([*clauses[:3], _THIRD_CLAUSE, clauses[3]])
    short = [Template(i, f"{verb} {name}.") for i, names in NAMES.items() for name in names for verb in VERBS]
    long = [Template(i, text) for i, text in texts.items()]
    return tuple((max(len(t.text) for t in group), tuple(group)) for group in (short, long))


def blocks(text: str, cues: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """Stretches of the text around the cues that hold any template of up to ``reach`` characters around one whole.

    Overlapping stretches are one; a long one is cut into pieces that overlap by twice ``reach``.
    """
    merged: list[list[int]] = []
    for at in cues:
        low, high = max(0, at - reach), min(len(text), at + reach)
        if merged and low <= merged[-1][1]:
            merged[-1][1] = high
        else:
            merged.append([low, high])
    for low, high in merged:
        while high - low > 6 * reach:
            yield low, low + 6 * reach
            low += 4 * reach
        yield low, high


def wording(template: Template, words: list[str]) -> tuple[int, int, list[str]] | None:
    """(first word, end, differences) of the template in a block's words, or None where too much differs.

    Differences are words missing ("-word") and added ("+word") within the span. None of them may be of the license's
    name or, where it has one, its version.
    """
    matcher = SequenceMatcher(None, template.words, words, autojunk=False)
    runs = [m for m in matcher.get_matching_blocks() if m.size]
    if sum(m.size for m in runs) < (1 - MAX_DIFFERENT) * len(template.words) - 1:
        return None
    # A stray match far from the rest is no part of the span.
    main = max(runs, key=lambda m: m.size)
    runs = [m for m in runs if abs((m.b - m.a) - (main.b - main.a)) <= MAX_DIFFERENT * len(template.words) + 1]
    start, end = runs[0].b, runs[-1].b + runs[-1].size
    differences = []
    for tag, a1, a2, b1, b2 in SequenceMatcher(None, template.words, words[start:end], autojunk=False).get_opcodes():
        if tag != "equal":
            differences += [f"-{w}" for w in template.words[a1:a2]] + [f"+{w}" for w in words[start + b1 : start + b2]]
    most = max(1, int(MAX_DIFFERENT * len(template.words)))
    if sum(d[0] == "-" for d in differences) > most or sum(d[0] == "+" for d in differences) > most:
        return None
    if len(template.words) < 20 and any(d[1:] not in _COMMON for d in differences):
        return None
    versioned = template.license_id[-2:-1] == "."
    if any(d[1:] in _NAME_WORDS or versioned and _VERSION.fullmatch(d[1:]) for d in differences):
        return None
    return start, end, differences


def named_exactly(text: str) -> Iterator[tuple[str, int, int]]:
    """(license, start, end) of SPDX lines, one for each known identifier of the expression, and of "licensed under MIT"."""
    license_ids = list(_SHORT)
    for line in _SPDX.finditer(text):
        start, at, ended = line.start(), line.start(1), False
        # Identifiers and operators take turns; what follows two identifiers in a row is prose.
        while m := _SPDX_WORD.match(text, at, line.end(1)):
            if m[2] and ended:
                break
            ended = bool(m[2])
            if m[2] and (known := _IDENTIFIER.match(text, m.start(2))):
                yield license_ids[int(known.lastgroup[1:])], start, known.end()
            start = at = m.end()
    for m in _NAMED.finditer(text):
        yield license_ids[int(m.lastgroup[1:])], m.start(), m.end()


def licenses_in(text: str) -> list[tuple[str, int, int, int, float, list[str]]]:
    """(license, start, end, bytes saved, share of the template saved, differences), spans in code points, in order."""
    lower = text.lower()
    if not any(c in lower for c in CUES) and not any(v in lower for v in _UNDER):
        return []
    cues = [m.start() for m in _CUE.finditer(text)]
    found = [(*x, 0, 0.0, []) for x in named_exactly(text)]  # nothing is compressed for these
    for reach, group in templates():
        for low, high in blocks(text, cues, reach):
            block = text[low:high]
            spans = [(m.start(), m.end()) for m in _WORD.finditer(block)]
            words = [block[a:b].lower() for a, b in spans]
            data = block.encode()
            alone = _size(data)
            ranked = sorted(((t.saved(data, alone), i, t) for i, t in enumerate(group)), key=lambda x: (-x[0], x[1]))
            free = [True] * len(words)
            likely = [(saved, t) for saved, _, t in ranked if saved >= LEAST_SAVED * t.own]
            # Exact wordings go first, so that none is taken for another one with a word changed.
            for saved, template, exact in [(*x, True) for x in likely] + [(*x, False) for x in likely]:
                # The same template may stand in a block several times: what it has matched is taken out.
                while True:
                    hit = wording(template, [w if f else "" for w, f in zip(words, free)])
                    if hit is None or exact and hit[2]:
                        break
                    first, end, differences = hit
                    free[first:end] = [False] * (end - first)
                    found.append((template.license_id, low + spans[first][0], low + spans[end - 1][1], saved, saved / template.own, differences))
    # The longest of overlapping findings counts: a notice that opens a license text is a part of it.
    kept: list[tuple] = []
    for f in sorted(set((*f[:5], tuple(f[5])) for f in found), key=lambda f: (f[1] - f[2], len(f[5]), -f[3], f)):
        if all(f[2] <= k[1] or k[2] <= f[1] for k in kept):
            kept.append(f)
    return [(*f[:5], list(f[5])) for f in sorted(kept, key=lambda f: f[1])]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings: doc_id, license, start, end, saved_bytes, saved_share, n_differences, differences.

    A document has a row for each license notice or text in it, none where it has none; so null and empty texts give
    no rows, and an empty table an empty result. Repeated rows and null ids are scanned like others; other columns are
    ignored. Spans are code points of the text, the end exclusive.
    """
    types = {"license": "string", "start": "long", "end": "long", "saved_bytes": "long", "saved_share": "double", "n_differences": "long", "differences": "array<string>"}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = rows.select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in types.items())).schema
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            found = [(i, *f[:5], len(f[5]), f[5]) for i, t in enumerate(texts) for f in licenses_in(t)]
            if found:
                at, *columns = zip(*found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds))], schema.names)

    return rows.mapInArrow(run, schema)


@query("op10_licenses")
def op10_licenses(spark, sf_dir):
    """Every license notice and text in the documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
