"""License scanning by conditional compression.

Documents are cut into segments; runs of segments that hold a cue or a
three-word phrase of some template, or a part of one that line ends break, are
the candidate blocks.
Each block is compressed alone and with each template as a raw zstandard
dictionary; templates are ranked by the share of the size that they save, and
the best whose wording the block really has, word for word but for listed
differences, wins; the words before and after it are judged in the same way,
until no template fits. A difference in a number (a version) never passes.

Nulls and edges: null and empty texts have no blocks; several blocks of a
document are judged one by one; ties in the saving go to the earlier template;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame

from hazmill.llm.common import scan_texts

# Notices by which texts state their license.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("All-Rights-Reserved", "Copyright. All rights reserved."),
]

# Whole license texts, without the line that names the owner.
TEXTS: list[tuple[str, str]] = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
]

CUE = r"(?i)licen[cs]e|copyright|public\s+domain|creative\s+commons|permission\s+is\s+hereby|redistribution\s+and\s+use|free\s+software"

#: Share of a template's words that a block must have, and differing words allowed for each ten of the template's.
COVERAGE, DIFFERENCES_IN_TEN = 0.8, 1

_WORD = re.compile(r"[^\W_]+")
_SEGMENT = re.compile(r"[^\n]*?[.!?:;](?=\s|$)|[^\n]+")
_MATCH = "array<struct<license:string,start:int,end:int,saving:double,differences:string>>"


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _phrases(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], words[2:], strict=False))


class Matcher:
    """Templates as dictionaries; made once for each task."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.plain = zstandard.ZstdCompressor(level=19)
        self.templates = []
        for name, text in templates:
            dictionary = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, _words(text), zstandard.ZstdCompressor(level=19, dict_data=dictionary)))
        self.grams = [_phrases(w) for _, w, _ in self.templates]
        self.phrases = set().union(*self.grams)
        self.cue = re.compile(CUE)

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Runs of neighbouring segments that hold a cue or a template's phrase, or a part of it."""
        marks = [m.span() for m in self.cue.finditer(text)]
        words = _words(text)
        if not self.phrases.isdisjoint(zip(words, words[1:], words[2:], strict=False)):
            placed = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
            marks += [(x[1], z[2]) for x, y, z in zip(placed, placed[1:], placed[2:], strict=False) if (x[0], y[0], z[0]) in self.phrases]
        if not marks:
            return
        marks.sort()
        start = end = None
        k = upto = 0
        for m in _SEGMENT.finditer(text):
            while k < len(marks) and marks[k][0] < m.end():
                upto = max(upto, marks[k][1])
                k += 1
            if upto > m.start():
                start, end = m.start() if start is None else start, m.end()
            elif start is not None and m[0].strip():
                yield start, end
                start = None
        if start is not None:
            yield start, end

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(share of the compressed size that the template saves, template), most first."""
        raw = block.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / alone, k) for k, (_, _, c) in enumerate(self.templates)), key=lambda x: (-x[0], x[1]))

    def differences(self, block: list[str], template: list[str]) -> tuple[list[str], int, int] | None:
        """The exact differences of wording and the block's words from and to which it reaches; None if the block does not have it."""
        matcher = difflib.SequenceMatcher(None, block, template, autojunk=False)
        equal = [x for x in matcher.get_matching_blocks() if x.size]
        if sum(x.size for x in equal) < COVERAGE * len(template):
            return None
        first, last = equal[0], equal[-1]
        out: list[str] = []
        if first.b:
            out.append("-" + " ".join(template[: first.b]))
        for x, y in zip(equal, equal[1:], strict=False):
            had, has = template[x.b + x.size : y.b], block[x.a + x.size : y.a]
            out.append(f"-{' '.join(had)}+{' '.join(has)}" if had and has else f"-{' '.join(had)}" if had else f"+{' '.join(has)}")
        if last.b + last.size < len(template):
            out.append("-" + " ".join(template[last.b + last.size :]))
        changed = sum(len(re.findall(r"\w+", d)) for d in out)
        if changed * 10 > DIFFERENCES_IN_TEN * len(template) or any(re.search(r"\d", d) for d in out):
            return None
        return out, first.a, last.a + last.size

    def best(self, part: str, words: list[str]) -> tuple[dict, int, int] | None:
        here = _phrases(words)
        for saving, k in self.ranked(part):
            name, wording, _ = self.templates[k]
            # a short notice in a long block may save nothing: then half of its phrases must speak for it
            grams = self.grams[k]
            if saving <= 0 and 2 * len(grams & here) < len(grams):
                continue
            if (found := self.differences(words, wording)) is not None:
                return {"license": name, "saving": round(saving, 6), "differences": ";".join(found[0])}, *found[1:]
        return None

    def scan(self, text: str) -> list[dict]:
        found = []
        for start, end in self.blocks(text):
            placed = [(start + m.start(), start + m.end()) for m in _WORD.finditer(text[start:end])]
            here, parts = [], [(0, len(placed), start, end)]
            while parts:
                a, b, s, e = parts.pop()
                words = [text[x:y].lower() for x, y in placed[a:b]]
                if words and (won := self.best(text[s:e], words)) is not None:
                    match, first, last = won
                    here.append((a + first, match | {"start": placed[a + first][0], "end": placed[a + last - 1][1]}))
                    for x, y in ((a, a + first), (a + last, b)):
                        if x < y:
                            parts.append((x, y, placed[x][0], placed[y - 1][1]))
            found += [match for _, match in sorted(here, key=lambda x: x[0])]
        return found


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id and matches: the templates found in each block, in order, with their own places in code points, first word to last."""
    chosen = [*TEMPLATES, *TEXTS] if templates is None else templates

    def make():
        matcher = Matcher(chosen)
        return lambda texts: {"matches": [matcher.scan(t) for t in texts]}

    return scan_texts(docs, make, f"matches {_MATCH}")
