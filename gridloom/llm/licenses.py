"""License scans: normalised text against license templates by Dice over word bigrams.

Candidates are all runs of words of the whole text, whatever lines or paragraphs they stand in.
Dice 2c / (a + b) reaches t only if c is t / (2 - t) of b, so a run lacks at most the rest of a
template's bigrams: it holds one of any set that is one larger.  Most texts hold no such anchor of
any template and are passed over; of the others those that lack too many bigrams are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import id_and_text, row_slices

#: Public license texts and notices (fixed values), normalised on use.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-2.1 notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/.""",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Whole license texts, by the file that holds them.
TEXTS = {"Apache-2.0 text": "Apache-2.0", "CC0-1.0 text": "CC0-1.0", "GPL-2.0 text": "GPL-2", "GPL-3.0 text": "GPL-3", "LGPL-2.1 text": "LGPL-2.1", "LGPL-3.0 text": "LGPL-3", "MPL-2.0 text": "MPL-2.0"}
TEMPLATES |= {name: (Path(__file__).parent / "license_texts" / f"{file}.txt").read_text(encoding="utf-8") for name, file in TEXTS.items()}

_WORD = re.compile(r"[^\W_]+")
_COPYRIGHT = re.compile(r"(?m)^[^\w\n]*copyright\b.*$")


def blocks_of(text: str) -> list[list[str]]:
    """Normalised words, lower-cased runs of letters and digits: of the text without copyright lines, and of each such line."""
    low = text.lower()
    lines = _COPYRIGHT.findall(low) if "copyright" in low else []
    return [_WORD.findall(_COPYRIGHT.sub(" ", low) if lines else low), *map(_WORD.findall, lines)]


def words_of(text: str) -> list[str]:
    """The words without copyright lines."""
    return blocks_of(text)[0]


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(words, words[1:], strict=False))


class Matcher:
    def __init__(self, templates: Mapping[str, str], threshold: float):
        self.sets = sorted(((len(b), name, b) for name, t in templates.items() if (b := bigrams(words_of(t)))), key=lambda x: x[:2])
        self.threshold, self.ratio = threshold, threshold / (2 - threshold)
        # The least count of a template's bigrams that a match holds; rounding errors must not raise it.
        self.least = [max(1, ceil(size * self.ratio - 1e-9)) for size, _, _ in self.sets]
        # Long words are rare; which bigrams are the anchors only bears on speed.
        self.anchors = [frozenset(sorted(b, key=lambda x: (-len(x[0]) - len(x[1]), x))[: size - least + 1]) for (size, _, b), least in zip(self.sets, self.least, strict=True)]
        self.any = frozenset().union(*self.anchors)

    def windows(self, pairs: list[tuple[str, str]], size: int, template: frozenset, least: int) -> list[tuple[float, int, int, int]]:
        """For each bigram of the template in the text, the best run that begins there: Dice, shared bigrams, first and last place.

        A run whose first or last bigram is not the template's, or occurs in it again, can be cut without a loss.  A bigram
        is new to a run if it stood before only ahead of the run's start: sums over that tell a start's runs all at once.
        """
        found, most = [], size / self.ratio + 1e-9
        inside = np.fromiter((p in template for p in pairs), dtype=bool, count=len(pairs))
        before, after = np.full(len(pairs), -1), np.full(len(pairs), len(pairs))
        last: dict = {}
        for i, p in enumerate(pairs):
            if (at := last.get(p)) is not None:
                before[i], after[at] = at, i
            last[p] = i
        # A start is worth a look if enough of the template's bigrams stand at or behind it: the last place of each, from behind.
        rest = np.cumsum((inside & (after == len(pairs)))[::-1])[::-1]
        for start in np.flatnonzero(inside & (rest >= least)).tolist():
            length, upto = int(most) + 1, int(after[start])
            while True:
                end = min(start + length, upto)
                new = before[start:end] < start
                seen = np.cumsum(new)
                if end == upto or seen[-1] > most:
                    break
                length *= 2
            shared = np.cumsum(new & inside[start:end])
            ends = np.flatnonzero(inside[start:end] & (seen <= most) & (shared >= least))
            if len(ends):
                dice = 2 * shared[ends] / (seen[ends] + size)
                best = int(np.argmax(dice))  # the first of equal ones
                if dice[best] >= self.threshold:
                    found.append((float(dice[best]), int(shared[ends[best]]), start, start + int(ends[best])))
        return found

    def scan(self, text: str) -> list[tuple[str, float, tuple[int, int]]]:
        """License, Dice and place (block and word) of matches; of those that overlap the one that explains more stays."""
        out: list[tuple[str, float, tuple[int, int]]] = []
        for number, words in enumerate(blocks_of(text)):
            if self.any.isdisjoint(zip(words, words[1:], strict=False)):
                continue
            pairs = list(zip(words, words[1:], strict=False))
            own, found = frozenset(pairs), []
            for (size, name, template), anchors, least in zip(self.sets, self.anchors, self.least, strict=True):
                if not anchors.isdisjoint(own) and len(template & own) >= least:
                    found.extend((-dice * shared, size, name, dice, first, last) for dice, shared, first, last in self.windows(pairs, size, template, least))
            taken = bytearray(len(words))
            for _, _, name, dice, first, last in sorted(found):
                if not any(taken[first : last + 2]):
                    taken[first : last + 2] = b"\1" * (last + 2 - first)
                    out.append((name, dice, (number, first)))
        return out


def license_scan(df: DataFrame, *, templates: Mapping[str, str] | None = None, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, license and dice of the best match, n_matches and licenses (sorted distinct names).

    Every run of a text's words is compared; ``templates`` are name -> text.  Of runs that overlap the one with
    the most shared bigrams times Dice counts, of equal ones the smaller template, then the first name.  Rows without a match, null and empty
    texts have null license and dice, 0 matches and an empty array.
    Texts of any length are read whole; equal rows give equal rows, ids may be null or repeat; an empty table gives no rows.
    """
    known = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(known, threshold)
        for batch in batches:
            for piece in row_slices(batch):
                rows = [matcher.scan(t) for t in piece.column("text").to_pylist()]
                best = [max(r, key=lambda x: x[1]) if r else (None, None, None) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array([len({(x[0], x[2]) for x in r}) for r in rows], pa.int64()), pa.array([sorted({x[0] for x in r}) for r in rows], pa.list_(pa.string()))],
                    ["doc_id", "license", "dice", "n_matches", "licenses"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    out = id_and_text(df, id_col, text_col).mapInArrow(run, f"doc_id {kind}, license string, dice double, n_matches long, licenses array<string>")
    return out.withColumnRenamed("doc_id", id_col)
