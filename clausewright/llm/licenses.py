"""License scans: Dice coefficient over word bigrams of normalised text against licence templates.

A text is its words, lower-cased. For each template the windows between two bigrams that it has are compared with it,
wherever they begin; the threshold t bounds a window's bigrams to t / (2 - t) to (2 - t) / t of the template's, and as
many must be its own as the lower bound, which prunes templates by one count over the text and starts by one count over
the widest window. Of windows that overlap, the one with the most bigrams in common stays, so that a licence's text
outweighs the notices in it."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import freed, values

THRESHOLD = 0.8

# Public licence notices and short licence texts. The longer texts are in the folder `templates`, each in a
# file named by its SPDX name.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MIT-0": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "LGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."],
    "All-Rights-Reserved": ["All rights reserved."],
}
WORD = re.compile(r"[^\W_]+")


def full_texts() -> dict[str, list[str]]:
    return {p.stem: [p.read_text("utf-8")] for p in sorted((Path(__file__).parent / "templates").glob("*.txt"))}


def all_templates() -> dict[str, list[str]]:
    long = full_texts()
    return {name: NOTICES.get(name, []) + long.get(name, []) for name in sorted({*NOTICES, *long})}


class Templates:
    """The templates' bigrams, numbered; one of a single word is paired with nothing and never found."""

    def __init__(self, templates: dict[str, list[str]], threshold: float = THRESHOLD):
        made = [(name, WORD.findall(t.lower())) for name, texts in templates.items() for t in texts]
        made = [(name, words) for name, words in made if len(words) > 1]
        self.threshold, self.names = threshold, [name for name, _ in made]
        self.words: dict[str, int] = {}
        codes = []
        for _, words in made:
            ids = [self.words.setdefault(w, len(self.words)) for w in words]
            codes.append(Counter(a << 32 | b for a, b in zip(ids, ids[1:])))
        self.codes = np.array(sorted(set().union(*codes)), np.int64)
        #: How often each template has each bigram.
        self.times = np.zeros((len(made), len(self.codes)), np.int32)
        for i, c in enumerate(codes):
            self.times[i, np.searchsorted(self.codes, list(c))] = list(c.values())
        self.has = self.times > 0
        self.size = [c.total() for c in codes]
        self.least = [math.ceil(n * threshold / (2 - threshold) - 1e-9) for n in self.size]
        self.most = [math.floor(n * (2 - threshold) / threshold + 1e-9) for n in self.size]

    def places(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, start, end) of its places in a text, in code points, by start."""
        words = WORD.findall(text.lower()) if text else []
        if len(words) < 2 or not len(self.codes):
            return []
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        code = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] << 32 | ids[1:], -1)
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        pos = np.flatnonzero(self.codes[at] == code)
        if not len(pos):
            return []
        bigram = at[pos]
        found = []
        for t, name in enumerate(self.names):
            own = self.has[t, bigram]
            if int(own.sum()) >= self.least[t]:
                found += [(common, d, a, b, name) for common, d, a, b in self.windows(t, pos[own], bigram[own])]
        taken = []
        for common, d, a, b, name in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[4])):
            if all(b < x or y < a for x, y, _, _ in taken):
                taken.append((a, b, d, name))
        if not taken:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        if len(spans) != len(words):  # lower case has other words, as with a dotted capital I
            spans = [(0, len(text))] * len(words)
        return [(name, d, spans[a][0], spans[b + 1][1]) for a, b, d, name in sorted(taken)]

    def windows(self, t: int, pos: np.ndarray, bigram: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(bigrams in common, Dice, first bigram, last bigram) of the best window from each start that has one; after a
        window that equals the template, the next begins behind it."""
        size, times = self.size[t], self.times[t]
        last = np.searchsorted(pos, pos + self.most[t])
        ready = last - np.arange(len(pos)) >= self.least[t]
        if not ready.any():
            return []
        # how many times each bigram came before
        order = np.argsort(bigram, kind="stable")
        sorted_ = bigram[order]
        first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        before = np.empty(len(pos), np.int64)
        before[order] = np.arange(len(pos)) - np.maximum.accumulate(np.where(first, np.arange(len(pos)), 0))
        gone = np.zeros(len(times), np.int64)  # bigrams before the start
        out, done, behind = [], 0, -1
        for i in np.flatnonzero(ready).tolist():
            if pos[i] <= behind:
                continue
            np.add.at(gone, bigram[done:i], 1)
            done = i
            own = bigram[i : last[i]]
            common = (before[i : last[i]] - gone[own] < times[own]).cumsum()
            dice = 2 * common / (pos[i : last[i]] - pos[i] + 1 + size)
            j = int(dice.argmax())
            if dice[j] >= self.threshold - 1e-12:
                out.append((int(common[j]), float(dice[j]), int(pos[i]), int(pos[i + j])))
                if dice[j] == 1:
                    behind = int(pos[i + j])
        return out


def licences(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, start, end): the places of licences in each document's text.

    Null and empty texts hold none. Rows that repeat give repeated results; a null doc_id stays null. Extra columns are
    ignored. Where lower case changes a text's words, a place is the whole text."""
    given = all_templates() if templates is None else templates

    def scan(batches):
        made = Templates(given, threshold)
        for batch in batches:
            rows = [(i, *x) for i, t in zip(batch.column(0).to_pylist(), values(batch.column(1))) for x in made.places(t)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "license", "dice", "start", "end"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(freed(scan), "doc_id long, license string, dice double, start long, end long")
