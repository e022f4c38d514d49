"""License scans by patience alignment.

A document's words (lower case, without outer punctuation) are compared with each template. Regions that hold enough of a
template's words are aligned: anchors are words unique to both region and template, the longest increasing subsequence of
their places (patience piles) is kept, and the gaps between anchors are aligned in the same way; a gap without anchors is
matched by its equal beginning and end. Coverage is the share of the template's words that are matched. The words that tell
a license from its kin (name and version, KEYS) must be matched besides, each phrase without a word in between.

A match reaches over its largest part: words far from it count as matched, but their place is left to other licenses.

Defined results: a null or empty text has no licenses; repeated rows each get a row; extra columns are ignored; of
overlapping matches the one with more matched words stays (ties: higher coverage, then the template's name); an empty table
gives no rows; texts are scanned whole. Versions 3 and 3.0 are the same. A statement that names no single license ("the BSD
License") is none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.base import carried, map_batches

#: Least share of a template's words that must be matched.
COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
# Customary license statements and notices, by SPDX name.
TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "BSD-2-Clause/line": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "BSD-3-Clause/line": "Licensed under the BSD 3-Clause License.",
    "AGPL-3.0/line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-ND-4.0/line": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0/line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0/line": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0/line": "Released under CC0 1.0.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1/line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0/line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/line": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT/line": "Released under the MIT License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_GPL = TEMPLATES["GPL-3.0/notice"]
TEMPLATES |= {
    "AGPL-3.0/notice": _GPL.replace("GNU General", "GNU Affero General"),
    "GPL-2.0/notice": _GPL.replace("version 3", "version 2"),
    "LGPL-2.1/notice": _GPL.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
    "LGPL-3.0/notice": _GPL.replace("GNU General", "GNU Lesser General"),
}
# How a license is named on its own, by SPDX name.
_NAMES = {
    "AGPL-3.0/short": "AGPLv3", "Apache-2.0/name": "Apache License 2.0", "Apache-2.0/short": "Licensed under Apache 2.0", "BSD-2-Clause/name": "BSD 2-Clause License", "BSD-3-Clause/name": "BSD 3-Clause License",
    "CC-BY-4.0/name": "CC BY 4.0", "CC-BY-NC-4.0/name": "CC BY-NC 4.0", "CC-BY-NC-ND-4.0/name": "CC BY-NC-ND 4.0", "CC-BY-NC-SA-4.0/name": "CC BY-NC-SA 4.0", "CC-BY-ND-4.0/name": "CC BY-ND 4.0",
    "CC-BY-SA-4.0/name": "CC BY-SA 4.0", "CC0-1.0/name": "CC0 1.0", "GPL-2.0/short": "GPLv2", "GPL-3.0/short": "GPLv3", "ISC/name": "ISC License", "LGPL-2.1/short": "LGPLv2.1", "LGPL-3.0/short": "LGPLv3",
    "MIT/licensed": "MIT licensed", "MIT/name": "MIT License", "MPL-2.0/name": "Mozilla Public License 2.0",
}
#: Each license's SPDX tag, for the GNU ones also with what the tag says of later versions.
_IDS = sorted({n.split("/")[0] for n in TEMPLATES})
_TAGS = {f"{n}{more}/spdx": f"SPDX-License-Identifier: {n}{more}" for n in _IDS for more in ("", *(("-only", "-or-later") if "GPL" in n else ()))}
TEMPLATES |= _NAMES | _TAGS
#: Phrases that must be matched whole, by template; texts without a name of their own are told apart by their conditions.
KEYS = {
    "AGPL-3.0/line": ("gnu affero general public license version 3",), "AGPL-3.0/notice": ("gnu affero general public license", "version 3"),
    "Apache-2.0/line": ("apache license version 2.0",), "Apache-2.0/notice": ("apache license version 2.0",),
    "BSD-2-Clause/line": ("bsd 2-clause",), "BSD-3-Clause": ("endorse or promote products derived from",), "BSD-3-Clause/line": ("bsd 3-clause",),
    "CC-BY-4.0/line": ("creative commons attribution 4.0",), "CC-BY-4.0/short": ("cc by 4.0",), "CC-BY-NC-4.0/line": ("cc by-nc 4.0",), "CC-BY-NC-ND-4.0/line": ("cc by-nc-nd 4.0",),
    "CC-BY-NC-SA-4.0/line": ("cc by-nc-sa 4.0",), "CC-BY-ND-4.0/line": ("cc by-nd 4.0",), "CC-BY-SA-4.0/line": ("cc by-sa 4.0",),
    "CC0-1.0/line": ("cc0 1.0",), "CC0-1.0/notice": ("waived all copyright",),
    "GPL-2.0/line": ("gnu general public license version 2",), "GPL-2.0/notice": ("gnu general public license", "version 2"),
    "GPL-3.0/line": ("gnu general public license version 3",), "GPL-3.0/notice": ("gnu general public license", "version 3"),
    "ISC": ("provided that the above copyright notice",),
    "LGPL-2.1/line": ("gnu lesser general public license version 2.1",), "LGPL-2.1/notice": ("gnu lesser general public license", "version 2.1"),
    "LGPL-3.0/line": ("gnu lesser general public license version 3",), "LGPL-3.0/notice": ("gnu lesser general public license", "version 3"),
    "MIT/line": ("mit license",), "MPL-2.0": ("mozilla public license v 2.0",), "Unlicense": ("unencumbered software", "public domain"),
} | {n: (t,) for n, t in (_NAMES | _TAGS).items()}
#: Words of the text that a match may skip between two matched ones, beyond what it skips of the template; more part it.
SLACK = 3


def words_of(text: str) -> list[str]:
    return [w.lower().removesuffix(".0") for w in WORD.findall(text)]


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    pile: list[int] = []
    behind: list[int] = []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        behind.append(pile[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            pile.append(i)
        else:
            tops[p], pile[p] = v, i
    out = []
    at = pile[-1] if pile else -1
    while at >= 0:
        out.append(at)
        at = behind[at]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of a and b. Gaps are kept on a stack of their own, so depth is no limit."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a.get(w) == 1}
        pairs = [(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if w in at_b]
        if not pairs:
            continue
        kept = [pairs[i] for i in increasing([j for _, j in pairs])]
        out += kept
        last = (a0, b0)
        for i, j in [*kept, (a1, b1)]:
            todo.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
    return sorted(out)


def largest_part(pairs: list[tuple[int, int]], slack: int) -> list[tuple[int, int]]:
    """Of a match the part with the most words, where parts are far from each other in the text: common words of another
    statement ("under the") are no part of this one."""
    cuts = [i for i in range(1, len(pairs)) if pairs[i][0] - pairs[i - 1][0] > pairs[i][1] - pairs[i - 1][1] + slack]
    parts = [pairs[a:b] for a, b in zip([0, *cuts], [*cuts, len(pairs)], strict=True)]
    return max(parts, key=len)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, keys: dict[str, tuple[str, ...]] = KEYS):
        self.coverage = coverage
        self.templates = []
        for name, text in sorted(templates.items()):
            words = words_of(text)
            if words:
                phrases = [words_of(k) for k in keys.get(name, ())]
                places = [[range(j, j + len(p)) for j in range(len(words)) if words[j : j + len(p)] == p] for p in phrases]
                named = frozenset(w for p in phrases for w in p)
                self.templates.append((name, words, frozenset(words), -(-len(words) * int(coverage * 1000) // 1000), named, places))

    @staticmethod
    def names(pairs: list[tuple[int, int]], places: list[list[range]]) -> bool:
        """Whether each phrase is matched at one of its places in the template, by words in a row."""
        at = {j: i for i, j in pairs}
        whole = lambda p: p[0] in at and all(at.get(j) == at[p[0]] + j - p[0] for j in p)
        return all(any(map(whole, ps)) for ps in places)

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, template, coverage) in code points of the text, by start."""
        spans = [m.span() for m in WORD.finditer(text)]
        words = words_of(text)
        there = set(words)
        found = []
        for name, own, distinct, least, named, places in self.templates:
            # every matched word is one of these, so fewer distinct ones cannot cover enough
            both = distinct & there
            if not named <= there or sum(w in both for w in own) < least:
                continue
            hit = np.fromiter((w in both for w in words), np.int64, len(words))
            sums = np.append(0, np.cumsum(hit))
            width = min(len(words), 2 * len(own))
            dense = np.flatnonzero(sums[width:] - sums[: len(sums) - width] >= least)  # starts of windows that may hold the template
            if not len(dense):
                continue
            cuts = np.flatnonzero(np.append(True, np.diff(dense) > 1))
            for lo, hi in zip(dense[cuts].tolist(), dense[np.append(cuts[1:], len(dense)) - 1].tolist(), strict=True):
                at, end = lo, hi + width
                while end - at >= least:  # one alignment after another, each beginning behind the last match
                    begin = at + int(np.argmax(hit[at:end]))
                    if not hit[begin] or end - begin < least:
                        break
                    pairs = aligned(words[begin : min(begin + width, end)], own)
                    if len(pairs) >= least and self.names(pairs, places):
                        slack = max(SLACK, len(own) // 8)
                        core = largest_part(pairs, slack)
                        first = begin + core[0][0]
                        again = aligned(words[first : first + width], own)  # its end may lie behind the window that began earlier
                        if len(again) >= len(pairs) and self.names(again, places):
                            begin, pairs, core = first, again, largest_part(again, slack)
                        a, z = begin + core[0][0], begin + core[-1][0]
                        found.append((len(pairs), len(pairs) / len(own), name, a, z + 1))
                        at = z + 1
                    else:
                        at = begin + 1
        out: list[tuple[int, float, str, int, int]] = []
        for f in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
            if not any(f[3] < o[4] and o[3] < f[4] for o in out):
                out.append(f)
        return sorted((spans[a][0], spans[z - 1][1], name, cov) for _, cov, name, a, z in out)


FOUND = "array<struct<start:bigint,end:bigint,license:string,coverage:double>>"
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("coverage", pa.float64())]))


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns named in keep and licenses (start, end, license, coverage) of every row."""
    rows, ddl, rest, _ = carried(docs, text, keep, ("licenses",))

    def scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = Scanner(templates, coverage)
        cells = [[dict(zip(("start", "end", "license", "coverage"), f, strict=True)) for f in scanner.scan(t)] for t in batch.columns[-1].to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cells, _FOUND)], names=[*rest, "licenses"])

    return map_batches(rows, scanned, f"{ddl}, licenses {FOUND}")
