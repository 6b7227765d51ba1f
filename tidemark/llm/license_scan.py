"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A text is read as a whole, by paragraph, by line and by sentence; each unit is compared with the templates
whose number of bigrams can reach the threshold at all: for a coefficient of t the sizes a and b must satisfy
t / (2 - t) <= a / b <= (2 - t) / t. A template that no unit reaches, such as one wrapped over lines or parted into
paragraphs within a longer text, is sought in every window of words; a unit's coefficient is not replaced by that
of a window. Templates are a small fixed table that every task has.
"""

from __future__ import annotations

import bisect
import re
from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows

THRESHOLD = 0.8
# Notices and standard headers of common licences.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "bsd-3-clause-grant": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "isc-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "unlicense-grant": """This is free and unencumbered software released into the public domain.""",
}
_WORDS = re.compile(r"[^\W_]+")
_PARAGRAPHS, _SENTENCES = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?:;])\s+")


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Different pairs of neighbouring words, lower case, without punctuation."""
    w = _WORDS.findall(text.lower())
    return frozenset(zip(w, w[1:]))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def units(text: str) -> set[str]:
    """The text, its paragraphs, lines and sentences; equal ones once."""
    lines = text.split("\n")
    out = {text, *_PARAGRAPHS.split(text), *lines}
    for line in lines:
        out.update(_SENTENCES.split(line))
    return out


class Templates:
    def __init__(self, texts: dict[str, str], threshold: float):
        self.threshold = threshold
        self.sorted = sorted((len(bigrams(t)), name, bigrams(t)) for name, t in texts.items())
        self.sizes = [x[0] for x in self.sorted]
        self.known = frozenset().union(*(x[2] for x in self.sorted))
        self.words = frozenset(w for pair in self.known for w in pair)
        self.ratio = (2 - threshold) / threshold
        self.longest = max(self.sizes, default=0) * self.ratio

    def candidates(self, size: int):
        """Templates of sizes that can reach the threshold with a unit of the given size."""
        lo = bisect.bisect_left(self.sizes, size / self.ratio - 1e-9)
        hi = bisect.bisect_right(self.sizes, size * self.ratio + 1e-9)
        return self.sorted[lo:hi]

    def possible(self, pairs: list) -> list:
        """Templates of which the text has so many bigrams that a part of it can reach the threshold."""
        here = self.known.intersection(pairs)
        least = self.threshold / (2 - self.threshold)
        return [t for t in self.sorted if t[0] and len(t[2] & here) >= t[0] * least - 1e-9] if here else []

    def scan(self, text: str | None) -> dict[str, float]:
        """Best coefficient of each template that a unit of the text reaches, or else a window of its words."""
        best: dict[str, float] = {}
        lower = (text or "").lower()
        w = _WORDS.findall(lower)
        pairs = list(zip(w, w[1:]))
        possible = self.possible(pairs)
        if not possible:
            return best
        for unit in units(lower):
            w = _WORDS.findall(unit) if len(unit) > 1 else ()
            if len(w) < 2 or self.words.isdisjoint(w):
                continue
            a = frozenset(zip(w, w[1:]))
            if len(a) > self.longest or self.known.isdisjoint(a):
                continue
            for _, name, b in self.candidates(len(a)):
                d = dice(a, b)
                if d >= self.threshold and d > best.get(name, 0.0):
                    best[name] = d
        left = [t for t in possible if t[1] not in best]
        return best | self.windows(pairs, left) if left else best

    def windows(self, pairs: list, templates: list) -> dict[str, float]:
        """Best coefficient of each template that a window of neighbouring bigrams reaches. From the right to the
        left, the different bigrams are kept in the order in which they come next, so the windows from a place
        on are the beginnings of that order; the best window begins and ends with a bigram of the template."""
        best: dict[str, float] = {}
        after: OrderedDict = OrderedDict()
        for p in reversed(pairs):
            after[p] = None
            after.move_to_end(p)
            for n, name, b in templates:
                if p not in b:
                    continue
                common = 0
                for size, q in enumerate(reversed(after), 1):
                    if size > n * self.ratio + 1e-9:
                        break
                    if q in b:
                        common += 1
                        d = 2 * common / (size + n)
                        if d >= self.threshold and d > best.get(name, 0.0):
                            best[name] = d
        return best


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, license, dice, n_licenses, licenses) for each row of df; one narrow pass.

    license: the template of the highest coefficient, of several the first by name, null if none reaches the
    threshold; dice: that coefficient, else 0; licenses: all that reach it as name:coefficient, by name. A
    null or empty text has none. Rows may repeat, null ids stay, other columns are left out.
    """
    texts = TEMPLATES if templates is None else templates

    def run(batches):
        known = Templates(texts, threshold)
        for pdf in batches:
            out = []
            for i, t in zip(pdf["i"], pdf["t"]):
                found = known.scan(t)
                top = min(found, key=lambda n: (-found[n], n), default=None)
                out.append((i, top, found.get(top, 0.0), len(found), ",".join(f"{n}:{found[n]:.6f}" for n in sorted(found))))
            yield pd.DataFrame(out, columns=["i", "license", "dice", "n_licenses", "licenses"])

    return map_rows(df, id_col, {"t": F.col(text_col)}, run, "license string, dice double, n_licenses bigint, licenses string")
