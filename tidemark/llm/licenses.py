"""Licence scan: windows of words against templates by the Dice coefficient over word bigrams.

A text is normalised to lower-case runs of a-z and 0-9. A template of n words is held against every window of n
consecutive words of the whole text (the text itself, if it is shorter), across lines. With ``a`` and ``b`` distinct
bigrams on the two sides, Dice is at most ``2 min(a, b) / (a + b)``, so a match shares at least ``b t / (2 - t)`` of the
template's bigrams. This bound prunes twice and exactly: templates of which the whole text holds fewer bigrams, and
windows that hold fewer places of the template's bigrams. Windows are found from the sorted places: the one that
starts after one place and not after the next must reach the place ``least - 1`` further on, so no window is listed twice.

Of the windows that reach the threshold, the one that shares most bigrams wins, then the higher Dice: a whole licence
beats a sentence of it, a sibling's own notice beats a similar one. Where different licences are equal in both, as for
a sentence that they have in common, no single name is given and ``candidates`` lists them.

All Column expressions inside a row: no shuffle, no join, no task that depends on another.

Defined results: a null or empty text, and one of fewer than two words, matches nothing (null licence and start,
Dice 0, empty candidates). Rows are never merged, repeated rows and ids each get their result, an empty table gives none.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import text_of

DICE = 0.8

# Sentences and whole texts of licences, and notices by which texts declare them.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
MIT_TEXT = (
    MIT_GRANT + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
    " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to"
    " the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
    ' Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF'
    " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,"
    " DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE"
    " OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_TWO = (
    BSD_GRANT + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution."
)
BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this"
    " software without specific prior written permission."
)
BSD_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,'
    " THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR"
    " CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,"
    " PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF"
    " ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above"
    " copyright notice and this permission notice appear in all copies."
)
ISC_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF'
    " MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES"
    " WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
    " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
UNLICENSE_TEXT = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute"
    " this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a'
    " copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed"
    ' under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for'
    " the specific language governing permissions and limitations under the License."
)
GNU_NOTICE = (
    "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation,"
    " either version {} of the License, or any later version."
)
GNU = (
    ("GPL-2.0", "General Public License", "2"),
    ("GPL-3.0", "General Public License", "3"),
    ("LGPL-2.1", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "Lesser General Public License", "3"),
    ("AGPL-3.0", "Affero General Public License", "3"),
)
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", MIT_GRANT),
    ("MIT", MIT_TEXT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", APACHE_NOTICE),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", BSD_GRANT),
    ("BSD-3-Clause", BSD_GRANT),
    ("BSD-2-Clause", BSD_TWO + BSD_WARRANTY),
    ("BSD-3-Clause", BSD_TWO + BSD_NAMES + BSD_WARRANTY),
    ("ISC", ISC_GRANT),
    ("ISC", ISC_GRANT + ISC_WARRANTY),
    ("Unlicense", UNLICENSE_TEXT),
    *((name, f"This work is licensed under the GNU {title}, version {version}.") for name, title, version in GNU),
    *((name, GNU_NOTICE.format("This program", title, version)) for name, title, version in GNU),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
)


def template_words(text: str) -> list[str]:
    return re.sub(r"[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")


def template_bigrams(text: str) -> list[str]:
    w = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def size_bounds(b: int, dice: float) -> tuple[int, int]:
    """Smallest and largest number of bigrams whose Dice with ``b`` bigrams can reach ``dice``."""
    return math.ceil(b * dice / (2 - dice) - 1e-9), math.floor(b * (2 - dice) / dice + 1e-9)


def _known(templates, dice: float) -> tuple[Column, Column]:
    """Templates as an array of structs, and all their bigrams."""
    rows, every = [], set()
    for name, text in templates:
        grams = template_bigrams(text)
        every.update(grams)
        rows.append(F.struct(
            F.lit(name).alias("name"), F.lit(len(template_words(text)) - 1).alias("span"), F.lit(size_bounds(len(grams), dice)[0]).alias("least"),
            F.array(*map(F.lit, grams)).alias("grams"),
        ))
    return F.array(*rows), F.array(*map(F.lit, sorted(every)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _bigrams(w: Column) -> Column:
    n = F.size(w) - 1
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _starts(places: Column, span: Column, least: Column, size: Column) -> Column:
    """Starts of the windows of ``span`` bigrams that hold at least ``least`` of the sorted places."""
    last = F.greatest(F.lit(0), size - span)

    def run(j: Column) -> Column:
        low = F.greatest(F.when(j > 0, F.get(places, j - 1) + 1).otherwise(0), F.get(places, j + least - 1) - span + 1)
        high = F.least(F.get(places, j), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    none = F.array().cast("array<int>")
    return F.when(F.size(places) >= least, F.flatten(F.transform(F.sequence(F.lit(0), F.size(places) - least), run))).otherwise(none)


def _matches(grams: Column, template: Column, dice: float) -> Column:
    """``shared, dice, start, name`` of every window that reaches the threshold for one template."""
    place = lambda x, i: F.when(F.array_contains(template["grams"], x), i)
    places = F.filter(F.transform(grams, place), lambda i: i.isNotNull())
    starts = _let(places, lambda p: _starts(p, template["span"], template["least"], F.size(grams)))

    def rated(start: Column) -> Column:
        window = F.array_distinct(F.slice(grams, start + 1, template["span"]))
        both = lambda g: F.struct(F.size(F.array_intersect(g, template["grams"])).alias("shared"), F.size(g).alias("size"))
        return _let(_let(window, both), lambda c: F.struct(
            c["shared"].alias("shared"), (F.lit(2.0) * c["shared"] / (c["size"] + F.size(template["grams"]))).alias("dice"),
            start.alias("start"), template["name"].alias("name"),
        ))

    return F.filter(F.transform(starts, rated), lambda m: m["dice"] >= dice)


def scan(docs: DataFrame, templates=TEMPLATES, dice: float = DICE) -> DataFrame:
    """``doc_id, license, dice, candidates, start``: the best licence if only one is best, its Dice, all best ones joined by
    commas in order of name, and the word number at which the first best window starts."""
    known, every = _known(templates, dice)
    normal = F.lower(F.trim(F.regexp_replace(text_of(), "[^A-Za-z0-9]+", " ")))

    def found(grams: Column) -> Column:
        held = lambda common: F.filter(known, lambda t: F.size(F.array_intersect(common, t["grams"])) >= t["least"])
        near = _let(F.array_intersect(grams, every), held)
        return F.flatten(F.transform(near, lambda t: _matches(grams, t, dice)))

    rows = docs.select("doc_id", F.split(normal, " ").alias("__w"))
    rows = rows.select("doc_id", _let(_bigrams(F.col("__w")), found).alias("__found"))
    top = F.array_max(F.transform("__found", lambda m: F.struct(m["shared"].alias("shared"), m["dice"].alias("dice"))))
    rows = rows.select("doc_id", "__found", top.alias("__top"))
    best = F.filter("__found", lambda m: (m["shared"] == F.col("__top.shared")) & (m["dice"] == F.col("__top.dice")))
    rows = rows.select("doc_id", "__top", best.alias("__best"))
    names = F.array_sort(F.array_distinct("__best.name"))
    return rows.select(
        "doc_id",
        F.when(F.size(names) == 1, names[0]).alias("license"),
        F.coalesce("__top.dice", F.lit(0.0)).alias("dice"),
        F.concat_ws(",", names).alias("candidates"),
        F.array_min("__best.start").cast("bigint").alias("start"),
    )
