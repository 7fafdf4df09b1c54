"""Licence scans: segments of texts compared with licence templates by the Dice coefficient over word bigrams, with
DataFrame functions only.

Segments are the lines of a text, its paragraphs (between blank lines) of more than one line, and a text of several
paragraphs as a whole. Templates are short notices, whole licences, and each paragraph of those, so that a licence is found
as a file of its own and within a longer text. Both sides are normalised alike: A-Z lower-cased, everything but a-z and 0-9 a space. Two texts with n and m bigrams can reach a Dice
coefficient of t only if t / (2 - t) <= n / m <= (2 - t) / t, where n and m count distinct bigrams, so each such number
has a short list of templates that are worth comparing. The number of words bounds it from above only: segments too short
for every template go no further, before any bigram is built; of the others it is counted. Segments meet their list by an
equi-join on it. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
MAX_TEMPLATES = 2_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The usual notices of public licences.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)

#: Whole public licences, a text for each paragraph.
WHOLE = (
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    )),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    )),
    ("BSD-2-Clause", (*_BSD_CLAUSES, _BSD_DISCLAIMER)),
    ("BSD-3-Clause", (*_BSD_CLAUSES, "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", _BSD_DISCLAIMER)),
    ("Zlib", (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "3. This notice may not be removed or altered from any source distribution.",
    )),
    ("Unlicense", (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "For more information, please refer to <https://unlicense.org/>",
    )),
)

#: Notices, whole licences and their paragraphs, each wording once, under the first licence that has it.
TEMPLATES = tuple({text: (name, text) for name, text in reversed([*NOTICES, *((n, "\n\n".join(ps)) for n, ps in WHOLE), *((n, p) for n, ps in WHOLE for p in ps)])}.values())[::-1]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def bigrams(words: Column) -> Column:
    """The distinct bigrams of an array of words, as 64-bit hashes."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))
    return F.array_distinct(pairs)


def templates_table(spark: SparkSession, templates: Iterable[tuple[str, str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(name, text, nth) for nth, (name, text) in enumerate(templates)], "license string, template string, nth int")


def _by_size(templates: DataFrame, threshold: float) -> DataFrame:
    """n: a number of distinct bigrams, offered: the templates that a segment with so many can be similar to."""
    count = templates.count()
    if count > MAX_TEMPLATES:
        raise ValueError(f"{count} templates; at most {MAX_TEMPLATES} are broadcast")
    words = F.split(normalised(F.col("template")), " ")
    sized = templates.select("license", "nth", bigrams(words).alias("grams")).withColumn("size", F.size("grams")).where("size > 0")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    slack = 1e-9  # a quotient that is whole must not be lost to rounding
    within = F.sequence(F.greatest(F.lit(1), F.ceil(F.col("size") * low - slack).cast("int")), F.floor(F.col("size") * high + slack).cast("int"))
    return sized.withColumn("n", F.explode(within)).groupBy("n").agg(F.array_sort(F.collect_list(F.struct("nth", "license", "grams"))).alias("offered"))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, kind (line, paragraph or text), position (from 0), license, template (its number), dice: each segment of every
    row's whole text that is similar to a template, with the most similar one, the first of equal ones.

    A segment is compared with a template if their numbers of distinct bigrams are within the bounds, so none that reaches
    the threshold is missed; the coefficient is that of the sets of distinct bigrams. Null and empty texts have no segments,
    a segment of one word no bigrams; a very long text is compared whole. Rows that repeat are scanned like others, null ids
    are kept, an empty table gives no rows; other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"not a threshold: {threshold}")
    text = F.col(text_col).cast("string")
    offers = _by_size(templates, threshold)
    least = offers.agg(F.min("n")).first()[0] or 1
    lines = F.transform(F.split(text, "\n"), lambda s, i: F.struct(F.lit("line").alias("kind"), i.alias("position"), s.alias("segment")))
    paragraphs = F.transform(F.split(text, r"\n[ \t\r]*\n"), lambda s, i: F.struct(F.lit("paragraph").alias("kind"), i.alias("position"), s.alias("segment")))
    several = F.filter(paragraphs, lambda p: F.contains(F.trim(p.segment, F.lit("\n \t\r")), F.lit("\n")))
    # Normalised before they are exploded, so that filters above do not do it again.
    whole = F.when(F.size(paragraphs) > 1, F.array(F.struct(F.lit("text").alias("kind"), F.lit(0).alias("position"), text.alias("segment"))))
    plain = F.transform(F.concat(lines, several, F.coalesce(whole, F.filter(several, lambda p: F.lit(False)))), lambda s: F.struct(s.kind.alias("kind"), s.position.alias("position"), normalised(s.segment).alias("plain")))
    segments = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(plain).alias("s")).select("doc_id", "s.*")
    most = F.length("plain") - F.length(F.replace(F.col("plain"), F.lit(" "), F.lit("")))
    made = segments.where(most >= least).withColumn("grams", bigrams(F.split("plain", " "))).drop("plain")
    met = made.withColumn("n", F.coalesce(F.size("grams"), F.lit(0))).join(F.broadcast(offers), "n")

    def compare(offer: Column, grams: Column) -> Column:
        dice = 2.0 * F.size(F.array_intersect(offer.grams, grams)) / (F.size(offer.grams) + F.size(grams))
        return F.struct(dice.alias("dice"), (-offer.nth).alias("before"), offer.license.alias("license"))

    best = F.array_max(F.transform("offered", lambda offer: compare(offer, F.col("grams"))))
    found = met.select("doc_id", "kind", "position", best.alias("best")).where(F.col("best.dice") >= threshold)
    return found.select("doc_id", "kind", F.col("position").cast("long").alias("position"), F.col("best.license").alias("license"), (-F.col("best.before")).alias("template"), F.col("best.dice").alias("dice"))


def size_bounds(size: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """The least and most distinct bigrams of a text that can be similar to one with ``size``."""
    return max(1, ceil(size * threshold / (2 - threshold) - 1e-9)), floor(size * (2 - threshold) / threshold + 1e-9)
