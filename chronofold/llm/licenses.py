"""License scans: Dice coefficients over word bigrams against templates, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: (name, licence, wording) of the templates: notices, headers, grants, and whole licences.
TEMPLATES: list[tuple[str, str, str]] = [
    ("apache-2.0-short", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit-short", "MIT", "Released under the MIT License."),
    ("mit-grant", "MIT", _MIT),
    ("gpl-3.0-short", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-header", "GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-grant", "BSD", _BSD),
    ("mpl-2.0-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-nc-4.0-short", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-short", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", "MIT", _MIT + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("bsd-2-clause", "BSD-2-Clause", _BSD + _BSD_TWO + _BSD_END),
    ("bsd-3-clause", "BSD-3-Clause", _BSD + _BSD_TWO + _BSD_THIRD + _BSD_END),
    ("isc", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS + " For more information, please refer to https://unlicense.org"),
]

#: Words that are looked for only where nothing else will do.
COMMON = {"a", "and", "any", "at", "be", "by", "if", "in", "is", "it", "not", "of", "or", "the", "this", "to", "under", "with", "you"}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams(words: list[str]) -> list[str]:
    """The distinct bigrams of a template's words, in order."""
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def normal_words(text: str) -> list[str]:
    return "".join(c if c in _LOWER or c in "0123456789" else _LOWER[_UPPER.index(c)] if c in _UPPER else " " for c in text).split()


def anchors(own: list[str], least: float) -> set[str]:
    """Words of which a unit must have one to reach ``least`` with a template of these bigrams.

    Such a unit shares m bigrams at least, where 2 m / (m + n) is ``least``; so it has one of any n - m + 1 of them,
    and one of the words chosen so that as many bigrams hold one. Long words come first, common ones last.
    """
    n = len(own)
    shared = next(m for m in range(1, n + 1) if 2 * m / (m + n) >= least - 1e-9)
    words = sorted({w for b in own for w in b.split(" ")}, key=lambda w: (w in COMMON, len(w) < 6, -sum(w in b.split(" ") for b in own), -len(w), w))
    chosen: set[str] = set()
    for word in words:
        if sum(bool(chosen & {*b.split(" ")}) for b in own) > n - shared:
            break
        chosen.add(word)
    return chosen


def words_of(text: Column) -> Column:
    """The words of a text: runs of a-z and 0-9 after lower-casing A-Z."""
    return F.filter(F.split(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """One row (key, unit, place, template, license, bigrams, dice) for each unit of a text that is like a template.

    Units are the lines, the paragraphs of several lines and the whole text of several paragraphs; ``place`` counts
    them from 0. The coefficient is over sets of word bigrams. A template can only reach ``least`` for units whose
    number of bigrams is between ``least / (2 - least)`` times and the inverse of that times its own, so units are
    dropped by size, then where they share no bigram with any template; before that, texts without any template's
    ``anchors`` are, which no match can be in. Every step is within a row: nothing is shuffled and a document of any
    length is taken apart line by line.

    A null or empty text, and one without a word pair, has no row; a null key stays null; repeated rows give repeated
    rows; equal coefficients of several templates each give a row. Empty tables give no rows.
    """
    low, high = least / (2 - least), (2 - least) / least
    # wider by a little than floats say, so that a bound which is a whole number keeps it; the coefficient decides
    low, high = low - 1e-9, high + 1e-9
    known = [(name, licence, bigrams(normal_words(wording))) for name, licence, wording in templates]
    fewest, most = min(len(b) for *_, b in known) * low, max(len(b) for *_, b in known) * high
    lines = F.split(F.col("text"), "\n")
    paragraphs = F.split(F.col("text"), r"\n[\x20\t\r]*\n\s*")

    def units(parts: Column, kind: str, keep) -> Column:
        numbered = F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("place"), x.alias("t")))
        return F.filter(numbered, lambda u: keep(u["t"])) if keep else numbered

    whole = F.when(F.size(paragraphs) > 1, F.array(F.col("text"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(units(lines, "line", None), units(paragraphs, "paragraph", lambda t: t.contains("\n")), units(whole, "text", None))
    # exploded, so that the lower-casing is done once and not again for each word looked for
    lowered = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.explode(F.array(F.translate(F.col(text), _UPPER, _LOWER))).alias("low"))
    wanted = sorted(set().union(*(anchors(b, least) for *_, b in known)), key=lambda w: (-len(w), w))
    rows = lowered.where(reduce(or_, (F.col("low").contains(w) for w in wanted))).select("key", "text")
    cutup = rows.select("key", F.explode(every).alias("u")).select("key", "u.unit", "u.place", words_of(F.col("u.t")).alias("words"))
    sized = cutup.where(F.size("words") > fewest).select("key", "unit", "place", bigrams_of(F.col("words")).alias("pairs"))
    sized = sized.where(F.size("pairs").between(F.lit(fewest), F.lit(most)))
    reach = sized.where(F.arrays_overlap("pairs", _words({p for *_, b in known for p in b})))
    n = F.size("pairs")

    # one literal of all templates and one expression over it, whatever their number
    every = F.array(*(F.struct(F.lit(name).alias("template"), F.lit(licence).alias("license"), _words(own).alias("own")) for name, licence, own in known))

    def coefficient(x: Column) -> Column:
        size = F.size(x["own"])
        dice = F.when(n.between(size * low, size * high), 2.0 * F.size(F.array_intersect(F.col("pairs"), x["own"])) / (n + size))
        return F.struct(x["template"].alias("template"), x["license"].alias("license"), F.round(dice, 9).alias("dice"))

    found = F.filter(F.transform(every, coefficient), lambda x: x["dice"] >= least)
    out = reach.select("key", "unit", "place", n.alias("bigrams"), F.explode(found).alias("x"))
    return out.select(F.col("key").alias(key), "unit", "place", "x.template", "x.license", "bigrams", "x.dice")


def _words(words) -> Column:
    return F.array(*(F.lit(w) for w in sorted(words)))


def sql(least: float = 0.8) -> str:
    """The same in DuckDB's SQL, over the view ``documents``, without any bound before the coefficient."""
    rows = ",\n".join(f"('{name}', '{licence}', {sorted(bigrams(normal_words(wording)))!r})" for name, licence, wording in TEMPLATES)
    return f"""
WITH templates(template, license, own) AS (VALUES {rows}),
units AS (
  SELECT doc_id, 'line' AS unit, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'paragraph', regexp_split_to_array(text, '\\n[\\x20\\t\\r]*\\n\\s*') FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'text', [text] FROM documents WHERE len(regexp_split_to_array(text, '\\n[\\x20\\t\\r]*\\n\\s*')) > 1),
placed AS (SELECT doc_id, unit, unnest(range(len(parts))) AS place, unnest(parts) AS t FROM units),
worded AS (
  SELECT doc_id, unit, place, list_filter(string_split(regexp_replace(translate(t, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS words
  FROM placed WHERE unit <> 'paragraph' OR contains(t, chr(10))),
paired AS (
  SELECT doc_id, unit, place, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS pairs
  FROM worded WHERE len(words) > 1),
scored AS (
  SELECT doc_id, unit, place::INTEGER AS place, template, license, len(pairs)::INTEGER AS bigrams,
         round(2.0::DOUBLE * len(list_intersect(pairs, own)) / (len(pairs) + len(own)), 9) AS dice
  FROM paired, templates)
SELECT * FROM scored WHERE dice >= {least!r}
"""
