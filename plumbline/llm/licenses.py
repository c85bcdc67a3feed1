"""License scans: Dice coefficient over word bigrams against templates (DataFrame operations only).

Units are the whole text, each of its lines, and its paragraphs: runs of two or
more lines that have words and start with the same signs, such as the comment
marks before a wrapped file header. A unit is normalised to lower-case ASCII
letters and digits parted by single spaces. It matches a template if
2 |A and B| / (|A| + |B|) >= threshold, A and B the sets of their word bigrams,
and if versions and variants agree: numbers of one or two digits and the words
in VARIANTS. A notice of up to SHORT bigrams must have exactly its template's; a
longer unit must have them all.

Pruning loses no match: sizes must lie within threshold / (2 - threshold) of
each other, and then the unit has to share one of the template's key bigrams (any
|B| - ceil(|B| t / (2 - t)) + 1 of them will do; those with the longest words are
taken), hence one of these words. Templates are a fixed list of this module, so they are broadcast.

Null or empty text, or units of fewer than two words: no match; without templates
nothing matches. Each (key, line, n_lines) gives one row, the best template (ties:
the first name): line is the unit's first line, n_lines how many it has; the whole
text is line -1. Repeated rows of one key and unit are reported once.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
SHORT = 20
VARIANTS = ["affero", "by", "clause", "lesser", "library", "nc", "nd", "noderivatives", "noderivs", "noncommercial", "sa", "sharealike"]
_VERSION = "^v?[0-9]{1,2}$"
_FREQUENT = frozenset("a and any as at be by for from in is it may of on or that the this to with you".split())

# Published licence texts (without title and holder) and short notices.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions:"
)
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ASIS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies."
)
_ISC_ASIS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
)
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_BSD_ASIS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
    "the License for the specific language governing permissions and limitations under the License."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation, either version {v} of the License, or (at your option) any later version."
)
_GPL_ASIS = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
    "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at http://mozilla.org/MPL/2.0/."
)
#: A telling paragraph of texts that are too long for a template of their own.
_PREAMBLES = {
    "Apache-2.0": ["\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."],
    "GPL-3.0": ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "GPL-2.0": [
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to "
        "guarantee your freedom to share and change free software--to make sure the software is free for all its users."
    ],
    "LGPL-3.0": [
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by "
        "the additional permissions listed below."
    ],
    "AGPL-3.0": [
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the "
        "community in the case of network server software."
    ],
    "MPL-2.0": ["\"Covered Software\" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof."],
    "CC-BY-4.0": [
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 "
        "International Public License (\"Public License\")."
    ],
    "CC-BY-SA-4.0": [
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons "
        "Attribution-ShareAlike 4.0 International Public License (\"Public License\")."
    ],
}
_NAMES = {
    "MIT": ["MIT License", "MIT license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
}
_VERBS = ["Licensed under", "Licensed under the", "Released under the", "Distributed under the", "This work is licensed under", "This work is licensed under the", "This project is licensed under the"]


def templates() -> list[tuple[str, str]]:
    """(license, text): full texts, their longer paragraphs, and notices made of a verb and a name."""
    paragraphs = {
        "MIT": [_GRANT, _NOTICE, _ASIS],
        "ISC": [_ISC, _ISC_ASIS],
        "BSD-2-Clause": [_BSD, _BSD_1, _BSD_2, _BSD_ASIS],
        "BSD-3-Clause": [_BSD, _BSD_1, _BSD_2, _BSD_3, _BSD_ASIS],
        "Apache-2.0": [_APACHE],
        "GPL-3.0": [_GPL.format(v=3), _GPL_ASIS],
        "GPL-2.0": [_GPL.format(v=2), _GPL_ASIS],
        "Unlicense": [_UNLICENSE],
        "MPL-2.0": [_MPL],
    }
    out = []
    for name, texts in paragraphs.items():
        out += [(name, t) for t in [" ".join(texts), *texts]]
    out += [(name, t) for name, texts in _PREAMBLES.items() for t in texts]
    out += [(name, f"{verb} {x}") for name, names in _NAMES.items() for x in names for verb in _VERBS]
    out += [(name, f"SPDX-License-Identifier: {name}") for name in _NAMES]
    seen, kept = set(), []
    for name, text in out:
        key = tuple(sorted(bigrams(text)))
        if len(key) and (name, key) not in seen:
            seen.add((name, key))
            kept.append((name, text))
    return kept


def plain_words(text: str) -> list[str]:
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()


def bigrams(text: str) -> set[str]:
    words = plain_words(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def versions(text: str) -> list[str]:
    """The words of a text that tell versions and variants apart."""
    return sorted({w for w in plain_words(text) if re.match(_VERSION, w) or w in VARIANTS})


def _words(c: Column) -> Column:
    # What the pattern leaves is ASCII, where lower() is cheap and changes A-Z only.
    return F.split(F.trim(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", " "))), " ")


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words that branches letter by letter, so that most positions fail at once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(h) + (_any_of(tails) if tails != [""] else "") for h, tails in heads.items() if h]
    return f"(?:{'|'.join(parts)})" + ("?" if "" in heads else "")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """key, line, n_lines, license, template (its number in the list), score."""
    spark = docs.sparkSession
    low = threshold / (2 - threshold)
    rows, keys = [], []
    for i, (name, body) in enumerate(licenses if licenses is not None else templates()):
        has = sorted(bigrams(body), key=lambda b: (-max(map(len, b.split())), -len(b), b))
        if not has:
            continue
        rows.append((i, name, has, len(has), versions(body)))
        need = max(1, math.ceil(low * len(has) - 1e-9))
        keys += [(b, i) for b in has[: len(has) - need + 1]]
    if not rows:
        return docs.select(key, *[F.lit(None).cast(t).alias(c) for c, t in zip(("line", "n_lines", "license", "template", "score"), ("int", "int", "string", "int", "double"))]).where("false")
    least, most = min(r[3] for r in rows), max(r[3] for r in rows)
    known = spark.createDataFrame(rows, "template int, license string, has array<string>, m int, v array<string>")
    leads = spark.createDataFrame(keys, "lead string, template int")

    # Every key bigram holds one of these words: a text, then a unit, without any of them matches nothing. The pattern runs
    # on the raw text, so that only what it finds is normalised.
    marks = {max(b.split(), key=lambda w: (w not in _FREQUENT, len(w))) for b, _ in keys}
    marked = lambda c: F.col(c).rlike(f"(?i)(?<![A-Za-z0-9]){_any_of(sorted(marks))}(?![A-Za-z0-9])")
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(marked("t"))
    # Lines come out of a generator, so that they are made once.
    split = docs.where(F.col("t").contains("\n")).select("k", F.explode(F.array(F.split("t", "\n"))).alias("lines"))
    each = docs.select("k", F.posexplode(F.split("t", "\n")).alias("line", "unit")).select("k", "line", F.lit(1).alias("n_lines"), "unit")
    tag = "transform(lines, l -> if(l rlike '[A-Za-z0-9]', regexp_replace(regexp_extract(l, '^[^A-Za-z0-9]*', 0), '[ \\\\t\\\\r]+', ''), '\x02'))"
    tagged = split.select("k", "lines", F.explode(F.array(F.expr(tag))).alias("tags"))
    first = "filter(sequence(0, size(tags) - 1), i -> tags[i] <> '\x02' and (i = 0 or tags[i - 1] <> tags[i]))"
    last = "filter(sequence(0, size(tags) - 1), i -> tags[i] <> '\x02' and (i = size(tags) - 1 or tags[i + 1] <> tags[i]))"
    runs = tagged.select("k", "lines", F.explode(F.expr(f"filter(zip_with({first}, {last}, (a, b) -> struct(a as line, b - a + 1 as n_lines)), x -> x.n_lines > 1)")).alias("x"))
    runs = runs.select("k", "x.line", "x.n_lines", F.array_join(F.slice("lines", F.col("x.line") + 1, F.col("x.n_lines")), " ").alias("unit"))
    whole = split.select("k", F.lit(-1).alias("line"), F.size("lines").alias("n_lines"), F.array_join("lines", " ").alias("unit"))
    # Words come out of a generator, so that filters on them are not pushed below and the words are made once.
    units = each.where(marked("unit")).union(runs.where(marked("unit"))).union(whole)
    units = units.select("k", "line", "n_lines", F.explode(F.array(_words(F.col("unit")))).alias("w"))
    # Too few words for any template go before bigrams are built; the bound on distinct bigrams follows.
    units = units.where(F.size("w") > math.ceil(low * least - 1e-9))
    pairs = F.expr("array_distinct(zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> concat(a, ' ', b)))")
    units = units.select("k", "line", "n_lines", "w", F.explode(F.array(pairs)).alias("b")).withColumn("n", F.size("b")).where(F.col("n") <= math.floor(most / low + 1e-9))
    led = units.select("k", "line", "n_lines", "w", "b", "n", F.explode("b").alias("lead")).join(F.broadcast(leads), "lead")
    led = led.join(F.broadcast(known), "template").where(F.expr(f"least(n, m) >= {low - 1e-9}D * greatest(n, m)"))
    scored = led.withColumn("score", 2.0 * F.size(F.array_intersect("b", "has")) / (F.col("n") + F.col("m"))).where(F.col("score") >= threshold - 1e-12)
    own = F.array_distinct(F.filter("w", lambda x: x.rlike(_VERSION) | x.isin(VARIANTS)))
    same = (F.size(F.array_except("v", own)) == 0) & ((F.col("m") > SHORT) | (F.size(F.array_except(own, "v")) == 0))
    best = scored.where(same).groupBy("k", "line", "n_lines").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "template")).alias("x"))
    return best.select(F.col("k").alias(key), "line", "n_lines", F.col("x.license").alias("license"), F.col("x.template").alias("template"), (-F.col("x.s")).alias("score"))


def scan_sql(threshold: float = THRESHOLD) -> str:
    """The same in SQL, with the templates inlined: every unit against every template of a fitting size."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda xs: f"[{', '.join(map(quote, xs))}]::varchar[]"
    values = ",\n".join(f"({i}, {quote(n)}, {listed(sorted(bigrams(t)))}, {listed(versions(t))})" for i, (n, t) in enumerate(templates()))
    low = threshold / (2 - threshold)
    return f"""
with tpl(template, license, has, v) as (values {values}),
split as (
  select doc_id, string_split(text, chr(10)) as lines from documents where text is not null
), tagged as (
  select doc_id, lines, list_transform(lines, lambda l: case when regexp_matches(l, '[A-Za-z0-9]')
    then regexp_replace(regexp_extract(l, '^[^A-Za-z0-9]*'), '[ \\t\\r]+', '', 'g') else chr(2) end) as tags
  from split where len(lines) > 1
), runs as (
  select doc_id, lines,
    unnest(list_filter(range(1, len(tags) + 1), lambda i: tags[i] <> chr(2) and (i = 1 or tags[greatest(i - 1, 1)] <> tags[i]))) as first,
    unnest(list_filter(range(1, len(tags) + 1), lambda i: tags[i] <> chr(2) and (i = len(tags) or tags[least(i + 1, len(tags))] <> tags[i]))) as last
  from tagged
), units as (
  select doc_id, -1 as line, len(lines) as n_lines, array_to_string(lines, ' ') as unit from split where len(lines) > 1
  union all
  select doc_id, unnest(range(len(lines))) as line, 1 as n_lines, unnest(lines) as unit from split
  union all
  select doc_id, first - 1 as line, last - first + 1 as n_lines, array_to_string(lines[first:last], ' ') as unit from runs where last > first
), words as (
  select doc_id, line, n_lines, string_split(trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') as w from units
), grams as (
  select doc_id, line, n_lines, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b,
    list_filter(w, lambda x: regexp_matches(x, '{_VERSION}') or list_contains({listed(VARIANTS)}, x)) as own
  from words where len(w) > 1
), scored as (
  select doc_id, line, n_lines, license, template, 2.0::double * len(list_intersect(b, has)) / (len(b) + len(has)) as score
  from grams join tpl on least(len(b), len(has)) >= {low - 1e-9}::double * greatest(len(b), len(has))
    and list_has_all(own, v) and (len(has) > {SHORT} or list_has_all(v, own))
)
select doc_id, line::int as line, n_lines::int as n_lines, license, template::int as template, score from scored where score >= {threshold - 1e-12}::double
qualify row_number() over (partition by doc_id, line, n_lines order by score desc, license, template) = 1
"""
