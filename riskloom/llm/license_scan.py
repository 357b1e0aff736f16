"""License scans: Dice coefficient over word bigrams (DataFrame functions only).

A text's units are its lines and, if it has several, the text as a whole. A unit is
normalised to lower-case ASCII words and becomes the set of its word bigrams. The
Dice coefficient 2|A and B| / (|A| + |B|) with a template can reach 4/5 only if
2/3 |B| <= |A| <= 3/2 |B|: templates outside that size bound are pruned, and units
that share no bigram with any template are not compared at all. A unit's licence is
the template with the highest coefficient of at least 4/5 (the first of equals).

Notices inside longer lines and wrapped texts are found by windows over the words of
the whole text, as long as the template. A window that reaches 4/5 shares at least
2/3 |B| bigrams with it, so only places are measured where that many words which begin
a bigram of the template lie within its length. Windows begin at such a word; of
windows that overlap, the one with the highest coefficient stays (the first of equals).

Marker words prune whole texts: they are chosen from the templates so that more than a
third of the bigrams of every template hold one. A unit or window without any of them
shares less than 2/3 |B| bigrams with every template, so a text without them is done.

Everything happens within a row, so that nothing is shuffled.

Defined results: NULL and empty texts match nothing; repeated rows get equal results,
one each; an empty table gives an empty result; columns other than id and text are
not read, and may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fresh, load, text_or_empty

# Licence notices and texts, as their owners word them. Notices first, then whole texts.
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
     "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
     'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
     "limitations under the License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
     'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
     "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
     "in all copies or substantial portions of the Software."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions "
     "and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
     "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
     "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
     'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
     "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
     'in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
     "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
     "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
     "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND "
     "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
     "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
     "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
     "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions "
     "and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions "
     "and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the "
     "name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
     "software without specific prior written permission. " + _BSD_DISCLAIMER),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
     "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
     "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
     "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
     "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
     "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
     "altered from any source distribution."),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = "[^a-z0-9\n]+"


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


# words that most texts have: no markers
COMMON = set("a an i but if can so such than then when which who will would has have had do does code the of and or to in is for any with by this be as that all not without you are on use used under it at from may no 0 1 2 3 4".split())


def markers(templates=TEMPLATES) -> list[str]:
    """Words of which more than a third of each template's bigrams hold one (greedily few)."""
    grams = [[set(g.split(" ")) for g in template_bigrams(text)] for _, text in templates]
    chosen: set[str] = set()
    while True:
        gain = Counter()
        for one in grams:
            missing = len(one) // 3 + 1 - sum(bool(g & chosen) for g in one)
            if missing > 0:
                held = Counter(w for g in one if not g & chosen for w in g)
                gain.update({w: min(n, missing) for w, n in held.items()})
        if not gain:
            return sorted(chosen)
        chosen.add(min(gain, key=lambda w: (w in COMMON, -gain[w], w)))


def _may_match(text_column: str, templates) -> Column:
    text = F.lower(text_or_empty(text_column))  # keeps ASCII letters that stand together together
    return reduce(lambda a, b: a | b, [text.contains(w) for w in markers(templates)])


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _literal(words: list[str]) -> Column:
    """Array of words without quotes in them."""
    return F.expr(f"array({_quoted(words)})")


def _bigrams(words: Column) -> Column:
    """Distinct bigrams of an array of at least two words."""
    return F.array_distinct(F.transform(F.slice(words, F.lit(2), F.size(words) - 1), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w)))


def matches(docs: DataFrame, text_column: str = "text", templates=TEMPLATES, out: str = "licences") -> DataFrame:
    """Adds an array of (line, licence, permille): line from 0, -1 for the whole text."""
    grams = [template_bigrams(text) for _, text in templates]
    least, most = min(map(len, grams)), max(map(len, grams))
    every = _literal(sorted({g for one in grams for g in one}))
    known = F.array(
        *[
            F.struct(F.lit(-i).alias("order"), F.lit(name).alias("licence"), F.lit(len(one)).alias("n"), _literal(one).alias("grams"))
            for i, ((name, _), one) in enumerate(zip(templates, grams, strict=True))
        ]
    )
    clean = F.regexp_replace(F.translate(text_or_empty(text_column), _UPPER, _LOWER), NOT_WORD, " ")
    words = lambda line: F.filter(F.split(line, "[ \n]"), lambda w: w != "")
    text, lines, sized, sets, near = fresh(docs, "_clean", "_lines", "_sized", "_sets", "_near")
    staged = docs.withColumn(text, F.when(_may_match(text_column, templates), clean).otherwise(""))
    staged = staged.withColumn(lines, F.split(text, "\n"))
    units = F.transform(lines, lambda line, i: F.struct(i.alias("line"), words(line).alias("w")))
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("line"), words(F.col(text)).alias("w"))))
    units = F.concat(F.coalesce(whole, F.slice(units, 1, 0)), units)
    staged = staged.withColumn(sized, F.filter(units, lambda u: 3 * (F.size(u["w"]) - 1) >= 2 * least))
    staged = staged.withColumn(sets, F.transform(sized, lambda u: F.struct(u["line"].alias("line"), _bigrams(u["w"]).alias("g"))))
    staged = staged.withColumn(near, F.filter(sets, lambda u: (2 * F.size(u["g"]) <= 3 * most) & F.arrays_overlap(u["g"], every)))

    def best(unit):
        size = F.size(unit["g"])
        inside = F.filter(known, lambda t: (3 * size >= 2 * t["n"]) & (2 * size <= 3 * t["n"]))
        scored = F.transform(
            inside,
            lambda t: F.struct(
                F.floor(2000 * F.size(F.array_intersect(unit["g"], t["grams"])) / (size + t["n"])).cast("int").alias("permille"),
                t["order"].alias("order"), t["licence"].alias("licence"),
            ),
        )
        top = F.array_max(F.filter(scored, lambda s: s["permille"] >= 800))
        return F.struct(unit["line"].alias("line"), top["licence"].alias("licence"), top["permille"].alias("permille"))

    found = F.filter(F.transform(near, best), lambda m: m["licence"].isNotNull())
    return staged.withColumn(out, found).drop(text, lines, sized, sets, near)


def window_matches(docs: DataFrame, text_column: str = "text", templates=TEMPLATES, out: str = "windows") -> DataFrame:
    """Adds an array of (word, n_words, licence, permille) by word, then template: notices anywhere in the text."""
    grams = [template_bigrams(text) for _, text in templates]
    lengths = [len(template_words(text)) for _, text in templates]
    every = _quoted(sorted({g for one in grams for g in one}))
    words, known = fresh(docs, "_words", "_known")
    begins = list(zip(fresh(docs, *[f"_at{i}" for i in range(len(grams))]), grams, lengths, templates, strict=True))
    scored = fresh(docs, *[f"_scored{i}" for i in range(len(grams))])
    clean = F.regexp_replace(F.translate(text_or_empty(text_column), _UPPER, _LOWER), "[^a-z0-9]+", " ")
    split = F.filter(F.split(clean, " "), lambda w: w != "")
    staged = docs.withColumn(words, F.when(_may_match(text_column, templates), split).otherwise(F.array().cast("array<string>")))
    marked = F.arrays_overlap(words, _literal(markers(templates)))
    pairs = f"transform({words}, (w, i) -> struct(i AS at, concat(w, ' ', get({words}, i + 1)) AS gram))"
    found = F.expr(f"filter({pairs}, p -> p.gram IN ({every}))")
    staged = staged.withColumn(known, F.when(marked, found).otherwise(F.expr("array()").cast("array<struct<at:int,gram:string>>")))
    ats = {at: F.expr(f"transform(filter({known}, p -> p.gram IN ({_quoted(one)})), p -> p.at)") for at, one, _, _ in begins}
    staged = staged.withColumns(ats)  # columns of one projection, not passes over the rows

    # SQL text, for a template needs many small expressions
    def measured(at, one, n, template):
        need = -(-2 * len(one) // 3)
        grams_at = f"transform(slice({words}, p + 2, {n - 1}), (w, i) -> concat(get({words}, p + i), ' ', w))"
        shared = f"size(array_intersect(m.grams, array({_quoted(one)})))"
        permille = f"cast(floor(2000 * {shared} / (size(m.grams) + {len(one)})) AS int)"
        close = f"filter({at}, (p, j) -> get({at}, j + {need - 1}) - p <= {n - 2})"
        windows = f"transform({close}, p -> struct(p AS word, array_distinct({grams_at}) AS grams))"
        row = f"struct(m.word AS word, {n} AS n_words, '{template[0]}' AS licence, {permille} AS permille)"
        return F.expr(f"filter(transform({windows}, m -> {row}), m -> m.permille >= 800)")

    staged = staged.withColumns({name: measured(*one) for name, one in zip(scored, begins, strict=True)}).drop(words, known, *ats)

    def best(name, n):
        # windows are in order and begin at different words: those that overlap are at most n places away
        around = f"slice({name}, greatest(j - {n}, 0) + 1, {2 * n + 1})"
        better = "o.permille > m.permille OR (o.permille = m.permille AND o.word < m.word)"
        return F.expr(f"filter({name}, (m, j) -> NOT exists({around}, o -> abs(o.word - m.word) < {n} AND ({better})))")

    kept = [best(name, n) for name, n in zip(scored, lengths, strict=True)]
    return staged.withColumn(out, F.array_sort(F.concat(*kept))).drop(*scored)


def query(spark, sf_dir: str) -> DataFrame:
    rows = window_matches(matches(load(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    top = F.array_max(F.transform("licences", lambda m: F.struct(m["permille"].alias("permille"), m["licence"].alias("licence"))))
    return rows.select(
        "doc_id", F.size("licences").alias("n_matches"), F.coalesce(top["licence"], F.lit("")).alias("licence"),
        F.coalesce(top["permille"], F.lit(0)).alias("permille"),
        F.array_join(F.transform("licences", lambda m: F.concat_ws(":", m["line"], m["licence"], m["permille"])), ",").alias("matches"),
        F.size("windows").alias("n_windows"),
        F.array_join(F.transform("windows", lambda m: F.concat_ws(":", m["word"], m["n_words"], m["licence"], m["permille"])), ",").alias("windows"),
    )


def _oracle() -> str:
    def row(i, name, text):
        grams = ", ".join("'" + g + "'" for g in template_bigrams(text))
        return f"({-i}, '{name}', {len(template_bigrams(text))}, {len(template_words(text))}, [{grams}])"

    values = ",\n".join(row(i, n, t) for i, (n, t) in enumerate(TEMPLATES))
    return f"""
WITH t(ord, licence, n, n_words, grams) AS (VALUES {values}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    string_split(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) AS lines
  FROM documents),
u AS (
  SELECT rid, i - 1 AS line, lines[i] AS unit FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)
  UNION ALL SELECT rid, -1, array_to_string(lines, ' ') FROM d WHERE len(lines) > 1),
w AS (SELECT rid, line, regexp_extract_all(unit, '[a-z0-9]+') AS w FROM u),
g AS (
  SELECT DISTINCT rid, line, w[i] || ' ' || w[i + 1] AS gram
  FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)),
n AS (SELECT rid, line, count(*) AS a FROM g GROUP BY ALL),
x AS (
  SELECT rid, line, ord, licence, n, count(*) AS shared
  FROM g JOIN (SELECT ord, licence, n, unnest(grams) AS gram FROM t) USING (gram) GROUP BY ALL),
s AS (
  SELECT rid, line, licence, ord, CAST(2000 * shared // (a + n) AS INTEGER) AS permille
  FROM x JOIN n USING (rid, line)),
m AS (
  SELECT rid, line, licence, permille FROM s WHERE permille >= 800
  QUALIFY row_number() OVER (PARTITION BY rid, line ORDER BY permille DESC, ord DESC, licence DESC) = 1),
a AS (
  SELECT rid, count(*) AS n_matches, max(struct_pack(permille := permille, licence := licence)) AS top,
    string_agg(line || ':' || licence || ':' || permille, ',' ORDER BY line) AS matches
  FROM m GROUP BY rid),
b AS (SELECT rid, regexp_extract_all(array_to_string(lines, ' '), '[a-z0-9]+') AS ws FROM d),
h AS (SELECT rid, [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] AS seq FROM b),
tg AS (SELECT ord, licence, n, n_words, unnest(grams) AS gram FROM t),
k AS (
  SELECT rid, ord, licence, n, n_words, place
  FROM (SELECT rid, unnest(seq) AS gram, unnest(range(len(seq))) AS place FROM h) JOIN tg USING (gram)),
c AS (
  SELECT rid, ord, licence, n, n_words, place, list(place) OVER (
    PARTITION BY rid, ord ORDER BY place RANGE BETWEEN CURRENT ROW AND n_words - 2 FOLLOWING) AS near
  FROM k),
v AS (
  SELECT rid, ord, licence, n, n_words, place, list_distinct(seq[place + 1:place + n_words - 1]) AS win
  FROM c JOIN h USING (rid) WHERE 3 * len(near) >= 2 * n),
q AS (
  SELECT rid, ord, licence, n_words, place, CAST(2000 * len(list_intersect(win, grams)) // (len(win) + n) AS INTEGER) AS permille
  FROM v JOIN (SELECT ord, grams FROM t) USING (ord)),
z AS (SELECT * FROM q WHERE permille >= 800),
y AS (
  SELECT rid, count(*) AS n_windows, string_agg(place || ':' || n_words || ':' || licence || ':' || permille, ','
    ORDER BY place, n_words, licence, permille) AS windows
  FROM z WHERE NOT EXISTS (
    SELECT 1 FROM z o WHERE o.rid = z.rid AND o.ord = z.ord AND abs(o.place - z.place) < z.n_words
      AND (o.permille > z.permille OR (o.permille = z.permille AND o.place < z.place)))
  GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_matches, 0) AS INTEGER) AS n_matches, coalesce(top.licence, '') AS licence,
  coalesce(top.permille, 0) AS permille,
  coalesce(matches, '') AS matches, CAST(coalesce(n_windows, 0) AS INTEGER) AS n_windows, coalesce(windows, '') AS windows
FROM d LEFT JOIN a USING (rid) LEFT JOIN y USING (rid)
"""


ORACLE = _oracle()
