"""Licence scans by Dice coefficient over word bigrams (operator 1).

A unit of text is a line, a paragraph of several lines, or the whole text. It
is normalised to lower-case words of letters and digits and compared with each
template as a set of word bigrams: 2 * common / (unit + template). Sizes alone
bound the coefficient by 2 * min / (sum), so a template is only tried on units
of a size that can reach the threshold; and a unit with too few bigrams that
occur in any template at all is left out before. A unit of more than LONGEST
words can't be one licence, nor a whole text of more than 40 times as many
characters; their lines and paragraphs are looked at.

Licences inside other text are found by word windows over the whole text, with
the units that hit the same licence cut out. A window begins and ends with a
bigram of the template and is at most as long as the threshold allows; of
windows that overlap the best one counts. A template is tried if enough of its
distinct bigrams occur in the text, whatever its length. No windows are looked
at for a licence that the whole text is. The SQL has the units only.

The scan stays inside the row. A null or empty text has no licence, repeated
rows are scanned each for themselves, other columns pass through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.llm.common import count_up, let
from scanfold.sources.tables import table

#: Least coefficient, in percent.
PERCENT = 80

# Notices and texts of common licences.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "MIT notice": "Released under the MIT License.",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
        AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details.""",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0 notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0 notice": "Released into the public domain under CC0 1.0 Universal.",
    "Unlicense text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    "Zlib text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely.""",
    "All rights reserved notice": "Copyright. All rights reserved.",
}


def template_bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


BIGRAMS = {name: template_bigrams(text) for name, text in TEMPLATES.items()}
LONGEST = 4 * max(len(x) + 1 for x in BIGRAMS.values())


def _bigrams(unit: Column) -> Column:
    """Distinct word bigrams of a unit, none for more than LONGEST words."""
    words = F.filter(F.split(F.lower(unit), "[^a-z0-9]+"), lambda w: w != "")
    return let(words, lambda w: F.when(F.size(w) > LONGEST, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(count_up(F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))))


def _verdicts(bigrams: Column, percent: int) -> Column:
    """(license, dice) of the templates that reach the threshold, only those tried whose size allows it."""
    known = sorted({b for bs in BIGRAMS.values() for b in bs})

    def tried(hits: Column) -> Column:
        n, found = F.size(bigrams), []
        for name, bs in BIGRAMS.items():
            least = (n + len(bs)) * percent
            fits = (F.least(n, F.lit(len(bs))) * 200 >= least) & (F.size(hits) * 200 >= least)
            common = F.size(F.array_intersect(hits, F.array(*map(F.lit, bs))))
            found.append(F.when(fits, common))
        pairs = F.array(*[F.struct(F.lit(name).alias("license"), c.alias("c"), (n + len(bs)).alias("size"))
                          for (name, bs), c in zip(BIGRAMS.items(), found)])
        return F.transform(F.filter(pairs, lambda p: p["c"] * 200 >= p["size"] * percent), lambda p: F.struct(
            p["license"].alias("license"), (p["c"] * 2 / p["size"]).alias("dice")))

    none = F.array().cast("array<struct<license:string,dice:double>>")
    return let(F.filter(bigrams, lambda b: b.isin(known)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(tried(hits)))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """All word bigrams in order."""
    return let(words, lambda w: F.transform(count_up(F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))


def _windows(text: Column, template: Column, percent: int) -> Column:
    """Dice of the best windows of a text for one template; windows that overlap count once."""
    size = F.size(template)
    least, reach = F.ceil(size * percent / (200 - percent)).cast("int"), F.floor(size * (200 - percent) / percent).cast("int")

    def best(pairs: Column, own: Column, k: Column) -> Column:
        first = F.get(own, k)
        near = F.filter(F.transform(count_up(F.least(F.size(own) - k, reach)), lambda d: F.get(own, k + d)),
                        lambda i: i - first < reach)

        def window(n: Column, j: Column) -> Column:
            last = F.get(n, j)
            inside = F.array_distinct(F.transform(count_up(last - first + 1), lambda d: F.get(pairs, first + d)))
            return let(inside, lambda x: F.struct(
                (F.size(F.array_intersect(x, template)) * 2 / (F.size(x) + size)).alias("dice"), (-last).alias("back"),
                first.alias("first"),
                (F.size(F.array_intersect(x, template)) * 200 >= (F.size(x) + size) * percent).alias("ok")))

        def of(n: Column) -> Column:
            enough = F.size(F.array_distinct(F.transform(n, lambda i: F.get(pairs, i)))) >= least
            ends = F.when(enough, F.filter(count_up(F.size(n)), lambda j: j + 1 >= least)).otherwise(F.array().cast("array<int>"))
            return F.array_max(F.filter(F.transform(ends, lambda j: window(n, j)), lambda x: x["ok"]))

        return let(near, of)

    def merge(done: Column, x: Column) -> Column:
        apart = F.array(x)
        return let(F.get(done, F.size(done) - 1), lambda last: F.when(last.isNull() | (x["first"] > -last["back"]), F.concat(
            done, apart)).when(x["dice"] > last["dice"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), apart)).otherwise(done))

    def found(pairs: Column) -> Column:
        places = F.filter(count_up(F.size(pairs)), lambda i: F.array_contains(template, F.get(pairs, i)))
        good = let(places, lambda own: F.filter(F.transform(
            count_up(F.size(own)), lambda k: best(pairs, own, k)), lambda x: x.isNotNull()))
        none = F.array().cast("array<struct<dice:double,back:int,first:int,ok:boolean>>")
        return F.transform(F.aggregate(good, none, merge), lambda x: x["dice"])

    return let(_pairs(_words(text)), found)


def _embedded(text: Column, units: Column, percent: int) -> Column:
    """(license, dice) of licences inside other text; units: (unit, verdicts)."""
    known = sorted({b for bs in BIGRAMS.values() for b in bs})
    templates = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, bs)).alias("bigrams"))
                          for name, bs in BIGRAMS.items()])

    def rest(gone: Column) -> Column:
        cut = lambda x: F.array_contains(gone, x)
        return F.array_join(F.transform(F.split(text, r"\n[\x20\x09\x0B-\x0D]*\n", -1), lambda p: F.when(
            cut(p), F.lit("0cut0")).otherwise(F.array_join(F.transform(F.split(p, "\n", -1), lambda x: F.when(
                cut(x), F.lit("0cut0")).otherwise(x)), "\n"))), "\n")

    def one(x: Column) -> Column:
        gone = F.transform(F.filter(units, lambda u: F.exists(u["v"], lambda v: v["license"] == x["license"])), lambda u: u["u"])
        dices = let(gone, lambda g: F.when(F.array_contains(g, text), F.array().cast("array<double>")).otherwise(
            _windows(rest(g), x["bigrams"], percent)))
        return F.transform(dices, lambda d: F.struct(x["license"].alias("license"), d.alias("dice")))

    hits = F.array_distinct(F.filter(_pairs(_words(text)), lambda b: b.isin(known)))
    likely = let(hits, lambda h: F.when(F.size(h) == 0, F.slice(templates, F.lit(1), F.lit(0))).otherwise(F.filter(
        templates, lambda x: F.size(F.array_intersect(h, x["bigrams"])) * (200 - percent) >= F.size(x["bigrams"]) * percent)))
    return F.flatten(F.transform(likely, one))


def license_hits(text: Column, percent: int = PERCENT) -> Column:
    """Array of (license, dice) over all units of a text, lines, then paragraphs, then the whole, and windows inside others."""
    def units(t: Column) -> Column:
        lines, parts = F.split(t, "\n", -1), F.filter(F.split(t, r"\n[\x20\x09\x0B-\x0D]*\n", -1), lambda p: F.instr(p, "\n") > 0)
        whole = F.when((F.size(lines) > 1) & (F.char_length(t) <= LONGEST * 40), F.array(t)).otherwise(
            F.array().cast("array<string>"))
        return F.concat(lines, parts, whole)

    def both(t: Column) -> Column:
        judged = F.filter(F.transform(units(t), lambda u: F.struct(u.alias("u"), let(
            _bigrams(u), lambda b: _verdicts(b, percent)).alias("v"))), lambda x: F.size(x["v"]) > 0)
        return let(judged, lambda us: F.concat(F.flatten(F.transform(us, lambda x: x["v"])), _embedded(t, us, percent)))

    return let(F.coalesce(text, F.lit("")), both)


def scan_licenses(docs: DataFrame, hits_col: str = "license_hits", percent: int = PERCENT) -> DataFrame:
    """docs with an array column of (license, dice); a column of that name is replaced."""
    return docs.withColumn(hits_col, license_hits(F.col("text"), percent))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), "hits").select("doc_id", "hits")
    names = F.sort_array(F.array_distinct(F.transform("hits", lambda h: h["license"])))
    return rows.select("doc_id", F.size("hits").cast("bigint").alias("n_hits"), F.array_join(names, "; ").alias("licenses"),
                       F.round(F.array_max(F.transform("hits", lambda h: h["dice"])), 6).alias("best_dice"))


def _sql() -> str:
    rows = ", ".join(f"({name!r}, {len(bs)}, '{b}')" for name, bs in BIGRAMS.items() for b in bs)
    return rf"""
WITH tpl(license, m, b) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
units AS (SELECT doc_id, 'l' AS kind, i, ls[i] AS u FROM d, unnest(range(1, len(ls) + 1)) AS r(i)
          UNION ALL SELECT doc_id, 'p', i, ps[i] FROM (SELECT doc_id, list_filter(regexp_split_to_array(t, '\n[\x20\x09\x0B\x0C\x0D]*\n'),
              lambda p: contains(p, chr(10))) AS ps FROM d), unnest(range(1, len(ps) + 1)) AS r(i)
          UNION ALL SELECT doc_id, 'w', 1, t FROM d WHERE len(ls) > 1 AND length(t) <= {LONGEST * 40}),
ws AS (SELECT doc_id, kind, i, regexp_extract_all(lower(u), '[a-z0-9]+') AS w FROM units),
bi AS (SELECT DISTINCT doc_id, kind, i, w[k] || ' ' || w[k + 1] AS b FROM ws, unnest(range(1, len(w))) AS r(k) WHERE len(w) <= {LONGEST}),
n AS (SELECT doc_id, kind, i, count(*) AS n FROM bi GROUP BY ALL),
hits AS (SELECT doc_id, kind, i, license, 2 * count(*) / (any_value(n) + any_value(m)) AS dice
         FROM bi JOIN tpl USING (b) JOIN n USING (doc_id, kind, i) GROUP BY ALL HAVING 200 * count(*) >= {PERCENT} * (any_value(n) + any_value(m)))
SELECT d.doc_id, count(license) AS n_hits, coalesce(string_agg(DISTINCT license, '; ' ORDER BY license), '') AS licenses,
       round(max(dice), 6) AS best_dice FROM d LEFT JOIN hits USING (doc_id) GROUP BY d.doc_id
"""


ORACLE = _sql()
