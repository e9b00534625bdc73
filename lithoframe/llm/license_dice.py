"""License scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Units of a text are its lines, its paragraphs of several lines (blank lines between them) and, if it has several lines,
the whole text. A unit is lower-cased, every run of other signs than letters and digits becomes a space, and its distinct
word bigrams are compared: 2 * shared / (own + template's). Two exact bounds prune before that. Size: with a threshold t,
the smaller set has at least t / (2 - t) of the larger one's bigrams. Overlap: a match shares at least that part of the
template's bigrams, so it holds one of any n - ceil(n * t / (2 - t)) + 1 of them; those (the pivots) are what units and
templates are joined on, and a text is cut up at all only if a regular expression finds one of them in it.

With ``windows``, a notice that fills no unit is found as well: a comment before code, or a sentence within a line. Around
each pivot in the text, a window of the template's number of words is compared, placed so that the pivot stands where
the template has it. Each licence that no unit of the text matches is reported once, by its best window.

Everything is DataFrame functions. Templates are a fixed list (or a parameter) of at most ``MOST_TEMPLATES`` texts;
their tables are broadcast where their size, reckoned first, is within the bound.

Defined results: null, empty and one-word texts match nothing; a unit may match several licences; several templates of
one licence count as one, with the best coefficient; of equal windows the first counts; repeated (id, text) rows are
reported once, different texts under one id each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.components import written
from lithoframe.llm.textarr import BROADCAST_BYTES

THRESHOLD = 0.8
MOST_TEMPLATES = 2000
#: Notices and paragraphs of common licences, as they are published, and licence identifiers.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/'),
    ("CDDL-1.0", 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.'),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("Artistic-1.0-Perl", "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself."),
    ("MS-PL", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."),
    ("Beerware", "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return."),
    ("X11", "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."),
    ("PHP-3.01", "This source file is subject to version 3.01 of the PHP license, that is bundled with this package in the file LICENSE, and is available through the world-wide-web at the following url: http://www.php.net/license/3_01.txt"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def pivots(templates: tuple[tuple[str, str], ...], t: float) -> list[tuple[str, list[str], list[str]]]:
    """Of each template: its licence, bigrams and pivot bigrams. Rare words come first."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    count: dict[str, int] = {}
    for _, text in templates:
        for w in set(words_of(text)):
            count[w] = count.get(w, 0) + 1
    licence_words = {"license", "licensed", "apache", "mit", "gnu", "copyright", "mozilla", "software", "redistribution"}

    def rare(w: str) -> tuple:
        return (w not in licence_words, len(w) < 3, -len(w), w)

    out = []
    for name, text in templates:
        b = bigrams_of(text)
        if not b:
            continue
        keep = len(b) - math.ceil(len(b) * t / (2 - t) - 1e-9) + 1
        out.append((name, b, sorted(b, key=lambda x: min(map(rare, x.split())))[:keep]))
    return out


def pivot_pattern(bigrams: set[str]) -> str:
    """A regular expression that finds any of the bigrams in lower-cased text, whatever stands between its words."""
    gap, edge = r"[^\p{L}\p{N}]+", r"(?![\p{L}\p{N}])"
    after: dict[str, list[str]] = {}
    for x in bigrams:
        a, b = x.split()
        after.setdefault(a, []).append(b)
    # First words branch by their first sign; the second word is tried only behind one of them.
    by: dict[str, list[str]] = {}
    for a, b in sorted(after.items()):
        by.setdefault(a[0], []).append(f"{re.escape(a[1:])}{gap}(?:{'|'.join(map(re.escape, sorted(b)))}){edge}")
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


def normal(x):
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def _bigrams(w):
    """The bigrams of a word array, repeats included."""
    return F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))


def anchors(templates: tuple[tuple[str, str], ...], t: float) -> list[tuple[int, str, int, int]]:
    """(template, pivot, place of its first word, number of words) of each place of each pivot."""
    out, number = [], 0
    for _, text in templates:
        w = words_of(text)
        if len(w) > 1:
            chosen = set(pivots(templates, t)[number][2])
            out += [(number, f"{a} {b}", k, len(w)) for k, (a, b) in enumerate(zip(w, w[1:])) if f"{a} {b}" in chosen]
            number += 1
    return out


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """One row per id, text, unit and licence: id, unit (line, paragraph, document, window), place (from 0; a window's in words), license, dice."""
    spark = docs.sparkSession
    known = pivots(templates, threshold)
    size = sum(sum(2 * len(x) + 32 for x in b) + sum(2 * len(x) + 64 for x in c) for _, b, c in known)

    def shared(rows, schema):
        table = spark.createDataFrame(rows, schema)
        return F.broadcast(table) if size <= BROADCAST_BYTES else table

    points = shared([(p, k) for k, (_, _, c) in enumerate(known) for p in c], "pivot string, template int")
    theirs = shared([(k, name, b) for k, (name, b, _) in enumerate(known)], "template int, license string, theirs array<string>")
    sizes = [len(b) for _, b, _ in known] or [1]
    share = threshold / (2 - threshold)
    least, most = math.ceil(min(sizes) * share - 1e-9), math.floor(max(sizes) / share + 1e-9)
    every = sorted({x for _, _, c in known for x in c})
    pattern = pivot_pattern(set(every))

    def may(x):
        return x.rlike(pattern) if known else F.lit(False)

    text = F.col("t")
    lines = F.transform(F.split(text, "\n"), lambda x, k: F.struct(F.lit("line").alias("unit"), k.alias("place"), x.alias("x")))
    paras = F.transform(F.split(text, r"\n[ \t\r]*\n"), lambda x, k: F.struct(F.lit("paragraph").alias("unit"), k.alias("place"), x.alias("x")))
    several = F.contains(text, F.lit("\n"))
    paras = F.when(text.rlike(r"\n[ \t\r]*\n"), F.filter(paras, lambda u: F.contains(F.trim(u["x"]), F.lit("\n")))).otherwise(F.array().cast("array<struct<unit:string,place:int,x:string>>"))
    whole = F.when(several, F.array(F.struct(F.lit("document").alias("unit"), F.lit(0).alias("place"), text.alias("x")))).otherwise(F.array().cast("array<struct<unit:string,place:int,x:string>>"))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull() & may(F.lower("t"))).withColumn("h", F.xxhash64("t"))
    # Few texts have a pivot; they are written, so the table is scanned once for units and windows together.
    rows = written(rows, "texts") if windows else rows
    units = rows.select("i", "h", F.explode(F.concat(lines, paras, whole)).alias("u")).select("i", "h", "u.*").where(may(F.lower("x")))
    cut = units.select("i", "h", "unit", "place", F.split(normal(F.col("x")), " ").alias("w")).where(F.size("w") >= 2)
    sized = cut.select("i", "h", "unit", "place", F.array_distinct(_bigrams("w")).alias("own")).where(F.size("own").between(least, most))
    # Only bigrams that are pivots make rows; the templates' own bigrams come by their number afterwards.
    entries = sized.select("i", "h", "unit", "place", "own", F.explode(F.filter("own", lambda x: x.isin(every))).alias("pivot"))
    small, large = F.least(F.size("own"), F.size("theirs")), F.greatest(F.size("own"), F.size("theirs"))
    dice = (2 * F.size(F.array_intersect("own", "theirs")) / (F.size("own") + F.size("theirs"))).alias("dice")
    met = entries.join(points, "pivot").join(theirs, "template").where(small >= share * large - 1e-9)
    scored = met.select("i", "h", "unit", "place", "license", dice)
    best = scored.where(F.col("dice") >= threshold).groupBy("i", "h", "unit", "place", "license").agg(F.max("dice").alias("dice"))
    if not windows or not known:
        return best.select(F.col("i").alias(id_col), "unit", "place", "license", "dice")
    best = written(best, "units")
    places = anchors(templates, threshold)
    reach = max(n for *_, n in places)
    fixed = shared(places, "template int, pivot string, at int, n int")
    spread = rows.select("i", "h", F.split(normal(text), " ").alias("w")).where(F.size("w") >= 2)
    found = F.filter(F.transform(_bigrams("w"), lambda x, k: F.struct(x.alias("pivot"), k.alias("k"))), lambda x: x["pivot"].isin(every))
    # Each hit takes the words that any template may reach from it, not the whole text.
    hit = F.transform(found, lambda x: F.struct(x["pivot"].alias("pivot"), x["k"].alias("k"), F.greatest(x["k"] - reach, F.lit(0)).alias("from"), F.slice(F.col("w"), F.greatest(x["k"] - reach, F.lit(0)) + 1, F.lit(2 * reach)).alias("near")))
    hits = spread.select("i", "h", F.explode(hit).alias("x")).select("i", "h", "x.*").join(fixed, "pivot")
    first = F.greatest(F.col("k") - F.col("at"), F.lit(0))
    framed = hits.select("i", "h", "template", first.alias("place"), F.expr("slice(near, greatest(k - at, 0) - `from` + 1, n + least(k - at, 0))").alias("v")).where(F.size("v") >= 2)
    windowed = framed.select("i", "h", "template", "place", F.array_distinct(_bigrams("v")).alias("own")).join(theirs, "template").where(small >= share * large - 1e-9)
    near = windowed.select("i", "h", "place", "license", dice).where(F.col("dice") >= threshold)
    top = near.groupBy("i", "h", "license").agg(F.max(F.struct("dice", (-F.col("place")).alias("p"))).alias("m")).select("i", "h", F.lit("window").alias("unit"), (-F.col("m.p")).alias("place"), "license", "m.dice")
    by_unit = best.select(F.col("i").alias("bi"), F.col("h").alias("bh"), F.col("license").alias("bl")).distinct()
    rest = top.join(by_unit, F.col("i").eqNullSafe(F.col("bi")) & (F.col("h") == F.col("bh")) & (F.col("license") == F.col("bl")), "left_anti")
    return best.union(rest).select(F.col("i").alias(id_col), "unit", "place", "license", "dice")


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same, windows included, by comparing every unit with every template, in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lists = [(n, bigrams_of(t)) for n, t in templates if bigrams_of(t)]
    values = ", ".join(f"({k}, {quote(n)}, [{', '.join(map(quote, b))}])" for k, (n, b) in enumerate(lists))
    places = ", ".join(f"({k}, {quote(p)}, {at}, {n})" for k, p, at, n in anchors(templates, threshold))
    return rf"""
WITH template(number, license, theirs) AS (VALUES {values}),
anchor(number, pair, place, n) AS (VALUES {places}),
lines AS (SELECT doc_id, 'line' AS unit, unnest(range(len(string_split(text, chr(10))))) AS place, unnest(string_split(text, chr(10))) AS x FROM documents),
paragraphs AS (SELECT * FROM (SELECT doc_id, 'paragraph' AS unit, unnest(range(len(regexp_split_to_array(text, '\n[ \t\r]*\n')))) AS place, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS x
  FROM documents WHERE regexp_matches(text, '\n[ \t\r]*\n')) WHERE contains(trim(x, ' '), chr(10))),
whole AS (SELECT doc_id, 'document' AS unit, 0 AS place, text AS x FROM documents WHERE contains(text, chr(10))),
units AS (FROM lines UNION ALL FROM paragraphs UNION ALL FROM whole),
cut AS (SELECT doc_id, unit, place, string_split(trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
sized AS (SELECT doc_id, unit, place, list_distinct([w[k] || ' ' || w[k + 1] for k in range(1, len(w))]) AS own FROM cut WHERE len(w) >= 2),
by_unit AS (SELECT doc_id, unit, CAST(place AS INTEGER) AS place, license, max(2.0 * len(list_intersect(own, theirs)) / (len(own) + len(theirs))) AS dice
  FROM sized CROSS JOIN template WHERE least(len(own), len(theirs)) * 1.5 + 0.01 >= greatest(len(own), len(theirs)) AND 2.0 * len(list_intersect(own, theirs)) / (len(own) + len(theirs)) >= {threshold} GROUP BY ALL),
words AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
pairs AS (SELECT doc_id, unnest(range(1, len(w))) AS k, unnest([w[j] || ' ' || w[j + 1] for j in range(1, len(w))]) AS pair FROM words WHERE len(w) >= 2),
hits AS (SELECT DISTINCT doc_id, number, greatest(k - 1 - anchor.place, 0) AS place, k - 1 - anchor.place + n AS stop FROM pairs JOIN anchor USING (pair)),
framed AS (SELECT doc_id, number, place, w[place + 1 : stop] AS v FROM hits JOIN words USING (doc_id)),
windowed AS (SELECT doc_id, number, place, list_distinct([v[j] || ' ' || v[j + 1] for j in range(1, len(v))]) AS own FROM framed WHERE len(v) >= 2),
near AS (SELECT doc_id, license, place, 2.0 * len(list_intersect(own, theirs)) / (len(own) + len(theirs)) AS dice FROM windowed JOIN template USING (number)),
top AS (SELECT doc_id, 'window' AS unit, CAST(arg_min(place, (-dice, place)) AS INTEGER) AS place, license, max(dice) AS dice FROM near WHERE dice >= {threshold} GROUP BY doc_id, license)
FROM by_unit UNION ALL FROM top WHERE (doc_id, license) NOT IN (SELECT doc_id, license FROM by_unit WHERE doc_id IS NOT NULL)"""
