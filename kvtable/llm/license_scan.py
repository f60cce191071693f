"""License scans: Dice coefficient over word bigrams against licence templates.

A document's units are its distinct lines and its distinct blocks (parts
between blank lines; a text without any is one block).  A unit is normalised to
lower-case ASCII words and becomes its set of word bigrams; it matches a
template if ``2 * common / (unit + template)`` reaches the threshold.  As
``common`` is at most the smaller set, only units with a size in
``[t / (2 - t), (2 - t) / t]`` of a template's can match it, and only those
are compared.  Nor are units, or whole texts, without any of a few words of the
templates (:func:`telling_words`), as no match can do without them all.

The plan is map-only: the templates are a literal of checked size, and a
document is decided within its row.  NULL and empty texts have no units and
no match; units of fewer than two words have no bigrams and never match;
repeated rows are each reported; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Words from this length on are looked for as plain strings, shorter ones between word borders.
LONG_WORD = 6
#: Bounds on the literal that goes to every task.
MAX_TEMPLATES, MAX_TEMPLATE_WORDS = 500, 20_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
for more details."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution."""
_BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Standard notices (licence identifier, text).  Callers may pass their own.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", f"{_BSD} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD_THIRD),  # the rest is BSD-2-Clause, which is found too
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_DISCLAIMER}"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. No part may be reproduced without permission."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def templates_from(table: DataFrame, id_col: str = "license", text_col: str = "text") -> list[tuple[str, str]]:
    """Templates from the rows of a table (NULLs left out), at most ``MAX_TEMPLATES``; more are an error."""
    rows = table.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).limit(MAX_TEMPLATES + 1).collect()
    if len(rows) > MAX_TEMPLATES:
        raise ValueError("too many templates for one literal: scan with parts of them")
    return sorted((r[0], r[1]) for r in rows)


def bigrams_of(text: str) -> list[str]:
    """The normal form of a template, by the rule that the plan applies to units."""
    words = re.sub("[^A-Za-z0-9]+", " ", text).lower().split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def telling_words(templates: Sequence[tuple[str, str]], threshold: float) -> list[str]:
    """Words such that every match of a template holds at least one of them.

    A match shares at least ``t / (2 - t)`` of the template's bigrams.  So if
    fewer than that are free of the chosen words, a match has a bigram with
    one.  Words are chosen greedily, short (common) ones only where the rest
    does not do.
    """
    open_templates = []
    for _, text in templates:
        found = [b.split() for b in bigrams_of(text)]
        need = math.ceil(threshold / (2 - threshold) * len(found) - 1e-9)
        if found:
            open_templates.append((found, len(found) - max(1, need) + 1))  # bigrams to be hit
    chosen: list[str] = []
    while open_templates:
        gain: dict[str, int] = {}
        for found, lacking in open_templates:
            hits: dict[str, int] = {}
            for bigram in found:
                for word in set(bigram):
                    hits[word] = hits.get(word, 0) + 1
            for word, n in hits.items():
                gain[word] = gain.get(word, 0) + min(n, lacking) * (100 if len(word) >= LONG_WORD else 1)
        best = max(gain, key=lambda w: (gain[w], w))
        chosen.append(best)
        left = [([b for b in found if best not in b], lacking - sum(best in b for b in found)) for found, lacking in open_templates]
        open_templates = [(found, lacking) for found, lacking in left if lacking > 0]
    return sorted(chosen)


def _literal(templates: Sequence[tuple[str, str]]) -> tuple[Column, list[int]]:
    rows = [{"id": name, "n": len(found), "b": found} for name, text in templates if (found := bigrams_of(text))]
    if len(rows) > MAX_TEMPLATES or sum(row["n"] for row in rows) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many or too long templates for one literal: scan with parts of them")
    kind = "array<struct<id:string,n:int,b:array<string>>>"
    return F.from_json(F.lit(json.dumps(rows)), kind), [row["n"] for row in rows]


def size_bounds(n: Column, other: Column, threshold: float) -> Column:
    """Whether sets of these sizes can reach the threshold at all."""
    return 2.0 * F.least(n, other) >= F.lit(threshold) * (n + other)


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    embedded: bool = False,
) -> DataFrame:
    """``doc_id, matches``: ARRAY of (unit, license, dice), one per matching unit and template.

    With ``embedded``, licences that no unit matches are also looked for in runs of words across lines and within
    them; such a match has the words of the run as its unit.
    """
    table, sizes = _literal(templates)
    least = min(sizes, default=1) * threshold / (2 - threshold)
    most = max(sizes, default=0) * (2 - threshold) / threshold
    words = telling_words(templates, threshold)

    def may_match(text: Column) -> Column:
        lowered = F.lower(text)
        tests = [F.contains(lowered, F.lit(w)) for w in words if len(w) >= LONG_WORD]
        if short := [w for w in words if len(w) < LONG_WORD]:
            tests.append(text.rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(short)})(?![a-z0-9])"))
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    text = F.when(may_match(F.col(text_col)), F.col(text_col))
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n")))
    kept = F.transform(
        F.filter(units, may_match),
        lambda u: F.struct(
            u.alias("unit"),
            F.array_remove(F.split(F.lower(F.regexp_replace(u, "[^A-Za-z0-9]+", " ")), " "), "").alias("words"),
        ),
    )
    # k words have at most k - 1 bigrams; repeated ones are dropped, so there is no bound from above here
    kept = F.filter(kept, lambda u: F.size(u["words"]) - 1 >= F.lit(least))
    sets = F.transform(
        kept,
        lambda u: F.struct(
            u["unit"].alias("unit"),
            F.array_distinct(
                F.transform(
                    F.slice(u["words"], 1, F.size(u["words"]) - 1),
                    lambda w, i: F.concat(w, F.lit(" "), F.get(u["words"], i + 1)),
                )
            ).alias("b"),
        ),
    )
    sets = F.filter(sets, lambda s: F.size(s["b"]).between(F.lit(least), F.lit(most)))

    def against(s: Column) -> Column:
        fits = F.filter(F.col("_table"), lambda t: size_bounds(F.size(s["b"]), t["n"], threshold))
        dice = F.transform(
            fits,
            lambda t: F.struct(
                s["unit"].alias("unit"),
                t["id"].alias("license"),
                (2.0 * F.size(F.array_intersect(s["b"], t["b"])) / (F.size(s["b"]) + t["n"])).alias("dice"),
            ),
        )
        return F.filter(dice, lambda d: d["dice"] >= F.lit(threshold))

    found = docs.select(F.col(id_col).alias("doc_id"), sets.alias("_sets"), table.alias("_table"), text.alias("_text"))
    matches = F.flatten(F.transform(F.coalesce(F.col("_sets"), F.array()), against))
    if embedded:
        more = lambda m: F.concat(m, _embedded(F.col("_text"), templates, m["license"], threshold))
        matches = F.when(F.col("_text").isNull(), matches).otherwise(F.flatten(_let(matches, more)))
    return found.select("doc_id", matches.alias("matches"))


def _let(value: Column, then) -> Column:
    """``then`` of the value, which is computed once: an array of one."""
    return F.transform(F.array(value), then)


def _run_bounds(template: str, threshold: float) -> tuple[int, int]:
    """The fewest of a template's bigrams that a matching run holds, and the most bigrams of a run."""
    own = bigrams_of(template)
    length = len(re.sub("[^A-Za-z0-9]+", " ", template).split()) - 1
    return max(1, math.ceil(threshold / (2 - threshold) * len(own) - 1e-9)), math.floor(length * (2 - threshold) / threshold + 1e-9)


def _embedded(text: Column, templates: Sequence[tuple[str, str]], found: Column, threshold: float) -> Column:
    """The best run of words of the text for each template whose licence is not in ``found``, if it reaches the threshold.

    Line ends do not count.  A run that matches holds ``t / (2 - t)`` of a template's bigrams, and the best one begins and
    ends with one of them; runs go up to ``(2 - t) / t`` of the template's length.
    """
    rows = [
        {"id": name, "n": len(own), "need": need, "most": most, "b": own}
        for name, template in templates
        if (own := bigrams_of(template))
        for need, most in [_run_bounds(template, threshold)]
    ]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<id:string,n:int,need:int,most:int,b:array<string>>>")
    words = F.array_remove(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " ")), " "), "")

    def with_bigrams(w: Column) -> Column:
        firsts = F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
        return F.struct(w.alias("w"), F.transform(firsts, lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))).alias("b"))

    def runs(d: Column, t: Column, hits: Column) -> Column:
        def ending(k: Column) -> Column:
            start = F.get(hits, k)
            ends = F.filter(F.slice(hits, k + t["need"], t["most"]), lambda e: e - start < t["most"])
            return F.transform(ends, lambda e: F.struct(start.alias("s"), (e - start + 1).alias("k")))

        def scored(run: Column) -> Column:
            own = F.slice(d["b"], run["s"] + 1, run["k"])
            dice = 2.0 * F.size(F.array_intersect(own, t["b"])) / (F.size(F.array_distinct(own)) + t["n"])
            return F.struct(dice.alias("dice"), run["s"].alias("s"), run["k"].alias("k"))

        spans = F.flatten(F.transform(F.sequence(F.lit(0), F.size(hits) - 1), ending))
        return F.array_max(F.transform(spans, scored))

    def best(d: Column) -> Column:
        def of(t: Column) -> Column:
            hits = F.filter(F.sequence(F.lit(0), F.size(d["b"]) - 1), lambda i: F.array_contains(t["b"], F.get(d["b"], i)))
            named = lambda r: F.struct(
                F.array_join(F.slice(d["w"], r["s"] + 1, r["k"] + 1), " ").alias("unit"), t["id"].alias("license"), r["dice"].alias("dice")
            )
            run = F.flatten(_let(hits, lambda h: _let(runs(d, t, h), named)))
            return F.filter(run, lambda r: r["dice"] >= F.lit(threshold))

        open_ones = F.filter(table, lambda t: ~F.array_contains(found, t["id"]) & (F.size(F.array_intersect(d["b"], t["b"])) >= t["need"]))
        return F.flatten(F.transform(open_ones, of))

    return F.flatten(F.flatten(_let(words, lambda w: _let(with_bigrams(w), best))))


def summary(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_matches, licenses, best_dice``: licences sorted and joined by commas, 0.0 without a match."""
    return scanned.select(
        "doc_id",
        F.size("matches").cast("bigint").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.col("matches")["license"])), ",").alias("licenses"),
        F.coalesce(F.array_max(F.col("matches")["dice"]), F.lit(0.0)).alias("best_dice"),
    )


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The summary of ``documents``, embedded notices included, in DuckDB SQL: every unit and every run of words that
    begins and ends with a bigram of a template, against it."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(
        f"({quoted(name)}, [{', '.join(map(quoted, own))}], {need}, {most})"
        for name, text in templates
        if (own := bigrams_of(text))
        for need, most in [_run_bounds(text, threshold)]
    )
    return rf"""
WITH given(id, tb, need, most) AS (VALUES {values}),
templates AS (SELECT row_number() OVER () AS t, * FROM given),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
units AS (
  SELECT DISTINCT r, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t\r]*\n'))) AS unit
  FROM docs WHERE text IS NOT NULL),
worded AS (
  SELECT r, unit, list_filter(string_split(lower(regexp_replace(unit, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w
  FROM units),
sets AS (
  SELECT r, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM worded WHERE len(w) >= 2),
compared AS (
  SELECT r, id, 2.0::DOUBLE * len(list_intersect(sets.b, tb)) / (len(sets.b) + len(tb)) AS dice FROM sets, templates),
whole AS (SELECT r, id, dice FROM compared WHERE dice >= {threshold!r}),
texts AS (
  SELECT r, list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w
  FROM docs WHERE text IS NOT NULL),
grams AS (SELECT r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM texts WHERE len(w) >= 2),
rest AS (
  SELECT r, t, id, tb, need, most, b FROM grams, templates
  WHERE len(list_intersect(b, tb)) >= need AND NOT EXISTS (SELECT 1 FROM whole WHERE whole.r = grams.r AND whole.id = templates.id)),
hits AS (SELECT *, list_filter(range(1, len(b) + 1), lambda i: list_contains(tb, b[i])) AS h FROM rest),
starts AS (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM hits),
runs AS (SELECT *, unnest(h[k + need - 1 : k + need + most - 2]) AS e FROM starts),
scored AS (
  SELECT r, t, id, 2.0::DOUBLE * len(list_intersect(b[h[k] : e], tb)) / (len(list_distinct(b[h[k] : e])) + len(tb)) AS dice
  FROM runs WHERE e - h[k] < most),
best AS (SELECT r, t, id, max(dice) AS dice FROM scored GROUP BY r, t, id),
found AS (SELECT * FROM whole UNION ALL SELECT r, id, dice FROM best WHERE dice >= {threshold!r}),
matched AS (SELECT r, count(*) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS licenses, max(dice) AS dice FROM found GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, coalesce(dice, 0.0)::DOUBLE AS best_dice
FROM docs LEFT JOIN matched USING (r)
"""
