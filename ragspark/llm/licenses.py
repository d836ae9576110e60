"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.tables import ascii_lower, text_key, written

# What stands between words, and the base phrases with their labels.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Public license texts and the notices that licenses ask for, by label.
LICENSES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
        do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
        HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
        FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software
        must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source
        distribution.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
        following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
        following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
        unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language
        processor.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
        and by any means.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
        to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
        License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "lgpl-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This
        library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "agpl-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "cc-by-4.0": """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit
        http://creativecommons.org/licenses/by/4.0/""",
    "cc-by-sa-4.0": """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this
        license, visit http://creativecommons.org/licenses/by-sa/4.0/""",
    "cc-by-nc-4.0": """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this
        license, visit http://creativecommons.org/licenses/by-nc/4.0/""",
}
#: their words, by label; of a bounded, fixed size
TEMPLATES = {label: [w for w in re.split("[^a-z0-9]+", text.lower()) if w] for label, text in LICENSES.items()}
#: share of a template's words that a block must hold
CONTAINMENT = 0.8
#: words of a cell, in which templates that are like each other are compared; blocks are whole numbers of cells
CELL = 32


def words_of(text: Column) -> Column:
    """Array of a text's words, A-Z in lower case (null and empty: none)."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def step_of(label: str) -> int:
    """A template's blocks are windows of twice so many words, at multiples of it: the least power of two that the
    template's words fit in, so that an occurrence of as many words lies in one block."""
    return max(CELL, 1 << (len(TEMPLATES[label]) - 1).bit_length())


def families() -> dict[str, str]:
    """label -> the first label of its family: templates linked by one holding CONTAINMENT of the other's words."""
    sets, family = {k: set(v) for k, v in TEMPLATES.items()}, {k: k for k in sorted(TEMPLATES)}
    for a in sorted(sets):
        for b in sorted(sets):
            if len(sets[a] & sets[b]) >= CONTAINMENT * min(len(sets[a]), len(sets[b])):
                first, other = sorted((family[a], family[b]))
                family = {k: first if f == other else f for k, f in family.items()}
    return family


def best_labels(met: DataFrame) -> DataFrame:
    """met(key, step, block, label, containment) -> (key, label): the labels that their places speak for.

    Templates of one family hold most of each other's words, so one occurrence meets several. In each cell of
    CELL words the one of largest containment counts, of equal ones that of most words, as it holds the words
    that set it apart. A label stays that counts in all cells of one of its blocks.
    """
    kinds = [(label, family, len(set(TEMPLATES[label]))) for label, family in families().items()]
    named = met.join(F.broadcast(met.sparkSession.createDataFrame(kinds, "label string, family string, n int")), "label")
    at = F.sequence((F.col("block") * F.col("step") / CELL).cast("int"), ((F.col("block") + 2) * F.col("step") / CELL).cast("int") - 1)
    cells = named.select("key", "step", "block", "label", "family", F.struct("containment", "n", "label").alias("rank"), F.explode(at).alias("cell"))
    # a row a cell and template at most, so that no group grows with the text
    cells = written(cells)
    lead = cells.groupBy("key", "family", "cell").agg(F.max("rank").alias("lead"))
    won = cells.join(lead, ["key", "family", "cell"]).groupBy("key", "label", "step", "block").agg(F.bool_and(F.col("lead.label") == F.col("label")).alias("all"))
    return won.where("all").select("key", "label").distinct()


def vocabulary() -> list[str]:
    return sorted({w for words in TEMPLATES.values() for w in words})


def token_order(texts: DataFrame) -> dict[str, int]:
    """Rank of each of the templates' words by how many texts of the corpus hold it, the rarest first."""
    held = texts.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary())))).alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in held.collect()}  # as long as the templates
    return {w: i for i, w in enumerate(sorted(vocabulary(), key=lambda w: (counts.get(w, 0), w)))}


def template_blocks(texts: DataFrame, rank: dict[str, int]) -> DataFrame:
    """texts(key, words) -> (key, step, block, label, containment) for every block that meets a template's threshold.

    Exact: a block that shares `need` of a template's n words shares one of its n - need + 1 rarest (prefix
    filter). Blocks with fewer known words than `need` drop out (length filter), and so do those whose words
    from the shared one on are too few (positional filter). What remains is verified. A template is met by
    the blocks of its own length only.
    """
    index, least = [], {}
    for label, words in TEMPLATES.items():
        own, step = sorted({rank[w] for w in words}), step_of(label)
        need = -int(-len(own) * CONTAINMENT // 1)
        least[step] = min(need, least.get(step, need))
        index += [(step, label, own, len(own), need, r, i) for i, r in enumerate(own[: len(own) - need + 1])]
    prefixes = texts.sparkSession.createDataFrame(index, "step int, label string, own array<int>, n int, need int, rank int, at int")
    rarest = F.array(*map(F.lit, sorted({w for w, r in rank.items() if any(r == x[5] for x in index)})))
    ranks = texts.sparkSession.createDataFrame(sorted(rank.items()), "token string, rank int")
    # a text with fewer of the templates' words than any of them needs has no block
    enough = F.size(F.array_intersect("words", F.array(*map(F.lit, vocabulary())))) >= min(least.values())
    place = texts.where(F.arrays_overlap("words", rarest) & enough).select("key", F.posexplode("words").alias("i", "token")).join(F.broadcast(ranks), "token")
    # a word at step's block b is in the windows b - 1 and b
    steps = F.array(*(F.struct(F.lit(x).alias("step"), (F.col("i") / x).cast("int").alias("b")) for x in sorted(least)))
    place = place.select("key", "rank", F.explode(steps).alias("s")).select("key", "rank", "s.step", "s.b")
    blocks = (
        place.select("key", "rank", "step", F.explode(F.array("b", F.col("b") - 1)).alias("block"))
        .where("block >= 0")
        .groupBy("key", "step", "block")
        .agg(F.array_sort(F.collect_set("rank")).alias("held"))  # bounded by the templates' words
        .where(F.size("held") >= F.coalesce(*(F.when(F.col("step") == k, v) for k, v in least.items())))
    )
    met = (
        blocks.select("key", "step", "block", "held", F.posexplode("held").alias("pos", "rank"))
        .join(F.broadcast(prefixes), ["step", "rank"])
        .where("size(held) >= need and least(n - at, size(held) - pos) + least(at, pos) >= need")
    )
    shared = F.size(F.array_intersect("held", "own"))
    return met.where(shared >= F.col("need")).select("key", "step", "block", "label", (shared / F.col("n")).alias("containment")).distinct()


def _phrases(joined: Column) -> dict[str, Column]:
    """Where the base phrases stand in words joined by spaces (one at either end): count, first and last word."""
    before = lambda part: (F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))).cast("long")
    n, first, last, labels = [], [], [], []
    for phrase, label in sorted(PHRASES.items(), key=lambda x: x[1]):
        here = F.locate(f" {phrase} ", joined)
        n.append(F.regexp_count(joined, F.lit(f" {phrase}(?= )")).cast("long"))
        found = here > 0
        first.append(F.when(found, before(F.substring(joined, F.lit(1), here)) - 1))
        # words behind the last place, taken from all words
        behind = F.substring_index(joined, f" {phrase} ", -1)
        last.append(F.when(found, before(joined) - 1 - (before(behind) + len(phrase.split()))))
        labels.append(F.when(found, label))
    total = n[0]
    for x in n[1:]:
        total = total + x
    return {"n_base": total, "first_word": F.least(*first), "last_word": F.greatest(*last), "base_labels": F.array_compact(F.array(*labels))}


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches).

    labels: the base phrases' labels and the best ones of the templates met (see best_labels). matches: all
    templates that a block of the text meets. score: the largest share of a template's words that a block
    holds, where it meets the threshold; else 0. Null and empty texts have no words, null first and last words,
    empty labels and score 0. Repeated rows and null ids are returned as they come.
    """
    rows = docs.select("doc_id", text_key().alias("key"), words_of(F.col("text")).alias("words"))
    keyed = rows.select("key", "words")
    met = template_blocks(keyed, token_order(keyed))
    met = written(met)
    every = met.groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("every"), F.max("containment").alias("best"))
    named = best_labels(met).groupBy("key").agg(F.collect_set("label").alias("met"))
    per_text = written(every.join(named, "key", "left"))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    base = rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), joined.alias("joined"))
    base = base.select("doc_id", "key", "n_words", *(c.alias(k) for k, c in _phrases(F.col("joined")).items()))
    return base.join(per_text, "key", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("met", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
        F.coalesce(F.array_join("every", ","), F.lit("")).alias("matches"),
    )


def _sql() -> str:
    family, steps = families(), sorted({step_of(k) for k in TEMPLATES})
    values = ", ".join(f"({step_of(k)}, '{k}', '{family[k]}', ['{"', '".join(sorted(set(v)))}'])" for k, v in TEMPLATES.items())
    count = " union all ".join(
        f"select doc_id, '{label}' as label, unnest(range(1, len(w) + 1)) as i, w, {len(p.split())} as n, ['{"', '".join(p.split())}'] as p from words"
        for p, label in PHRASES.items()
    )
    return f"""
with words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{NOT_WORD}'), lambda x: x <> '') as w from documents),
places as (select doc_id, label, i - 1 as i from ({count}) where w[i:i + n - 1] = p),
base as (
  select doc_id, count(*) as n, min(i) as a, max(i) as b, list(distinct label) as labels from places group by doc_id),
blocks as (
  select doc_id, step, b, list_distinct(w[b * step + 1:(b + 2) * step]) as held from (
    select doc_id, w, step, unnest(range(0, len(w) // step + 1)) as b from words, (values {", ".join(f"({x})" for x in steps)}) t(step))),
met as (
  select doc_id, step, b, label, family, len(tokens) as n, len(list_intersect(held, tokens)) / len(tokens) as c
  from blocks join (values {values}) as t(step, label, family, tokens) using (step)
  where len(held) >= ceil(len(tokens) * {CONTAINMENT}) and len(list_intersect(held, tokens)) >= ceil(len(tokens) * {CONTAINMENT})),
cells as (
  select *, row_number() over (partition by doc_id, family, cell order by c desc, n desc, label desc, step, b) as place from (
    select *, unnest(range(b * step // {CELL}, (b + 2) * step // {CELL})) as cell from met)),
leads as (select doc_id, family, cell, label as lead from cells where place = 1),
won as (select doc_id, label from cells join leads using (doc_id, family, cell) group by doc_id, label, step, b having bool_and(label = lead)),
named as (select doc_id, list(distinct label) as labels from won group by doc_id),
best as (select doc_id, list(distinct label) as every, max(c) as c from met group by doc_id)
select w.doc_id, len(w) as n_words, coalesce(n, 0) as n_base, a as first_word, b as last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(named.labels, [])))), ','), '') as labels,
  coalesce(c, 0.0)::double as score, coalesce(array_to_string(list_sort(every), ','), '') as matches
from words w left join base using (doc_id) left join best using (doc_id) left join named using (doc_id)
"""


SQL = _sql()
