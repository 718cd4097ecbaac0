"""Licence scans in DataFrame functions only: Dice coefficient over word bigrams against licence templates.

Texts are cut into segments (the whole text, paragraphs, lines and sentences), normalised to lower-case words, and each
segment's set of word bigrams is compared with the templates. Since Dice >= t needs sizes within a factor t / (2 - t),
only templates of near sizes are compared. A segment that reaches t must also share so many of a template's bigrams that
it has one of a few anchor words, which are chosen from the templates so that this test loses nothing; most texts end
there.

A notice may also be spread over several paragraphs or lines, or stand amid other words. So for each licence that no
segment matches, passages are compared too: all runs of adjacent pieces (the text cut at line ends and sentence ends),
and ranges of as many words as the template has. A text is looked at if it shares enough bigrams with a template at all.
Of the runs only those are tried whose last piece adds a bigram of the template that the run doesn't have before, and
whose first piece has one that it doesn't have later; the others have a shorter run that is no worse.

Defined cases: null and empty texts, and segments of fewer than two words, match nothing; equal segments of a text count
once; ties in Dice go to all licences that reach the threshold; repeated rows, and rows of one id with different texts, are
reported as one row with the segments of all; very long texts are cut and compared whole, a segment by its distinct bigrams;
a text in which only a passage matches counts as one segment, if no segment of its id does;
a null id is a document; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

THRESHOLD_PERCENT = 75

# Licence names with their notices and texts, as published.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Words that many texts have, taken as anchors only where nothing else is left.
FREQUENT = frozenset("a all an and any as at be by can code copies copy either for free from if in is it may must not of on one or other shall that the this to under use with without work you your 0 1 2 3 4".split())


def words_of(text: str) -> list[str]:
    return re.sub(r"[^0-9a-z]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def anchor_words(templates: list[tuple[str, str]], percent: int) -> list[str]:
    """Words of which every segment that reaches the threshold against any template must have one.

    Dice >= t leaves at most (1 - t / (2 - t)) of the template's bigrams unshared, so words that touch more of its
    bigrams than that can't all be missing.
    """
    chosen: list[str] = []
    common = Counter(word for _, text in templates for word in set(words_of(text)))
    for _, text in templates:
        grams = bigrams_of(text)
        spare = len(grams) * (200 - 2 * percent) // (200 - percent)
        left = {gram for gram in grams if not set(gram.split()) & set(chosen)}
        while len(grams) - len(left) <= spare:
            touched = Counter(word for gram in left for word in set(gram.split()))
            best = max(touched, key=lambda w: (w not in FREQUENT, touched[w] + (common[w] > 2), len(w), w))
            chosen.append(best)
            left = {gram for gram in left if best not in gram.split()}
    return sorted(set(chosen))


def _words(segment: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(segment), "[^0-9a-z]+", " "), " "), lambda word: word != "")


def _bigrams(words: Column) -> Column:
    return F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda pair: pair.isNotNull())


def _passages(rows: DataFrame, known: list[tuple[str, int, list[str]]], percent: int) -> DataFrame:
    """(doc_id, licence, dice) of each text and licence of which a passage reaches the threshold."""
    table = F.array(*(F.struct(F.lit(i).alias("tid"), F.lit(name).alias("name"), F.lit(words).alias("words"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("size")) for i, (name, words, grams) in enumerate(known)))
    template = F.element_at(table, F.col("tid") + 1)
    every = F.array(*map(F.lit, sorted({gram for _, _, grams in known for gram in grams})))
    # A passage that reaches the threshold has this share of the template's bigrams, so its text has it too.
    enough = lambda common, size: common * (200 - percent) >= size * percent
    least = F.ceil(template["size"] * percent / (200 - percent)).cast("int")
    once = lambda value: F.explode(F.array(value))  # noqa: E731  a step of its own in the plan, so that the value is made once
    split = rows.select("doc_id", "text", once(_bigrams(_words(F.col("text")))).alias("grams"))
    split = split.select("doc_id", "text", once(F.array_intersect("grams", every)).alias("shared")).where(enough(F.size("shared"), min(len(grams) for _, _, grams in known)))
    near = F.filter(table, lambda t: enough(F.size(F.array_intersect("shared", t["grams"])), t["size"]))
    texts = split.select("doc_id", "text", once(F.transform(near, lambda t: t["tid"])).alias("tids")).where(F.size("tids") > 0)
    texts = texts.select("doc_id", "tids", once(F.transform(F.split("text", r"\n|(?<=[.!?])\s+"), _words)).alias("pieces"))
    piece_of = F.flatten(F.transform("pieces", lambda words, i: F.transform(words, lambda _: i)))
    texts = texts.select("doc_id", "tids", piece_of.alias("piece_of"), _bigrams(F.flatten("pieces")).alias("grams"))
    texts = materialize(texts.withColumn("k", F.monotonically_increasing_id()), "licence-texts")
    # Places of a template's bigrams, with the pieces of both words and the places where the bigram stands before and after.
    places = texts.select("k", F.explode("tids").alias("tid"), "grams", "piece_of").select("k", "tid", "piece_of", F.posexplode("grams").alias("place", "gram"))
    places = places.where(F.array_contains(template["grams"], F.col("gram"))).select("k", "tid", "place", "gram", F.get("piece_of", F.col("place")).alias("opens"), F.get("piece_of", F.col("place") + 1).alias("closes"))
    same, along = Window.partitionBy("k", "tid", "gram").orderBy("place"), Window.partitionBy("k", "tid").orderBy("place")
    places = places.withColumn("before", F.coalesce(F.lag("place").over(same), F.lit(-1))).withColumn("after", F.coalesce(F.lead("place").over(same), F.lit((1 << 31) - 1)))
    places = places.withColumn("number", F.row_number().over(along)).drop("gram")
    first = places.groupBy("k", "tid", "opens").agg(F.min("place").alias("first"), F.max("after").alias("after"), F.min("number").alias("low"))
    last = places.groupBy("k", "tid", "closes").agg(F.max("place").alias("last"), F.min("before").alias("before"), F.max("number").alias("high"))
    runs = first.join(last, ["k", "tid"]).where("opens = closes or (opens < closes and before < first and after > last)").where(F.col("high") - F.col("low") + 1 >= least)
    ends = places.select("k", "tid", (F.col("number") - least + 1).alias("number"), F.col("place").alias("end"))
    ranges = places.join(ends, ["k", "tid", "number"]).where(F.col("end") - F.col("place") <= template["words"] - 2)
    spans = runs.select("k", "tid", "opens", "closes", F.lit(None).cast("int").alias("place")).unionByName(ranges.select("k", "tid", F.lit(None).cast("int").alias("opens"), F.lit(None).cast("int").alias("closes"), "place"))
    spans = spans.groupBy("k", "tid").agg(F.collect_list(F.struct("opens", "closes", "place")).alias("spans")).join(texts.drop("tids"), "k")

    def inside(span: Column) -> Column:
        total = F.size("piece_of")
        start = F.coalesce(F.array_position("piece_of", span["opens"]).cast("int") - 1, F.greatest(F.lit(0), F.least(span["place"], total - template["words"])))
        words = F.coalesce(total + 1 - F.array_position(F.reverse("piece_of"), span["closes"]).cast("int") - start, template["words"])
        return F.slice("grams", start + 1, F.greatest(F.lit(0), words - 1))

    # Slices as a step of their own, so that they are made once.
    sets = F.transform(F.transform("spans", inside), lambda grams: F.array_distinct(grams))
    sizes = F.transform(sets, lambda grams: F.struct(F.size(F.array_intersect(grams, template["grams"])).alias("common"), (F.size(grams) + template["size"]).alias("both")))
    reached = spans.select("k", "doc_id", template["name"].alias("licence"), F.explode(F.filter(sizes, lambda m: m["common"] * 200 >= m["both"] * percent)).alias("m"))
    return reached.groupBy("k", "doc_id", "licence").agg(F.max(F.col("m.common") * 2.0 / F.col("m.both")).alias("dice")).select("doc_id", "licence", "dice")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(doc_id, licence, dice, segments): the licences that a segment of a text, or else a passage, matches, with the best coefficient."""
    templates = TEMPLATES if templates is None else templates
    known = [(name, grams) for name, text in templates if (grams := bigrams_of(text))]
    anchors = F.lit(rf"(?:^|[^0-9a-z])(?:{'|'.join(anchor_words(templates, percent))})(?:[^0-9a-z]|$)")
    least, most = min(len(g) for _, g in known) * percent // (200 - percent), max(len(g) for _, g in known) * (200 - percent) // percent + 1
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("size")) for name, grams in known))
    text = F.col("text")
    cuts = F.array_distinct(F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, r"\n"), F.split(text, r"(?<=[.!?])\s+")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.regexp_like(F.lower("text"), anchors))
    segments = rows.select("doc_id", F.explode(cuts).alias("segment")).where(F.regexp_like(F.lower("segment"), anchors))
    words = segments.select("doc_id", _words(F.col("segment")).alias("words")).where(F.size("words") > least)
    sized = words.select("doc_id", F.array_distinct(_bigrams(F.col("words"))).alias("grams")).where(F.size("grams").between(least, most))
    size = F.size("grams")
    near = F.filter(table, lambda t: (t["size"] * (200 - percent) >= size * percent) & (size * (200 - percent) >= t["size"] * percent))
    compared = F.transform(near, lambda t: F.struct(t["name"].alias("name"), F.size(F.array_intersect("grams", t["grams"])).alias("common"), (t["size"] + size).alias("both")))
    matched = F.filter(compared, lambda t: t["common"] * 200 >= t["both"] * percent)
    numbered = sized.select("doc_id", matched.alias("matched")).where(F.size("matched") > 0).withColumn("s", F.monotonically_increasing_id())
    found = numbered.select("doc_id", "s", F.explode("matched").alias("m"))
    best = found.groupBy("doc_id", "s", F.col("m.name").alias("licence")).agg(F.max(F.col("m.common") * 2.0 / F.col("m.both")).alias("dice"))
    both = best.select("doc_id", "licence", "dice", F.lit(True).alias("cut")).unionByName(_passages(rows, [(name, len(words_of(text)), grams) for name, text in templates if (grams := bigrams_of(text))], percent).withColumn("cut", F.lit(False)))
    ranked = both.groupBy("doc_id", "licence", "cut").agg(F.round(F.max("dice"), 6).alias("dice"), F.count(F.lit(1)).alias("segments"))
    chosen = ranked.groupBy("doc_id", "licence").agg(F.max(F.struct("cut", "dice", "segments")).alias("best"))
    return chosen.select("doc_id", "licence", "best.dice", "best.segments")


def sql(templates: list[tuple[str, str]] | None = None, percent: int = THRESHOLD_PERCENT) -> str:
    """The same for segments in DuckDB's SQL over `documents`, without the anchor words and without passages."""
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(name)}, [{', '.join(map(quote, bigrams_of(text)))}])" for i, (name, text) in enumerate(TEMPLATES if templates is None else templates))
    return rf"""
WITH templates(tid, licence, tgrams) AS (VALUES {rows}),
cut AS (SELECT doc_id, unnest(list_distinct(list_concat([text], regexp_split_to_array(text, '\n\s*\n'),
          regexp_split_to_array(text, '\n'), string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))))) AS segment
        FROM documents WHERE text IS NOT NULL),
w AS (SELECT row_number() OVER () AS s, doc_id, list_filter(string_split(regexp_replace(lower(segment), '[^0-9a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM cut),
g AS (SELECT s, doc_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w WHERE len(words) >= 2),
m AS (SELECT s, doc_id, licence, max(2.0 * len(list_intersect(grams, tgrams)) / (len(grams) + len(tgrams))) AS dice
      FROM g JOIN templates ON len(tgrams) * {200 - percent} >= len(grams) * {percent} AND len(grams) * {200 - percent} >= len(tgrams) * {percent}
      GROUP BY s, doc_id, licence)
SELECT doc_id, licence, round(CAST(max(dice) AS DOUBLE), 6) AS dice, count(*) AS segments FROM m WHERE dice >= {percent / 100} GROUP BY doc_id, licence
"""
