r"""License scan by a positional index of rare words.

The templates' words form a small vocabulary. One pass counts in how many files each of
them occurs, over all files. A second pass looks up, for each template whose mandatory key
phrases stand in the file, those of its words in the file that have the highest IDF, joins their
places with the template's postings, groups the hits by relative position (place in the file
minus place in the template) and keeps alignments that enough of these words support. Templates
are judged apart, and words are ranked but never struck, so every template has anchors however
many notices a file holds and however common they are. The key phrases are mandatory, so looking for them first
changes no result and keeps files without any from being split into words.

Words are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z. Base labels
are phrases whose words stand consecutively; they always stay.

Defined cases: null text is empty; empty text has no words, null places, empty labels and
score 0; every row is judged by its own text (rows are told apart by doc_id and 128 bits of the text), a null
doc_id too; repeated rows give repeated results; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, a licence text or notice, and phrases that must stand in the file.
TEMPLATES: list[tuple[str, str, list[str]]] = [
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ["permission is hereby granted", "obtaining a copy"],
    ),
    ("mit", "released under the MIT License", ["the mit license"]),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS.""",
        ["with or without fee is hereby granted"],
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED.""",
        ["redistribution and use in source", "following conditions are met"],
    ),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ["the apache license"],
    ),
    ("gpl", "this work is licensed under the GNU General Public License version 3", ["gnu general public license"]),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3
        of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with
        this program. If not, see https://www.gnu.org/licenses/.""",
        ["gnu general public license", "free software foundation", "redistribute it and or modify"],
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either
        version 2.1 of the License, or (at your option) any later version.""",
        ["gnu lesser general public license"],
    ),
    (
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version.""",
        ["gnu affero general public license"],
    ),
    (
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
        ["mozilla public license"],
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
        ["alter it and redistribute it freely"],
    ),
    (
        "boost",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce,
        display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software""",
        ["any person or organization obtaining a copy"],
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ["free and unencumbered software"],
    ),
    ("cc-by", "this work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution"]),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain CC0 1.0 Universal", ["cc0 1 0 universal"]),
    ("reserved", "All rights reserved", ["all rights reserved"]),
]

#: Of each template's words in a file, so many of the rarest are looked up.
RAREST = 4
#: An alignment stands if this share of the template's rare words that were looked for hit it.
SUPPORT = 0.6


AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What tells rows apart: the id and 128 bits of the text.
ROW = ["doc_id", "h1", "h2"]


def normal(text: Column) -> Column:
    """The words joined by single spaces."""
    return F.btrim(F.regexp_replace(F.translate(text, AZ, AZ.lower()), NOT_WORD, " "), F.lit(" "))


def words(text: str) -> list[str]:
    """The words of a template."""
    return re.sub(NOT_WORD, " ", text.translate(str.maketrans(AZ, AZ.lower()))).split()


def _rows(docs: DataFrame) -> DataFrame:
    """ROW, and s: the normal text."""
    t = text_of()
    return docs.select("doc_id", F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2"), normal(t).alias("s"))


def _base(docs: DataFrame) -> DataFrame:
    d = _rows(docs)
    any_phrase = "|".join(PHRASES)
    found = F.when(F.col("s").rlike("(?:" + any_phrase + ")"), F.expr(f"regexp_extract_all(s, '(?<![^ ])(?:{any_phrase})(?![^ ])', 0)"))
    d = d.withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    spaces = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")
    first = F.expr(f"split(s, '(?<![^ ])(?:{any_phrase})(?![^ ])', 2)[0]")
    rest = F.element_at(F.expr(f"split(s, '(?<![^ ])(?:{any_phrase})(?![^ ])', -1)"), -1)
    hit = F.size("found") > 0
    last = spaces(F.expr("s")) - spaces(rest) - spaces(F.element_at("found", -1))
    label = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    labels = F.array_sort(F.transform(F.array_distinct("found"), lambda p: label[p]))
    return d.select(
        *ROW,
        F.when(F.col("s") == "", F.lit(0).cast("long")).otherwise(spaces(F.col("s")) + 1).alias("n_words"),
        F.size("found").cast("long").alias("n_base"),
        F.when(hit, spaces(first)).alias("first_word"),
        F.when(hit, last).alias("last_word"),
        F.when(hit, labels).otherwise(F.array().cast("array<string>")).alias("base_list"),
    )


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, text, _ in templates for w in words(text)})


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Files that hold each word of the vocabulary, and under "" the number of files. At most one
    row per vocabulary word reaches the driver."""
    vocabulary = F.array(*[F.lit(w) for w in _vocabulary(templates)])
    present = F.array_intersect(vocabulary, F.split(normal(text_of()), " "))
    # Outer forms here and below: from the plain ones Spark infers filters on the arrays, and makes them twice.
    rows = docs.select(F.explode_outer(F.array_append(present, F.lit(""))).alias("w")).groupBy("w").count().collect()
    return {r["w"]: r["count"] for r in rows}


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs``; labels are comma-joined, distinct and sorted."""
    spark = docs.sparkSession
    frequency = document_frequencies(docs, templates)
    base = _base(docs)
    if not templates:
        return _finished(base.withColumns({"added": F.array().cast("array<string>"), "support": F.lit(0.0)}))
    rarity = lambda w: (frequency.get(w, 0), w)
    ranked = [F.array(*[F.lit(w) for w in sorted(set(words(text)), key=rarity)]) for _, text, _ in templates]
    postings = spark.createDataFrame(
        [(w, k, p, label) for k, (label, text, _) in enumerate(templates) for p, w in enumerate(words(text))], "w string, template int, place int, label string"
    )
    phrases = F.array(*[F.lit(x) for x in sorted({f" {x} " for _, _, keys in templates for x in keys})])
    d = _rows(docs).withColumn("s", F.concat(F.lit(" "), "s", F.lit(" ")))
    d = d.select(*ROW, F.filter(phrases, lambda p: F.contains(F.col("s"), p)).alias("keys_found"), F.when(F.size(F.filter(phrases, lambda p: F.contains(F.col("s"), p))) > 0, F.split(F.btrim("s", F.lit(" ")), " ")).alias("w"))
    d = d.withColumn("known", F.array_intersect(F.array(*[F.lit(w) for w in _vocabulary(templates)]), "w"))
    nothing = F.array().cast("array<string>")
    missing = lambda keys: F.array_except(F.array(*[F.lit(f" {x} ") for x in keys]).cast("array<string>"), "keys_found")
    tops = [F.when(F.size(missing(keys)) == 0, F.slice(F.array_intersect(rank, "known"), 1, RAREST)).otherwise(nothing) for rank, (_, _, keys) in zip(ranked, templates, strict=True)]
    d = d.select(*ROW, "w", F.array(*tops).alias("tops"))
    d = d.select(*ROW, "w", "tops", F.array_distinct(F.flatten("tops")).alias("top"))
    d = d.select(*ROW, "tops", F.explode_outer(F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains("top", x["w"]))).alias("x"))
    d = d.where("x IS NOT NULL")
    hits = d.join(F.broadcast(postings), F.col("x.w") == F.col("w")).where("array_contains(tops[template], w)")
    hits = hits.groupBy(*ROW, "template", (F.col("x.i") - F.col("place")).alias("offset")).agg(
        F.count_distinct("w").alias("n"), F.max(F.expr("size(tops[template])")).alias("n_top"), F.first("label").alias("label")
    )
    hits = hits.withColumn("support", F.col("n") / F.col("n_top")).where(F.col("support") >= SUPPORT)
    added = hits.groupBy(*[F.col(c).alias(f"{c}_of") for c in ROW]).agg(F.collect_set("label").alias("added"), F.max("support").alias("support"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in ROW]
    return _finished(base.join(added, same[0] & same[1] & same[2], "left"))


def _finished(d: DataFrame) -> DataFrame:
    """A base phrase is certain; a label that only a template gives scores the share of its rare words found."""
    return d.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_list", F.coalesce("added", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.coalesce("support", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
