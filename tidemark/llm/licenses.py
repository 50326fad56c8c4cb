"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Words are runs of 0-9, a-z (A-Z lower-cased) and code points from \\x80 on. A template is a clause of a license or of its
usual notice, as a set of words. A block is a run of neighbouring lines: LINES of them for short templates, WRAPPED for
those that take several lines when they are wrapped; one starts at each line. A template is found in a block that holds
at least CONTAINMENT of the template's distinct words.

The join: the templates' words are ordered by the number of lines of the whole corpus that hold them, rarest first.
A block can only hold enough of a template if they share a word of the template's prefix, the |T| - need + 1 rarest
(prefix filter); if the block has `need` words of any template at all (length filter); and if from the first shared
word on, both have words enough left (positional filter). Texts without a prefix word make no blocks. Words that no
template has can't change any of the three, so blocks are cut down to template words first. Candidates are then counted
in full. The template index has a row for each prefix word, a size fixed by TEMPLATES, and is the only thing that is
broadcast. Built-in functions only.

Cases: a null or empty text has no words and no labels. Rows that repeat a doc_id with another text keep labels of their
own; equal rows have equal results. A very long line is part of a block like others; a text is handled whole, in one task.
Several templates of one label count as the best of them. Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Clauses of licenses and of their notices, with labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache-2", "See the License for the specific language governing permissions and limitations under the License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
)
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.9
#: Lines of a block for templates of up to SHORT words, and for others: wrapped at 60 characters, they begin and end anywhere.
LINES, SHORT, WRAPPED = 2, 12, 6
#: In lower-cased text, what separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    """Distinct words of a template."""
    return list(dict.fromkeys(re.findall("[0-9a-z]+", text.lower())))


def needed(n: int) -> int:
    """Words of a template of n that a block must hold."""
    return math.ceil(CONTAINMENT * n - 1e-9)


def _lowered(text: Column) -> Column:
    """A-Z in lower case. The two other letters whose lower case has ASCII letters are put aside first."""
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("℀")), F.lit("İ"), F.lit("℀")))


def _spaced(text: Column) -> Column:
    """Words with single spaces between, none at the ends."""
    return F.trim(F.regexp_replace(text, GAP, " "))


def _count(text: Column, part: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)


def _places(words: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(count, smallest start, largest start) of a phrase among words with a space before, between and after."""
    one = f" {phrase} "
    wide, found = F.replace(words, F.lit(" "), F.lit("  ")), F.contains(words, F.lit(one))
    space = F.lit(" ")
    count = F.when(found, _count(wide, F.lit(f" {phrase.replace(' ', '  ')} "))).otherwise(0)
    before = _count(F.substring(words, F.lit(1), F.locate(one, words)), space) - 1
    turned = F.reverse(words)
    after = _count(F.substring(turned, F.lit(1), F.locate(one[::-1], turned)), space) - 1
    return count, F.when(found, before), F.when(found, n_words - after - len(phrase.split()))


def phrase_columns(documents: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), n_words, n_base, first_word, last_word and the array `base`; no shuffle."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.xxhash64("text").alias("mark"), _spaced(_lowered(text)).alias("words"))
    n_words = F.when(F.col("words") == "", 0).otherwise(_count(F.col("words"), F.lit(" ")) + 1)
    rows = rows.select("doc_id", "mark", n_words.alias("n_words"), F.concat(F.lit(" "), "words", F.lit(" ")).alias("words"))
    places = [_places(F.col("words"), F.col("n_words"), p) for p in PHRASES]
    counts, firsts, lasts = zip(*places, strict=True)
    labels = F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for c, label in zip(counts, PHRASES.values(), strict=True)]))
    return rows.select(
        "doc_id", "mark", F.col("n_words").cast("long"), sum(counts, F.lit(0)).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"), labels.alias("base"),
    )


def span(words: list[str]) -> int:
    """Lines of the blocks that a template is looked for in."""
    return LINES if len(words) <= SHORT else WRAPPED


def vocabulary() -> list[str]:
    """The words of all templates."""
    return sorted({w for _, text in TEMPLATES for w in template_words(text)})


def _words(text: Column) -> Column:
    """The template words of a text, as a set."""
    return F.array_intersect(F.split(_spaced(text), " "), F.array(*map(F.lit, vocabulary())))


def word_order(documents: DataFrame) -> dict[str, int]:
    """Rank of each template word that occurs, rarest first: counted over all lines, as many rows as such words."""
    lines = documents.select(F.explode(F.split(_lowered(F.col("text")), "\n")).alias("line"))
    counts = lines.select(F.explode(_words(F.col("line"))).alias("word")).groupBy("word").count().collect()
    return {r.word: i for i, r in enumerate(sorted(counts, key=lambda r: (r["count"], r.word)))}


def template_index(spark, order: dict[str, int]) -> DataFrame:
    """A row for each prefix word of each template: word, template, span, label, all its words, need, words from here on."""
    rows = []
    for i, (label, text) in enumerate(TEMPLATES):
        words = sorted(template_words(text), key=lambda w: (order.get(w, -1), w))
        need = needed(len(words))
        rows += [(w, i, span(words), label, words, need, len(words) - at) for at, w in enumerate(words[: len(words) - need + 1])]
    return spark.createDataFrame(rows, "word string, template int, span int, label string, template_words array<string>, need int, rest int")


def blocks(documents: DataFrame, prefix: list[str]) -> DataFrame:
    """doc_id, mark, span and the template words of every block of the texts that hold a word of the prefix."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("mark"), _lowered(F.col("text")).alias("low"))
    rows = rows.where(F.arrays_overlap(F.split(_spaced(F.col("low")), " "), F.array(*map(F.lit, prefix))))
    rows = rows.select("doc_id", "mark", F.split("low", "\n").alias("lines"))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("lines") - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("span"), F.array_join(F.slice("lines", i, n), " ").alias("block")))

    rows = rows.select("doc_id", "mark", F.explode(F.concat(runs(LINES), runs(WRAPPED))).alias("run"))
    return rows.select("doc_id", "mark", F.col("run.span").alias("block_span"), _words(F.col("run.block")).alias("words"))


def template_matches(documents: DataFrame) -> DataFrame:
    """doc_id, mark, label and score (share of the template's words) of every match of a block with a template."""
    spark = documents.sparkSession
    order = word_order(documents)
    index = template_index(spark, order)
    least = min(needed(len(template_words(text))) for _, text in TEMPLATES)
    some = blocks(documents, sorted({r.word for r in index.select("word").collect()})).where(F.size("words") >= least)
    if order:
        ranks = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
        sorted_words = F.transform(F.array_sort(F.transform("words", lambda w: F.struct(ranks[w].alias("rank"), w.alias("word")))), lambda x: x["word"])
        some = some.withColumn("words", sorted_words)
    probes = some.select("doc_id", "mark", "block_span", "words", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    pairs = probes.join(F.broadcast(index), "word").where((F.col("span") == F.col("block_span")) & (F.least(F.col("n") - F.col("at"), "rest") >= F.col("need")))
    common = F.size(F.array_intersect("words", "template_words"))
    found = pairs.where(common >= F.col("need"))
    return found.select("doc_id", "mark", "label", (common / F.size("template_words")).alias("score"))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and template_labels."""
    base = phrase_columns(documents)
    found = template_matches(documents).groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark"))
    found = found.agg(F.array_sort(F.collect_set("label")).alias("found"), F.max("score").alias("best"))
    rows = base.join(found, base.doc_id.eqNullSafe(found["of"]) & (F.col("mark") == F.col("of_mark")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.array_sort(F.array_distinct("base"))).alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.concat_ws(",", "found").alias("template_labels"),
    )


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle() -> str:
    """DuckDB SQL: every block with every template of its span, without prefixes."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    spaces = "(length({0}) - length(replace({0}, ' ', '')))"
    places, labels = [], []
    for phrase, label in PHRASES.items():
        one = f"' {phrase} '"
        wide = f"' {phrase.replace(' ', '  ')} '"
        n = f"CAST((length(replace(s, ' ', '  ')) - length(replace(replace(s, ' ', '  '), {wide}, ''))) / length({wide}) AS BIGINT)"
        first = f"CASE WHEN contains(s, {one}) THEN {spaces.format(f'substr(s, 1, strpos(s, {one}))')} - 1 END"
        behind = spaces.format(f"substr(reverse(s), 1, strpos(reverse(s), reverse({one})))")
        last = f"CASE WHEN contains(s, {one}) THEN n_words - ({behind} - 1) - {len(phrase.split())} END"
        places.append((n, first, last))
        labels.append(f"SELECT k, {_quoted(label)} AS label FROM w WHERE contains(s, {one})")
    n, first, last = zip(*places, strict=True)
    templates = ", ".join(f"({_quoted(label)}, {span(w)}, [{', '.join(map(_quoted, w))}], {needed(len(w))})" for label, w in ((label, template_words(t)) for label, t in TEMPLATES))
    every = ", ".join(map(_quoted, vocabulary()))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
    s AS (SELECT k, doc_id, t, trim(regexp_replace(t, '{GAP}', ' ', 'g')) AS j FROM d),
    w AS (SELECT k, doc_id, t, ' ' || j || ' ' AS s, CASE WHEN j = '' THEN 0 ELSE {spaces.format('j')} + 1 END AS n_words FROM s),
    l AS (SELECT k, span, lines, unnest(range(1, 1 + greatest(len(lines) - span + 1, 1))) AS i FROM (SELECT k, string_split(t, chr(10)) AS lines FROM d), (VALUES ({LINES}), ({WRAPPED})) AS x(span)),
    b AS (SELECT k, span, list_intersect(string_split(trim(regexp_replace(array_to_string(lines[i:i + span - 1], ' '), '{GAP}', ' ', 'g')), ' '), [{every}]) AS words FROM l),
    tm AS (SELECT * FROM (VALUES {templates}) AS x(label, span, words, need)),
    hit AS (
        SELECT b.k, tm.label, len(list_intersect(b.words, tm.words)) / len(tm.words) AS score FROM b JOIN tm USING (span)
        WHERE len(b.words) >= tm.need AND len(list_intersect(b.words, tm.words)) >= tm.need
    ),
    base AS ({' UNION ALL '.join(labels)}),
    base_of AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY k),
    found_of AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS template_labels, max(score) AS best FROM hit GROUP BY k),
    all_of AS (
        SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
        FROM (SELECT k, label FROM base UNION ALL SELECT k, label FROM hit) GROUP BY k
    )
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, {' + '.join(n)} AS n_base,
           CAST(least({', '.join(first)}) AS BIGINT) AS first_word, CAST(greatest({', '.join(last)}) AS BIGINT) AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CASE WHEN base_labels IS NOT NULL THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score,
           coalesce(template_labels, '') AS template_labels
    FROM w LEFT JOIN base_of USING (k) LEFT JOIN found_of USING (k) LEFT JOIN all_of USING (k)
    """
