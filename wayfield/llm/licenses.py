"""Licence scans: sparse TF-IDF cosine of headers and whole files to templates, and inheritance along paths.

Vectors are word counts times inverse document frequency, over the words of the templates; all other words lie
outside and only add to a vector's length, each like a word that one document has. Document frequencies are counted
over all documents. Three things are compared:

1. lines with one of the signal words, with the one-line notices; the best of at least ``LEAST`` counts;
2. blocks (lines between blank ones; comment marks alone are blank), with standard headers, wrapped as they are, and
   with whole licence texts; the best of at least ``LEAST_TEXT`` counts;
3. whole documents, with the same. A document that is the text of a licence has that licence whatever its lines say.

SPDX-License-Identifier tags count with a score of 1. The best score is the document's own licence.

A licence file is a document that is as a whole like a licence text or header, or of whose words at least
``FILE_SHARE`` stand in lines of the first kind, or that has an own licence and is named LICENSE, COPYING or alike.
Its licence holds for its directory (of several files that which is a text, then that with the highest score, then the
smallest id). A document without an own licence inherits that of the nearest directory above it that has one.

The texts are in ``licence_texts``. Those of the CC BY licences and of AGPL-3.0 are not there: the first are known by
notices, headers and tags, and for AGPL-3.0 the text of GPL-3.0 stands under its name. ``OP10_SQL`` knows only one-line
notices and the share of words in them; the given tables hold nothing else.

Cases: null and empty texts have no own licence but may inherit; a null path lies in no directory; ties go to the
alphabetically first licence; rows that repeat a doc_id are documents of their own; an empty table gives an empty
result. Only ``doc_id``, ``path`` and ``text`` are read. DataFrame functions only.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm.shared import table
from wayfield.sources.scratch import Scratch

# Names (SPDX) and customary notices of licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal."),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is free software under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
]
# A line without one of these is no header of a licence.
SIGNAL = r"(?i)licen[sc]e|copyright|cc0|cc by|redistribution"
LEAST = 0.6
FILE_SHARE = 0.1

# Standard headers as their licences word them.
_GNU = ("This {0} is free software{4} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; "
        "either version {2} of the License, or {3} any later version.")
HEADERS = [
    ("AGPL-3.0", _GNU.format("program", "Affero General Public License", "3", "(at your option)", ":")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for "
                   "additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the License); you may not "
                   "use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
                  "http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit "
                     "http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain "
                "worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this "
                "software. If not, see http://creativecommons.org/publicdomain/zero/1.0/."),
    ("GPL-2.0", _GNU.format("program", "General Public License", "2", "(at your option)", ";")),
    ("GPL-3.0", _GNU.format("program", "General Public License", "3", "(at your option)", ":")),
    ("LGPL-2.1", _GNU.format("library", "Lesser General Public License", "2.1", "(at your option)", ";")),
    ("LGPL-3.0", _GNU.format("library", "Lesser General Public License", "3", "(at your option)", ":")),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
                "one at https://mozilla.org/MPL/2.0/."),
]
LEAST_TEXT = 0.7
# What lies between blocks: a line of blanks and comment marks, or several.
BETWEEN = r"\n[\s#/*;%!<>-]*\n"
TAG = r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)"
FILE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[sc]e|copying)(?:[.-][^/]*)?$"


def words_of(text: Column) -> Column:
    """Lower-case words: runs of ASCII letters, digits, and points or hyphens inside them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def _score(dot: Column, a: Column, b: Column) -> Column:
    return F.round(dot / F.sqrt(a * b), 6)


def licence_texts() -> list[tuple[str, str]]:
    """Names and texts of whole licences."""
    texts = {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    named = re.sub(r"(?i)\bGNU General Public License", "GNU Affero General Public License", texts["GPL-3.0"])
    return [("AGPL-3.0", named), *texts.items()]


def _counts(text: str) -> Counter:
    return Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower()))


def inverse_frequencies(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, Column]:
    """``word, idf`` for the words of all templates, and the weight of all other words."""
    known = sorted(set().union(*[_counts(text) for _, text in [*TEMPLATES, *HEADERS, *licence_texts()]]))
    words = docs.sparkSession.createDataFrame([(w,) for w in known], "word string")
    # The templates' words: a table of fixed size.
    seen = (docs.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).join(F.broadcast(words), "word")
            .groupBy("word").agg(F.count("*").alias("df")))
    total = F.lit(1.0 + docs.count())
    idf = lambda df: F.log(total / (F.lit(1.0) + df)) + 1.0
    rated = words.join(F.broadcast(seen), "word", "left").select("word", idf(F.coalesce("df", F.lit(0))).alias("idf"))
    return scratch.save(rated.coalesce(1), "frequencies"), idf(F.lit(1))


def template_weights(spark: SparkSession, idf: DataFrame, scratch: Scratch) -> DataFrame:
    """``licence, word, idf, weight, square`` of the notices (square of the template's length).

    As many rows as the notices have words.
    """
    rows = [(licence, word, n) for licence, notice in TEMPLATES for word, n in _counts(notice).items()]
    counts = spark.createDataFrame(rows, "licence string, word string, tf long")
    weighed = counts.join(F.broadcast(idf), "word").select("licence", "word", "idf", (F.col("tf") * F.col("idf")).alias("weight"))
    squares = weighed.groupBy("licence").agg(F.sum(F.col("weight") * F.col("weight")).alias("square"))
    return scratch.save(weighed.join(squares, "licence").coalesce(1), "templates")


def text_weights(spark: SparkSession, idf: DataFrame, templates: list[tuple[str, str]], scratch: Scratch) -> DataFrame:
    """``word, idf, parts``: the word's part in each of ``templates``, which have length 1."""
    counts = [_counts(text) for _, text in templates]
    rows = [(word, [float(c[word]) for c in counts]) for word in sorted(set().union(*counts))]
    weighed = spark.createDataFrame(rows, "word string, tf array<double>").join(F.broadcast(idf), "word")
    part = [F.col("tf")[k] * F.col("idf") for k in range(len(templates))]
    lengths = weighed.agg(F.array(*[F.sqrt(F.sum(p * p)) for p in part]).alias("lengths"))
    parts = F.array(*[p / F.col("lengths")[k] for k, p in enumerate(part)])
    return scratch.save(weighed.crossJoin(F.broadcast(lengths)).select("word", "idf", parts.alias("parts")).coalesce(1), "texts")


def header_lines(docs: DataFrame, frequencies: DataFrame, rare: Column, scratch: Scratch) -> DataFrame:
    """``row, doc_id, all_words, line, words, licence, score``: the best notice of each line that has one."""
    templates = template_weights(docs.sparkSession, frequencies, scratch)
    idf = templates.select("word", "idf").distinct()
    marked = docs.where(F.col("text").rlike(SIGNAL)).dropDuplicates(["row"]).withColumn("all_words", F.size(words_of(F.col("text"))))
    lines = marked.select("row", "doc_id", "all_words", F.posexplode(F.split("text", "\n")).alias("line", "content")).where(F.col("content").rlike(SIGNAL))
    counts = (lines.select("row", "doc_id", "all_words", "line", F.explode(words_of(F.col("content"))).alias("word"))
              .groupBy("row", "doc_id", "all_words", "line", "word").agg(F.count("*").alias("tf")))
    # The templates' words: a table of fixed size.
    weighed = counts.join(F.broadcast(idf), "word", "left").withColumn("weight", F.col("tf") * F.coalesce(F.col("idf"), rare))
    line = ["row", "doc_id", "all_words", "line"]
    lengths = weighed.groupBy(*line).agg(F.sum(F.col("weight") * F.col("weight")).alias("own"), F.sum("tf").alias("words"))
    dots = (weighed.join(F.broadcast(templates.select("licence", "word", F.col("weight").alias("other"), "square")), "word")
            .groupBy(*line, "licence", "square").agg(F.sum(F.col("weight") * F.col("other")).alias("dot")))
    scored = dots.join(lengths, line).withColumn("score", _score(F.col("dot"), F.col("own"), F.col("square"))).where(F.col("score") >= LEAST)
    best = F.min(F.struct((-F.col("score")).alias("s"), "licence"))
    return scored.groupBy(*line, "words").agg(best.alias("best")).select(*line, "words", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score"))


def whole_texts(docs: DataFrame, frequencies: DataFrame, rare: Column, scratch: Scratch) -> DataFrame:
    """``row, doc_id, licence, score, whole, is_text``: what blocks and whole documents are like.

    ``whole`` is for a document as a whole; ``is_text`` if it is like the text of a licence, not only like a header.
    """
    texts = licence_texts()
    templates = [*texts, *HEADERS]
    parts = text_weights(docs.sparkSession, frequencies, templates, scratch)
    marked = docs.where(F.col("text").rlike(SIGNAL)).dropDuplicates(["row"])
    # Unit 0 is the document, the others are its blocks.
    pieces = F.concat(F.array("text"), F.filter(F.split("text", BETWEEN), lambda x: x.rlike(SIGNAL)))
    units = marked.select("row", "doc_id", F.posexplode(pieces).alias("unit", "content"))
    counts = units.select("row", "doc_id", "unit", F.explode(words_of(F.col("content"))).alias("word")).groupBy("row", "doc_id", "unit", "word").agg(F.count("*").alias("tf"))
    # The templates' words: a table of fixed size, one row for each word.
    weighed = counts.join(F.broadcast(parts), "word", "left").withColumn("weight", F.col("tf") * F.coalesce(F.col("idf"), rare))
    dots = weighed.groupBy("row", "doc_id", "unit").agg(
        F.sum(F.col("weight") * F.col("weight")).alias("own"), F.array(*[F.sum(F.col("weight") * F.col("parts")[k]) for k in range(len(templates))]).alias("dots"))
    rated = lambda ks: F.array_min(F.array(*[F.struct(
        (-_score(F.coalesce(F.col("dots")[k], F.lit(0.0)), F.col("own"), F.lit(1.0))).alias("s"), F.lit(templates[k][0]).alias("licence")) for k in ks]))
    best = dots.select("row", "doc_id", (F.col("unit") == 0).alias("whole"), rated(range(len(texts))).alias("text"), rated(range(len(templates))).alias("any"))
    is_text = F.col("whole") & (F.col("text.s") <= -LEAST_TEXT)
    chosen = F.when(is_text, F.col("text")).otherwise(F.col("any"))
    return best.where(F.col("any.s") <= -LEAST_TEXT).select("row", "doc_id", chosen["licence"].alias("licence"), (-chosen["s"]).alias("score"), "whole", is_text.alias("is_text"))


def tags(docs: DataFrame) -> DataFrame:
    """``row, doc_id, licence``: the known licences that SPDX tags name."""
    names = sorted({name for name, _ in [*TEMPLATES, *HEADERS, *licence_texts()]})
    known = docs.sparkSession.createDataFrame([(n, n.lower()) for n in names], "licence string, name string")
    named = docs.select("row", "doc_id", F.explode(F.regexp_extract_all("text", F.lit(TAG), F.lit(1))).alias("tag"))
    apart = named.select("row", "doc_id", F.explode(F.split(F.lower("tag"), r"[^a-z0-9.+-]+")).alias("name"))
    return apart.withColumn("name", F.regexp_replace("name", r"(?:-only|-or-later|\+)$", "")).join(F.broadcast(known), "name").select("row", "doc_id", "licence").distinct()


def parents(path: Column) -> Column:
    """The directories above a path, the nearest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def license_scan(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, path, licence, score, origin, directory, steps`` for every row of ``docs(doc_id, path, text)``.

    ``origin`` is ``header``, ``inherited`` or null; ``directory`` is the one inherited from, ``steps`` directories up.
    """
    scratch = scratch or Scratch(docs.sparkSession, "licences")
    # A row is known by its id, its path and its text.
    rows = docs.select("doc_id", "path", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("path", F.lit("")), F.coalesce("text", F.lit(""))).alias("row"))
    frequencies, rare = inverse_frequencies(rows, scratch)
    no, none = F.lit(False), F.lit(None).cast("bigint")
    found = (header_lines(rows, frequencies, rare, scratch).select("row", "doc_id", "licence", "score", no.alias("whole"), no.alias("is_text"), "words", F.col("all_words").cast("bigint").alias("all_words"))
             .unionByName(whole_texts(rows, frequencies, rare, scratch).withColumns({"words": none, "all_words": none}))
             .unionByName(tags(rows).withColumns({"score": F.lit(1.0), "whole": no, "is_text": no, "words": none, "all_words": none})))
    best = F.min(F.struct((~F.col("is_text")).alias("other"), (-F.col("score")).alias("s"), "licence"))
    share = F.coalesce(F.sum("words") >= FILE_SHARE * F.max("all_words"), no)
    own = scratch.save(found.groupBy("row", "doc_id").agg(best.alias("best"), (F.max("whole") | share).alias("is_file")).select(
        F.col("row").alias("_row"), F.col("doc_id").alias("_doc"), F.col("best.licence").alias("own"), (-F.col("best.s")).alias("own_score"), (~F.col("best.other")).alias("is_text"), "is_file"), "own")
    known = scratch.save(rows.select("doc_id", "path", "row").join(own, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_row", "_doc", "row"), "rows")
    directory = F.try_element_at(parents(F.col("path")), F.lit(1))
    is_file = F.col("is_file") | (F.col("own").isNotNull() & F.col("path").rlike(FILE_NAME))
    first = F.min(F.struct((~F.col("is_text")).alias("other"), (-F.col("own_score")).alias("s"), F.col("doc_id").isNull().alias("none"), "doc_id", "own"))
    files = (known.where(is_file & F.col("path").contains("/")).groupBy(directory.alias("above")).agg(first.alias("file"))
             .select("above", F.col("file.own").alias("licence"), (-F.col("file.s")).alias("score")))
    # Each directory once, however many documents it has.
    folders = known.where("path LIKE '%/%'").select(directory.alias("folder")).distinct()
    chains = folders.select("folder", F.posexplode(F.concat(F.array("folder"), F.when(F.col("folder").contains("/"), parents(F.col("folder"))).otherwise(F.array().cast("array<string>")))).alias("steps", "above"))
    nearest = F.min(F.struct("steps", "above", "licence", "score"))
    inherited = (chains.join(files, "above").groupBy("folder").agg(nearest.alias("from"))
                 .select("folder", F.col("from.steps").alias("up"), F.col("from.above").alias("above"), F.col("from.licence").alias("theirs"), F.col("from.score").alias("their_score")))
    # From a table, so that adaptive execution splits the key of a directory with very many documents.
    inherited = scratch.save(inherited, "inherited")
    joined = known.withColumn("folder", F.when(F.col("path").contains("/"), directory)).join(inherited, "folder", "left")
    has = F.col("own").isNotNull()
    return joined.select("doc_id", "path", F.coalesce("own", "theirs").alias("licence"), F.coalesce("own_score", "their_score").alias("score"),
                         F.when(has, "header").when(F.col("theirs").isNotNull(), "inherited").alias("origin"),
                         F.when(~has, F.col("above")).alias("directory"), F.when(~has, F.col("up")).cast("int").alias("steps"))


def with_paths(documents: DataFrame) -> DataFrame:
    """Documents as files: in their source's directory, its language's or a hundred's inside that, in turn."""
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    hundred = F.expr("doc_id div 100").cast("string")
    name = F.col("doc_id").cast("string")
    return documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", source, name)).when(F.col("doc_id") % 3 == 1, F.concat_ws("/", source, lang, name))
                            .when(F.col("doc_id") % 3 == 2, F.concat_ws("/", source, lang, hundred, name)).alias("path"), "text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(with_paths(table(spark, sf_dir, "documents")))


_NOTICES = ", ".join(f"('{licence}', '{notice}')" for licence, notice in TEMPLATES)
_WORDS = "'[a-z0-9]+(?:[.-][a-z0-9]+)*'"
_SIGNAL_SQL = "'" + SIGNAL + "'"
OP10_SQL = f"""
WITH files AS (
  SELECT doc_id, text, CASE doc_id % 3
    WHEN 0 THEN concat_ws('/', coalesce(source, 'none'), doc_id) WHEN 1 THEN concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), doc_id)
    WHEN 2 THEN concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), doc_id // 100, doc_id) END AS path FROM documents),
templates(licence, notice) AS (VALUES {_NOTICES}),
template_words AS (SELECT licence, word, count(*) AS tf FROM (SELECT licence, unnest(regexp_extract_all(lower(notice), {_WORDS})) AS word FROM templates) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {_WORDS})) AS word FROM files)) GROUP BY word),
total AS (SELECT count(*) AS n FROM files),
weights AS (SELECT licence, w.word, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + coalesce(df, 0))) + 1 AS idf, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + coalesce(df, 0))) + 1) AS weight
            FROM template_words w LEFT JOIN df USING (word), total),
squares AS (SELECT licence, sum(weight * weight) AS square FROM weights GROUP BY licence),
lines AS (SELECT doc_id, len(regexp_extract_all(lower(text), {_WORDS})) AS all_words, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files),
line_words AS (SELECT doc_id, all_words, line, word, count(*) AS tf FROM (
  SELECT doc_id, all_words, line, unnest(regexp_extract_all(lower(content), {_WORDS})) AS word FROM lines WHERE regexp_matches(content, {_SIGNAL_SQL})) GROUP BY ALL),
weighed AS (SELECT l.*, l.tf * coalesce(i.idf, ln((1.0::DOUBLE + n) / 2.0::DOUBLE) + 1) AS weight
            FROM line_words l LEFT JOIN (SELECT DISTINCT word, idf FROM weights) i USING (word), total),
lengths AS (SELECT doc_id, line, sum(weight * weight) AS own, sum(tf) AS words FROM weighed GROUP BY ALL),
scored AS (
  SELECT w.doc_id, w.all_words, w.line, t.licence, l.words, round(sum(w.weight * t.weight) / sqrt(l.own * s.square), 6) AS score
  FROM weighed w JOIN weights t USING (word) JOIN squares s USING (licence) JOIN lengths l ON l.doc_id = w.doc_id AND l.line = w.line
  GROUP BY w.doc_id, w.all_words, w.line, t.licence, l.words, l.own, s.square HAVING round(sum(w.weight * t.weight) / sqrt(l.own * s.square), 6) >= 0.6),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY score DESC, licence) = 1),
own AS (
  SELECT doc_id, arg_min(licence, (-score, licence)) AS own, max(score) AS own_score, sum(words) >= 0.1 * max(all_words) AS is_file FROM best GROUP BY doc_id),
placed AS (SELECT f.doc_id, f.path, o.*exclude(doc_id), regexp_replace(path, '/[^/]*$', '') AS folder FROM files f LEFT JOIN own o USING (doc_id)),
licensed AS (SELECT folder AS above, own AS licence, own_score AS score FROM placed WHERE is_file QUALIFY row_number() OVER (PARTITION BY folder ORDER BY own_score DESC, doc_id) = 1),
chains AS (SELECT folder, unnest([array_to_string(string_split(folder, '/')[1:len(string_split(folder, '/')) - k], '/') FOR k IN generate_series(0, len(string_split(folder, '/')) - 1)]) AS above,
                  unnest(generate_series(0, len(string_split(folder, '/')) - 1)) AS steps FROM (SELECT DISTINCT folder FROM placed)),
inherited AS (SELECT folder, steps, above, licence, score FROM chains JOIN licensed USING (above) QUALIFY row_number() OVER (PARTITION BY folder ORDER BY steps) = 1)
SELECT p.doc_id, p.path, coalesce(p.own, i.licence) AS licence, coalesce(p.own_score, i.score) AS score,
  CASE WHEN p.own IS NOT NULL THEN 'header' WHEN i.licence IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN p.own IS NULL THEN i.above END AS directory, CASE WHEN p.own IS NULL THEN i.steps END::INTEGER AS steps
FROM placed p LEFT JOIN inherited i USING (folder)
"""
