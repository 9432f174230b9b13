"""Preference pairs, licences, the pipeline, and every query with its SQL at the smallest scale."""

from collections import defaultdict

import pytest
from odd import documents, texts, tuples
from oracle_check import compare, duck
from pyspark.sql import functions as F
from test_llm_text import WORD, plain_components, plain_mix

import __spark_entry__ as entry
import corpus_pipeline
from wayfield.llm.licenses import license_scan, licence_texts
from wayfield.llm.preferences import format_preferences, gathered, paired_by_opening
from wayfield.llm.queries import ORACLE, QUERIES
from wayfield.sources.scratch import Scratch

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_against_sql(spark, name):
    ok, note = compare(spark, duck(SF_DIR), SF_DIR, name)
    assert ok, note


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= entry.queries().keys() and sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_quality_on_held_out_rows(spark):
    scored = QUERIES["op2_quality_trees"](spark, "/root/testdata/sf0.01").where("held_out")
    rows = scored.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert rows[0] > 0.95 and rows[1] > 50


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 1, "assistant", "hey"), (2, 2, "user", "bye"), (3, 0, None, None),
         (3, 1, "assistant", None), (4, 0, "user", "no answer"), (None, 0, "user", "lost"), (5, None, "user", "z"), (5, 0, "assistant", "a"), (5, 0, "assistant", "a")]


def test_preferences(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("chosen", F.lit("x"))
    rows = {r["conv_id"]: r for r in format_preferences(paired_by_opening(turns, Scratch(spark, "test-pairs"))).collect()}
    assert rows.keys() == {1, 2, 3, 5}
    one = next(rows[i] for i in (1, 2) if {rows[i]["other"], i} == {1, 2}) if rows[1]["other"] == 2 else rows[1]
    assert one["prompt"].startswith("<|user|>\nhi<|end|>\n")
    parts = [(p["text"], p["loss"]) for p in rows[1]["chosen"]]
    assert parts == [("<|assistant|>\n", False), ("hello<|end|>\n", True)] and rows[1]["prefix_turns"] == 1
    assert paired_by_opening(turns.limit(0), Scratch(spark, "test-none")).count() == 0


def test_odd_number_of_conversations(spark):
    for n in (1, 3, 5):
        turns = spark.createDataFrame([(c, t, r, f"{r} {c}") for c in range(n) for t, r in enumerate(["user", "assistant"])], "conv_id long, turn long, role string, text string")
        rows = {r["conv_id"]: r for r in paired_by_opening(turns, Scratch(spark, "test-odd")).collect()}
        assert rows.keys() == (set(range(n)) if n > 1 else set())
        alone = [c for c, r in rows.items() if rows[r["other"]]["other"] != c]
        assert len(alone) == (1 if n > 1 else 0)
        assert all(r["other"] != c and r["rejected"][1]["text"] == f"assistant {r['other']}" for c, r in rows.items())


def test_equal_conversations_are_all_prompt(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    same = gathered(turns).select("conv_id", F.col("turns").alias("chosen"), F.col("turns").alias("rejected"))
    for r in format_preferences(same).collect():
        assert r["chosen"] == r["rejected"] == [] and r["prefix_turns"] == r["prompt"].count("<|end|>")


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [(1, "a/LICENSE", mit), (2, "a/b/c/x", "nothing here"), (3, "a/b/y", f"code\n{gpl}\n" + "and much more of it " * 40), (4, "d/z", "nothing"), (5, None, mit),
             (6, "top", None), (7, "a/b/c/w", ""), (8, "a/b/c/e/LICENSE", gpl), (9, "a/b/c/e/f/v", "text"), (8, "a/b/c/e/LICENSE", gpl), (10, "d/q", "a licence of another kind")]
    docs = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("score", F.lit(1)).withColumn("row", F.lit(1))
    got = tuples(license_scan(docs), "doc_id", "licence", "origin", "directory", "steps")
    assert got == sorted([(1, "MIT", "header", None, None), (2, "MIT", "inherited", "a", 2), (3, "GPL-3.0", "header", None, None), (4, None, None, None, None),
                          (5, "MIT", "header", None, None), (6, None, None, None, None), (7, "MIT", "inherited", "a", 2), (8, "GPL-3.0", "header", None, None),
                          (8, "GPL-3.0", "header", None, None), (9, "GPL-3.0", "inherited", "a/b/c/e", 1), (10, None, None, None, None)], key=repr)
    assert license_scan(docs.limit(0)).count() == 0


WRAPPED = {
    "Apache-2.0": """# Copyright 2021 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
""", "GPL-2.0": """/* This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version.
 */
""", "MPL-2.0": """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""}


def test_licence_files_and_wrapped_headers(spark):
    code = "\n" + "\n".join(f"value_{i} = compute(first_{i}, second_{i})" for i in range(60))
    files, wanted = [(0, "none/x", "a licence is what we lack, and copyright too" + code)], {0: None}
    for licence, text in licence_texts():
        # A file of the licence as it is given out, and one below it that says nothing.
        n, whole = len(files), f"Copyright (c) 2020 Some Body\n\n{text}"
        files += [(n, f"{licence}/{n}", whole), (n + 1, f"{licence}/src/main", code)]
        wanted |= {n: licence, n + 1: licence}
    headers = len(files)
    for licence, header in WRAPPED.items():
        wanted[len(files)] = licence
        files.append((len(files), f"headers/{len(files)}", header + code))
    for tag, licence in [("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0-or-later", "GPL-2.0"), ("(MIT OR Apache-2.0)", "Apache-2.0"), ("LicenseRef-Own", None)]:
        wanted[len(files)] = licence
        files.append((len(files), f"tags/{len(files)}", f"// SPDX-License-Identifier: {tag}" + code))
    # No header of a single file holds for others; a file that is named as a licence does.
    named = len(files)
    files += [(named, "headers/other", code), (named + 1, "named/LICENSE", "SPDX-License-Identifier: MIT" + code), (named + 2, "named/a/b", code)]
    wanted |= {named: None, named + 1: "MIT", named + 2: "MIT"}
    rows = license_scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()
    assert {r["doc_id"]: r["licence"] for r in rows} == wanted
    assert all(r["origin"] == "inherited" and r["steps"] == 1 for r in rows if 0 < r["doc_id"] < headers and r["doc_id"] % 2 == 0)


def test_stages_on_odd_documents(spark, tmp_path):
    docs = documents(spark)
    columns = docs.columns
    good = corpus_pipeline.good_documents(spark, docs, SF_DIR)
    assert good.columns == columns
    apart = corpus_pipeline.distinct_documents(spark, docs, SF_DIR)
    # Each row is a document of its own, also without an id or with another's.
    own = [(i, text, source) for i, (_, text, source) in enumerate(texts())]
    component = {i: c for i, _, c, _ in plain_components(own, 5, 80, 100)}
    assert apart.columns == columns
    apart.write.parquet(str(tmp_path / "apart"))
    apart = spark.read.parquet(str(tmp_path / "apart"))
    kept = apart.collect()
    assert len({r["doc_id"] for r in kept} - {None}) == len(kept) == len(set(component.values()))
    named = {text: component[i] for i, text, _ in own if WORD.search(text or "")}
    assert {named[r["text"]] for r in kept if r["text"] in named} == set(named.values())
    before = {r["doc_id"]: r for r in apart.collect()}
    single = corpus_pipeline.unrepeated_documents(spark, apart, SF_DIR)
    assert single.columns == columns
    after = {r["doc_id"]: r for r in single.collect()}
    assert all(d in after for d, r in before.items() if len(WORD.findall(r["text"] or "")) < 50)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after.values())
    mixed = corpus_pipeline.mixed(spark, apart, SF_DIR)
    assert mixed.columns == columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
    _, target = plain_mix([(d, r["text"], r["source"]) for d, r in before.items()])
    assert {s: int(t + 1e-6) for s, t in target.items() if int(t)} == dict(words)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), SF_DIR).count() == 0, name


def through(spark, folder, docs, stages, sf_dir=SF_DIR):
    for name, stage in corpus_pipeline.STAGES[:stages]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def test_rows_without_an_id_of_their_own_stay(spark, tmp_path):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good = corpus_pipeline.good_documents(spark, given, SF_DIR)
    texts_apart = [r["text"] for r in corpus_pipeline.distinct_documents(spark, good, SF_DIR).select("text").orderBy("doc_id").limit(12).collect()]
    # Ids: null, repeated, and the own ones; the first text stands twice under a repeated id.
    ids = [None, None, None, 7, 7, 7, 7, 8, 8, 9, 10, 11]
    rows = [*zip(ids, texts_apart, ["a"] * 12), (None, texts_apart[0], "a"), (7, texts_apart[3], "a")]
    got = through(spark, tmp_path, documents(spark, rows), 2).collect()
    assert sorted(r["text"] for r in got) == sorted(texts_apart)
    kept = [r["doc_id"] for r in got]
    assert None not in kept and len(set(kept)) == 12 and {8, 9, 10, 11} <= set(kept) and all(i in ids or i > 11 for i in kept)
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] in (9, 10, 11)} == dict(zip(ids[9:], texts_apart[9:]))
    packed = corpus_pipeline.packed(spark, corpus_pipeline.unrepeated_documents(spark, spark.read.parquet(f"{tmp_path}/near_duplicates"), SF_DIR), SF_DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept)


def test_all_documents_are_good_without_labels(spark, tmp_path):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, left in [("none", labels.limit(0)), ("strange", labels.withColumn("doc_id", -F.col("doc_id") - 1)), ("bad", labels.withColumn("quality", F.col("quality") * 0))]:
        left.write.parquet(str(tmp_path / name / "labels.parquet"))
        good = corpus_pipeline.good_documents(spark, docs, str(tmp_path / name))
        # Labels that call everything bad are evidence.
        assert good.columns == docs.columns and good.count() == (0 if name == "bad" else docs.count())


def test_pipeline(spark):
    packed = corpus_pipeline.run(spark, SF_DIR)
    rows = packed.select("doc_id", "sequence_id", "offset", "length").collect()
    assert rows and all(r["offset"] + r["length"] <= 4096 for r in rows)
