"""Near duplicates, repeated passages, mixing and quality on odd documents, against plain versions."""

import re
from collections import defaultdict

import numpy as np
import pytest
from odd import documents, texts, tuples
from pyspark.sql import functions as F

from wayfield.llm.mixing import first_words, mix_sources, mixed_documents
from wayfield.llm.neardup import CHUNKS_OF, SYMBOLS, chunk_for, chunk_keys, distance, near_duplicates
from wayfield.llm.quality import grow, learn_quality, score_quality
from wayfield.llm.suffixes import repeated_passages, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text, n):
    w = WORD.findall(lowered(text))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain_components(rows, n, least, whole):
    sets = [shingles(t, n) for _, t, _ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and whole * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = defaultdict(list)
    for (doc, _, _), x in zip(rows, label):
        ids[x] += [doc] if doc is not None else []
    return sorted(((doc, len(s), c := min(ids[x]) if ids[x] else None, doc == c) for (doc, _, _), x, s in zip(rows, label, sets)), key=repr)


@pytest.mark.parametrize("n, similarity", [(3, (85, 100)), (5, (80, 100)), (2, (70, 100)), (2, (50, 100))])
def test_near_duplicates(spark, n, similarity):
    got = tuples(near_duplicates(documents(spark), n, similarity), "doc_id", "n_shingles", "component_id", "kept")
    assert got == plain_components(texts(), n, *similarity)


@pytest.mark.parametrize("chunk", CHUNKS_OF)
def test_signatures_at_the_distance_meet(chunk):
    r = np.random.default_rng(3)
    for _ in range(300):
        pair = np.repeat(r.integers(0, 1 << 16, (1, SYMBOLS), dtype=np.uint16), 2, 0)
        pair[1, r.choice(SYMBOLS, distance(chunk), replace=False)] ^= 1
        a, b = chunk_keys(pair, chunk)
        assert (a == b).any()
    pair[1] = pair[0]
    pair[1, [c * chunk + j for c in range(SYMBOLS // chunk) for j in (0, 1)]] ^= 1
    a, b = chunk_keys(pair, chunk)
    assert not (a == b).any()


def test_chunks_follow_the_similarity():
    assert [chunk_for((s, 100)) for s in (99, 85, 80, 70, 60, 50, 30)] == [4, 4, 4, 3, 2, 2, 2]
    with pytest.raises(ValueError):
        chunk_for((10, 100))


def test_links_at_low_similarities_are_found(spark):
    """Pairs just at the similarity: sets of 120 shingles that share what 0.5 and 0.7 of the union are."""
    for least in (50, 70):
        common = -(-240 * least // (100 + least))
        rows = [(2 * i + j, " ".join([f"{i}c{n}" for n in range(common)] + [f"{i}{j}o{n}" for n in range(120 - common)]), "a") for i in range(150) for j in (0, 1)]
        got = near_duplicates(documents(spark, rows), 1, (least, 100))
        assert got.where("component_id = doc_id - doc_id % 2").count() == 300


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    import wayfield.llm.neardup as neardup
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:i % 40] + [f"x{i}"] + base[i % 40:]), "a") for i in range(60)] + [(100 + i, f"alone {i} a b c", "b") for i in range(5)]
    got = tuples(near_duplicates(documents(spark, rows), 3, (85, 100)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == plain_components(rows, 3, 85, 100)


def plain_stretches(rows, least=50):
    where = defaultdict(set)
    for doc, text, _ in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - least + 1):
            if doc is not None:
                where[tuple(w[i:i + least])].add((doc, i))
    return [(doc, i, min(d for d, _ in s)) for s in where.values() if len({d for d, _ in s}) > 1 for doc, i in s]


def plain_spans(rows, least=50):
    out = []
    by = defaultdict(list)
    for doc, i, first in set(plain_stretches(rows, least)):
        by[doc, first != doc].append((i, first))
    for (doc, removed), found in by.items():
        start, end, low = None, -1, None
        for i, first in sorted(found):
            if start is None or i > end:
                if start is not None:
                    out.append((doc, start, end, low, removed))
                start, low = i, first
            end, low = i + least, min(low, first)
        out.append((doc, start, end, low, removed))
    return sorted(out, key=repr)


def passages():
    rows = [r for r in texts() if r[0] not in (16, 1, 2, 3)] + [r for r in texts()[:3]] + [(16, texts()[15][1], "a")]
    shared = " ".join(f"p{i}" for i in range(55))
    return rows + [(200 + i, f"start{i} {shared} end{i % 3} {' '.join(f'q{j}' for j in range(i, i + 60))}", "a") for i in range(40)]


def test_repeated_passages(spark):
    rows = passages()
    got = tuples(repeated_passages(documents(spark, rows)), "doc_id", "start_word", "end_word", "first_doc", "removed")
    assert got == plain_spans(rows) and len(got) > 60


def test_cutting_leaves_one_copy_of_each_word(spark):
    rows = passages()
    got = dict(tuples(without_repeats(documents(spark, rows)).where("doc_id IS NOT NULL"), "doc_id", "text"))
    removed = defaultdict(set)
    for doc, i, first in plain_stretches(rows):
        if first != doc:
            removed[doc] |= set(range(i, i + 50))
    for doc, text, _ in rows:
        if doc is not None:
            assert WORD.findall(got[doc] or "") == [w for i, w in enumerate(WORD.findall(text or "")) if i not in removed[doc]]
    kept = " ".join(WORD.findall(" ".join(t or "" for t in got.values())))
    assert " ".join(f"p{i}" for i in range(55)) in kept
    # Other columns, also those with names that the operator uses itself, are as they were.
    assert without_repeats(documents(spark, rows)).columns == documents(spark, rows).columns


def test_one_passage_in_every_partition(spark):
    shared = " ".join(f"p{i}" for i in range(50))
    rows = [(i, shared, "a") for i in range(300)]
    got = tuples(repeated_passages(documents(spark, rows)), "doc_id", "start_word", "end_word", "first_doc", "removed")
    assert got == plain_spans(rows)


def plain_mix(rows):
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, sizes):
        total[s] += n
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes)
    while True:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not above:
            return total, target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * total[s] for s in above}
        left -= sum(2.0 * total[s] for s in above)
        open_ -= above


def test_mix(spark):
    rows = texts()
    total, target = plain_mix(rows)
    got = mix_sources(documents(spark)).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert {s: int(t + 1e-6) for s, t in target.items()} == dict(taken)
    assert tuples(mix_sources(documents(spark))) == sorted(map(tuple, got), key=repr)


def test_mixed_documents_have_the_words_taken(spark):
    rows = [r for r in {r[0]: r for r in texts() if r[0] is not None}.values()]
    docs = documents(spark, rows)
    taken = {r["doc_id"]: r["taken"] for r in mix_sources(docs).collect()}
    words = defaultdict(list)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        words[r["doc_id"]].append(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    for doc, text, _ in rows:
        own = WORD.findall(text or "")
        assert sum(map(len, words[doc])) == taken[doc] and all(w == own[:len(w)] for w in words[doc])


def test_first_words(spark):
    df = spark.createDataFrame([("  a b\n c  d ", 1), ("a", 1), ("a b c", 2), ("a b", 0)], "t string, n int")
    assert [r[0].split() for r in df.select(first_words(F.col("t"), F.col("n"))).collect()] == [["a"], ["a"], ["a", "b"], []]


def test_quality_learns_and_scores_odd_documents(spark):
    good = [(i, " ".join(["plain", "words", "here", "and", "there"] * (3 + i % 5)), "a") for i in range(0, 120)]
    bad = [(i, " | ".join(["$$$", "##", "x%%"] * (3 + i % 5)), "a") for i in range(120, 240)]
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(None, 1, 0), (5, None, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark, good + bad + texts()[7:10])
    trees = learn_quality(docs, labels)
    scored = {r["doc_id"]: r["__score"] for r in score_quality(docs, trees, "__score").collect()}
    assert all(scored[i] > 0.7 for i, _, _ in good if i not in (8, 9, 10)) and all(scored[i] < 0.3 for i, _, _ in bad)
    assert all(0 <= s <= 1 for s in scored.values())
    none = learn_quality(docs, labels.limit(0))
    assert {r["__score"] for r in score_quality(docs, none, "__score").collect()} == {0.5}


def test_one_kind_of_label_gives_its_share():
    assert grow(np.zeros((5, 24)), np.ones(5)).scores(np.zeros((1, 24)))[0] == pytest.approx(1, abs=1e-5)


def test_trees_walk_like_their_definition():
    r = np.random.default_rng(1)
    rows = r.normal(size=(600, 4))
    label = ((rows[:, 0] > 0) ^ (rows[:, 2] > 0.5)).astype(float)
    trees = grow(rows, label)
    for row in rows[:20]:
        margin = trees.base
        for feature, edge, leaf in zip(trees.feature, trees.edge, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > edge[node])
            margin += leaf[node - len(feature)]
        assert trees.scores(row[None])[0] == pytest.approx(1 / (1 + np.exp(-margin)))
    fresh = r.normal(size=(400, 4))
    assert ((trees.scores(fresh) > 0.5) == ((fresh[:, 0] > 0) ^ (fresh[:, 2] > 0.5))).mean() > 0.95


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert near_duplicates(docs).count() == repeated_passages(docs).count() == without_repeats(docs).count() == mix_sources(docs).count() == 0
    assert mixed_documents(docs).count() == 0
