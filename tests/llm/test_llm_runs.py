"""Importance resampling, periodic runs and SimHash duplicates on odd documents, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import documents, texts, tuples

from wayfield.llm.periodic import every_tenth_periodic, find_runs, periodic_runs
from wayfield.llm.resampling import importance_resample
from wayfield.llm.simhash import compare, fingerprints, simhash_duplicates
from wayfield.llm.words import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# Periodic runs.

def plain_runs(w, least=24, times=3):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc, text, least=24, times=3):
    w = WORD.findall(text or "")
    runs = plain_runs(w, least, times)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    return (doc, len(w), len(runs), *best, 1000 * best[1] // best[2] if runs else None, runs,
            " ".join(x for i, x in enumerate(w) if i not in dropped))


PERIODIC = [(30, "a b c " * 20, "a"), (31, "x " * 5000, "a"), (32, "p q r s " * 6 + "p q z " + "one two three four five six seven eight nine " * 3, "b"),
            (33, ("u " * 30 + "v ") * 4, "b"), (34, "k l m n o " * 4, "c"), (35, "k l m n o " * 5, "c"), (36, "Ä ä " * 12 + "ä Ä " * 12, "c")]


def test_periodic_runs(spark):
    rows = [r for r in texts() if r[1] is None or len(r[1].split()) < 1000] + PERIODIC
    df = periodic_runs(documents(spark, rows))
    got = [(*r[:7], [tuple(x) for x in r[7]], r[8]) for r in map(tuple, df.collect())]
    assert sorted(got, key=repr) == sorted((plain_row(doc, text) for doc, text, _ in rows), key=repr)
    assert df.where("n_runs > 0").count() == 6


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 8)), max_size=5), min_size=1, max_size=4),
       st.sampled_from([(24, 3), (4, 3), (10, 4)]))
def test_runs_of_any_words(parts, limits):
    docs = ["".join(base * n for base, n in doc) for doc in parts]
    words = np.append(0, np.cumsum([len(d) for d in docs]))
    h = mix(np.frombuffer("".join(docs).encode(), np.uint8).astype(np.uint64) + np.uint64(1))
    found = [x.tolist() for x in find_runs(h, words, *limits)]
    assert list(zip(*found)) == [(i, *r) for i, d in enumerate(docs) for r in plain_runs(d, *limits)]


def test_runs_of_long_texts_take_little():
    # A word, and a line of 12 words, that fill a text of 300,000 words; neither makes pairs of all its occurrences.
    h = np.concatenate([np.full(300_000, 7, np.uint64), np.tile(mix(np.arange(12, dtype=np.uint64)), 25_000)])
    found = find_runs(h, np.array([0, 300_000, 600_000]))
    assert [x.tolist() for x in found] == [[0, 1], [0, 0], [300_000, 300_000], [1, 12]]
    with pytest.raises(ValueError):
        find_runs(h, np.array([0, 300_000]), times=2)


def test_one_text_in_ten_is_periodic():
    import pyarrow as pa
    ids = list(range(60)) + [None]
    place = every_tenth_periodic(pa.array(ids), np.arange(len(ids) + 1) * 50).reshape(-1, 50)
    for i, row in zip(ids, place):
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        want = list(range(50))
        if h % 10 == 0:
            a, g = h // 10 % 50, h // 10
            p = 1 + (50 - a) // (3 + g % 8)
            want = [j if j < a else a + (j - a) % p for j in range(50)]
        assert (row - row.min() + (0 if want[0] == 0 else want[0])).tolist() == want


# Importance resampling.

def plain_grams(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text)) if x]
    return len(w), [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]


def plain_resample(rows, target, percent=25, least_words=20, buckets=10_000, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [plain_grams(t) for _, t, _ in rows]
    s = Counter(bucket(f) for _, g in own for f in g)
    t = Counter(bucket(f) for text in target for f in plain_grams(text)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for (doc, _, _), (n, g) in zip(rows, own):
        weight = sum(gain[bucket(f)] for f in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = len(able) * percent // 100
    return [(*r, i + 1 if i < drawn else None) for i, r in enumerate(able)] + [(*r, None) for r in out if r[1] < least_words]


@pytest.mark.parametrize("percent, buckets", [(25, 10_000), (100, 70_000), (40, 7)])
def test_importance_resample(spark, percent, buckets):
    target = ["Aa bbb cc’s, d9!", "aa BBB\x00ddd", None, "", "λόγος 日本 😀 aa", "aa bbb " * 30]
    df = importance_resample(documents(spark), spark.createDataFrame([(t,) for t in target], "text string"), percent, buckets=buckets)
    got = tuples(df)
    want = sorted(plain_resample(texts(), target, percent, buckets=buckets), key=repr)
    # Rows that are equal in all that orders them may change places.
    bare = lambda rows: sorted((r[:-1] for r in rows), key=repr)
    assert bare(got) == bare(want)
    ranks = lambda rows: sorted((r[5], r[4], repr(r[0])) for r in rows if r[5])
    assert ranks(got) == ranks(want)


def test_resample_of_nothing(spark):
    none = documents(spark, [])
    assert importance_resample(none, none).count() == 0
    got = importance_resample(documents(spark), none, percent=100)
    assert got.where("n_words >= 20 AND rank IS NULL OR n_words < 20 AND rank IS NOT NULL").count() == 0
    assert periodic_runs(none).count() == 0 and simhash_duplicates(none).count() == 0


# SimHash.

def plain_fingerprint(text, n=4):
    w = WORD.findall(lowered(text))
    s = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_simhash(rows, n=4, radius=4):
    fp = [plain_fingerprint(t, n) for _, t, _ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min((doc for (doc, _, _), y in zip(rows, label) if y == x and doc is not None), default=None) for x in set(label)}
    return sorted(((doc, f - (f >> 63 << 64), least[x]) for (doc, _, _), f, x in zip(rows, fp, label)), key=repr)


@pytest.mark.parametrize("n, radius", [(4, 4), (2, 12), (1, 0)])
def test_simhash_duplicates(spark, n, radius):
    assert tuples(simhash_duplicates(documents(spark), n, radius)) == plain_simhash(texts(), n, radius)


def test_simhash_of_a_large_group_in_small_tiles(spark, monkeypatch):
    import wayfield.llm.simhash as simhash
    for name, value in (("TILE", 4), ("COLUMNS", 8), ("MOST_MEMBERS", 16), ("LANE", 16)):
        monkeypatch.setattr(simhash, name, value)
    r = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1:]), "a") for i in range(120)]
    rows += [(500 + i, " ".join(r.choice("abcdefghij") for _ in range(12)), "b") for i in range(60)] + [(900 + i % 7, "one " * 9, "c") for i in range(20)]
    got = tuples(simhash_duplicates(documents(spark, rows), 4, 6))
    assert got == plain_simhash(rows, 4, 6)
    assert len({c for _, _, c in got}) < len(rows) - 60


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(1, 6), st.integers(0, 8))
def test_units_find_all_pairs(seed, spread, radius):
    import wayfield.llm.simhash as simhash
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fp = np.unique(centres[rng.integers(0, 5, 90)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (90, spread), dtype=np.uint64), 1))
    fp = fp[np.argsort(np.bitwise_count(fp), kind="stable")]
    simhash.TILE, kept = 8, simhash.TILE
    try:
        one = compare(fp, np.zeros(len(fp), np.int64), 0, 0, radius)
        half = len(fp) // 2
        two = compare(fp, (np.arange(len(fp)) >= half).astype(np.int64), 0, 1, radius)
    finally:
        simhash.TILE = kept

    def plain(pairs):
        label = np.arange(len(fp))
        for a, b in pairs:
            if (int(fp[a]) ^ int(fp[b])).bit_count() <= radius:
                label[label == max(label[a], label[b])] = min(label[a], label[b])
        return label

    assert one.tolist() == plain([(a, b) for a in range(len(fp)) for b in range(a)]).tolist()
    assert two.tolist() == plain([(a, b) for a in range(half) for b in range(half, len(fp))]).tolist()


def test_fingerprint_bits_of_many_hashes():
    rng = np.random.default_rng(1)
    count = np.array([0, 1, 2, 70_000, 3, 0, 33_000])
    h = rng.integers(0, 1 << 64, count.sum(), dtype=np.uint64)
    want, at = [], 0
    for n in count:
        bits = np.unpackbits(h[at:at + n].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
        want.append(int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0]) if n else 0)
        at += n
    assert fingerprints(h, count).tolist() == want
