"""Token ids, files, packing, media and vectors on odd input, against plain versions."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import documents, texts, tuples
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfield.llm import jpeg, media
from wayfield.llm.id_files import decode_ranks, encode_ranks, read_id_files, write_id_files
from wayfield.llm.mtree import Tree, top_k
from wayfield.llm.packing import pack_documents, places, shortest_pack_first
from wayfield.llm.tokens import encoder
from wayfield.sources.scratch import Scratch

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library_ids(path, values):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch([v or "" for v in values], add_special_tokens=False)]


def ours(path, values):
    raw = [v.encode() for v in values]
    ids, before = encoder(path).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
    return [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:])]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZbé’'st.,! \n\t\r \u0085　İßﬁ日9_<|>endof́"), max_size=40), min_size=1, max_size=4))
def test_stretches_give_the_ids_of_whole_texts(path, values):
    assert ours(path, values) == library_ids(path, values)


@given(st.lists(st.integers(0, 2 ** 32 - 1), max_size=50))
def test_ranks_round_trip(values):
    ranks = np.array(values, np.uint32)
    assert decode_ranks(*encode_ranks(ranks), len(ranks)).tolist() == values


def test_id_files(spark):
    scratch = Scratch(spark, "test-ids")
    files, ranks = write_id_files(documents(spark), BYTES, 0, scratch)
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in read_id_files(files, ranks, scratch).orderBy("start").collect()]
    rows = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at, want = 0, []
    for (doc, _, _), ids in zip(rows, library_ids(BYTES, [t for _, t, _ in rows])):
        want.append((doc, at, len(ids) + 1, zlib.crc32(np.array(ids + [0], "<u4").tobytes())))
        at += len(ids) + 1
    assert got == want
    files, ranks = write_id_files(documents(spark, []), BYTES, 0, Scratch(spark, "test-none"))
    assert read_id_files(files, ranks, scratch).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1))
@settings(max_examples=100, deadline=None)
def test_packs_hold_every_piece_once(histogram):
    packs = shortest_pack_first(histogram, 64)
    seen = defaultdict(int)
    for count, chain in packs:
        assert sum(n * c for n, c in chain) <= 64
        for n, c in chain:
            seen[n] += c * count
    assert dict(seen) == histogram
    rows = places(packs)
    assert sum(rows[:, 2]) == sum(histogram.values())


def test_packing(spark):
    rows = pack_documents(documents(spark), WORDS, limit=256).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(r["ids"], "<u2").tolist(), r["ids_crc32"]))
    want = defaultdict(list)
    for (doc, _, _), ids in zip(texts(), library_ids(WORDS, [t for _, t, _ in texts()])):
        for at in range(0, len(ids) + 1, 256):
            want[doc, len(ids) + 1].append((at, (ids + [2])[at:at + 256]))
    for key, found in pieces.items():
        assert sorted((a, b) for a, b, _ in found) == sorted(want[key])
        assert all(zlib.crc32(np.array(b, "<u4").tobytes()) == c for _, b, c in found)
    assert pieces.keys() == want.keys()
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 256
    assert sorted(sequences) == list(range(len(sequences)))
    assert pack_documents(documents(spark, []), WORDS).count() == 0


def plain_feature(content):
    """From the file alone: coefficients, each block's inverse transform as a double sum, nearest chroma, colours."""
    (image,), coefficients = jpeg.decode([content])
    x = np.arange(8)
    wave = np.array([[np.cos((2 * p + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for u in range(8)] for p in x])
    full = []
    for c in range(3):
        rows, columns = image.grid(c)
        plane = np.zeros((rows * 8, columns * 8))
        for i in range(rows * columns):
            block = np.zeros(64)
            block[jpeg.zigzag()] = coefficients[image.first_block[c] + i] * image.quant[c]
            r, k = divmod(i, columns)
            plane[r * 8:r * 8 + 8, k * 8:k * 8 + 8] = wave @ block.reshape(8, 8) @ wave.T
        full.append(plane if c == 0 else plane.repeat(2, 0).repeat(2, 1))
    y, b, r = (p[:image.height, :image.width] for p in full)
    y = y + 128.501
    colours = [np.clip(v, 0, 255).astype(np.uint8) for v in (y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b)]
    return image, colours


def test_media(spark):
    rows = [r for r in texts() if r[1] is None or len(r[1]) < 5000]
    stored = media.stored_payloads(documents(spark, rows))
    files = defaultdict(set)
    for r in stored.collect():
        files[r["doc_id"]].add(bytes(r["media"]))
    got = media.media_features(documents(spark, rows), passes=3).collect()
    assert len(got) == len(rows)
    found = defaultdict(set)
    for r in got:
        found[r["doc_id"]].add(tuple(r)[1:])
    for doc, text, _ in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        facts = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        (row,) = {r for r in found[doc] if r[:4] == facts}
        (content,) = {f for f in files[doc] if (len(f), hashlib.sha256(f).hexdigest()) == row[4:6]}
        image, colours = plain_feature(content)
        size, *parts = row[6].split()
        assert size == f"{image.width}x{image.height}" and len(parts) == 3
        for part, colour in zip(parts, colours):
            mean, low, high = map(int, part.split(","))
            assert abs(mean - colour.mean() * 1000) <= 40 and abs(low - int(colour.min())) <= 1 and abs(high - int(colour.max())) <= 1
    # Equal texts have equal values, whatever their rows.
    same = defaultdict(set)
    for r in got:
        same[r["payload_sha256"], r["n_bytes"]].add(tuple(r)[1:])
    assert all(len(v) == 1 for v in same.values())
    assert media.media_features(documents(spark, [])).count() == 0
    tensors = media.rgb_tensors(stored.where("doc_id = 11").unionByName(stored.where("doc_id = 12").withColumn("media", F.lit(b"no image"))))
    assert {r["doc_id"]: (r["height"], r["width"], r["rgb"] and len(r["rgb"])) for r in tensors.collect()} == {11: (16, 16, 768), 12: (None, None, None)}


@pytest.mark.parametrize("restart", [1, 4, 1000])
def test_coefficients_round_trip(monkeypatch, restart):
    monkeypatch.setattr(jpeg, "RESTART", restart)
    r = np.random.default_rng(7)
    counts = np.array([1, 5, 6, 7, 40])
    blocks = np.where(r.random((counts.sum(), 64)) < r.random((counts.sum(), 1)), r.integers(-127, 129, (counts.sum(), 64)), 0)
    images, found = jpeg.decode(jpeg.encode(blocks, counts, [b""] * len(counts)))
    at = 0
    for image, n in zip(images, counts):
        order, _ = image.order([0, 1, 2])
        assert (found[order[:n]] == blocks[at:at + n]).all() and not found[order[n:]].any()
        at += n


def test_pixels_are_the_inverse_transform():
    blocks = np.zeros((6, 64), np.int64)
    blocks[:4, 0], blocks[0, 1], blocks[4, 0], blocks[5, 0] = 80, 40, 16, -24
    (image,), found = jpeg.decode(jpeg.encode(blocks, np.array([6]), [b""]))
    x = np.arange(8)
    y = np.full((16, 16), 10.0)
    y[:8, :8] += 40 / 8 * np.sqrt(2) * np.cos((2 * x + 1) * np.pi / 16)[None, :]
    cb, cr = 2.0, -3.0
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2) + 128
    assert np.abs(jpeg.rgb(image, found) - want).max() <= 0.51


def test_parse_refuses_other_files():
    for content in (b"", b"text", b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00"):
        with pytest.raises(ValueError):
            jpeg.parse(content)


VECTORS = ([(i, [float(np.sin(i * j + j)) for j in range(1, 7)]) for i in range(120)] + [(500 + i, [0.5] * 6) for i in range(60)]
           + [(200, None), (201, []), (202, [1.0, None]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (None, [1.0] * 6), (205, [2.0, 1.0]), (20, [0.1] * 6), (40, [0.1] * 6)])


def test_top_k(spark, monkeypatch):
    import wayfield.llm.mtree as mtree
    monkeypatch.setattr(mtree, "TREE", 40), monkeypatch.setattr(mtree, "PAGE", 8), monkeypatch.setattr(mtree, "PIVOTS", 5), monkeypatch.setattr(mtree, "BLOCK", 4)
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("tree", F.lit(1))
    got = tuples(top_k(rows, lambda v: v % 20 == 0, 7), "query_id", "rank", "vec_id", "score")
    fine = [(i, np.pad(np.floor(64 * np.array(v, np.float32).astype(float)), (0, 6 - len(v)))) for i, v in VECTORS
            if i is not None and v and None not in v and np.isfinite(v).all()]
    want = defaultdict(list)
    for q, x in fine:
        if q % 20 == 0:
            want[q] += [(-int(x @ y), i) for i, y in fine if i != q]
    # A repeated id asks twice; its answers are those of both vectors together.
    once = {q for q in want if sum(i == q for i, _ in fine) == 1}
    plain = sorted(((q, n + 1, i, -s) for q in once for n, (s, i) in enumerate(sorted(want[q])[:7])), key=repr)
    assert [g for g in got if g[0] in once] == plain
    assert top_k(rows.limit(0), lambda v: v % 20 == 0).count() == 0
    assert top_k(rows.where("vec_id < 3"), lambda v: v == 0).count() == 2


def test_tree_avoids_computations():
    r = np.random.default_rng(2)
    centres = r.integers(-60, 60, (30, 8))
    vectors = (centres[r.integers(0, 30, 2000)] + r.integers(-3, 4, (2000, 8))).astype(float)
    most = float((vectors ** 2).sum(1).max())
    tree = Tree.from_bytes(Tree(np.arange(2000), vectors, most).to_bytes())
    for q in range(0, 2000, 97):
        ids, scores = tree.search(vectors[q], q, 10, -np.inf)
        all_ = vectors @ vectors[q]
        want = [i for i in np.lexsort((np.arange(2000), -all_)) if i != q][:10]
        assert ids.tolist() == want and scores.tolist() == all_[want].tolist()
