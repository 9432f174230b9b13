"""Near duplicates by MinHash signatures and a multi-index Hamming join.

1. A document's set holds its distinct shingles. Documents with equal sets form a class and go on as one.
2. A class has a signature of 48 MinHash symbols of 16 bits. The Hamming distance of two signatures is the
   number of symbols that differ. Signatures are split into chunks; by the pigeonhole principle two signatures that
   differ in less than two symbols a chunk agree in some chunk but for one symbol at most. So each chunk is entered
   under each of its symbols left out, and every pair up to that distance meets under some key. Chunks have as
   many symbols as the similarity allows: a linked pair is beyond the distance with a probability of at most
   ``MISS``. (12 chunks of 4 and a distance of 23 at 0.85 and 0.80, where the probabilities are 1.3e-8 and 3.3e-6;
   chunks of 3 at 0.7, of 2 at 0.6 and 0.5. What would need still shorter ones is refused.)
3. Keys shared by several classes are buckets. A bucket is cut into blocks, and each pair of blocks is a
   unit of work of bounded size, however large the bucket is. A unit returns each member with the smallest
   one that it is connected with over such pairs: fewer rows than members, never all pairs.
4. The connected components of these are clusters: any linked pair lies within one. Clusters are cut into
   pairs of blocks in the same way, full sets are compared exactly, and the same is returned.
5. The components of the exact links are the result.

Cases: null, empty and blank texts have the empty set and are linked with nothing; a text with fewer words
than a shingle has its word sequence as its only shingle; rows that repeat a doc_id are judged each by its
own text; a null doc_id is never the smallest id of a component that has others; an empty table gives an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm.shared import binary, components, packed, run_starts, runs, slices, table, text_bytes
from wayfield.llm.words import mix, shingle_sets
from wayfield.sources.scratch import Scratch

SYMBOLS, ERRORS = 48, 1
# Symbols of a chunk, and the probability with which a linked pair may have signatures beyond the distance.
CHUNKS_OF, MISS = (4, 3, 2), 1e-5
# Members of a block; a unit of work compares two blocks.
BLOCK = 256

_random = np.random.default_rng(48)
_XOR = _random.integers(0, 2 ** 63, SYMBOLS, dtype=np.uint64)
_TIMES = _random.integers(0, 2 ** 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distance(chunk: int) -> int:
    """Every pair of signatures up to this distance is found."""
    return SYMBOLS // chunk * (ERRORS + 1) - 1


def chunk_for(similarity: tuple[int, int]) -> int:
    """Symbols of a chunk with which a pair of this similarity is found, but for a probability of ``MISS``."""
    differ = 1 - similarity[0] / similarity[1]
    for chunk in CHUNKS_OF:
        beyond = sum(comb(SYMBOLS, n) * differ ** n * (1 - differ) ** (SYMBOLS - n) for n in range(distance(chunk) + 1, SYMBOLS + 1))
        if beyond <= MISS:
            return chunk
    raise ValueError(f"{SYMBOLS} symbols do not find pairs of a similarity of {similarity[0] / similarity[1]}")


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of symbols per non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat((flat ^ _XOR[k]) * _TIMES[k], starts)
        out[:, k] = mix(least) >> np.uint64(48)
    return out


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, signature``; ``h1, h2`` stand for the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(*text_bytes(batch.column("text")), words)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            h = np.zeros((2, len(n)), np.uint64)
            symbols = np.zeros((len(n), SYMBOLS), np.uint16)
            if len(full):
                own = [sets[i] for i in full]
                flat, starts = np.concatenate(own), np.cumsum(n[full]) - n[full]
                h[0, full], h[1, full] = np.add.reduceat(mix(flat), starts), np.bitwise_xor.reduceat(mix(flat + np.uint64(1)), starts)
                symbols[full] = signatures(own)
            bounds = np.concatenate([[0], np.cumsum(np.where(n > 0, SYMBOLS * 2, 0))])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)),
                binary(symbols[full].view(np.uint8).ravel(), bounds)], ["doc_id", "n_shingles", "h1", "h2", "signature"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, signature binary")


def chunk_keys(symbols: np.ndarray, chunk: int) -> np.ndarray:
    """The keys of each signature: number of the chunk and of the symbol left out, and the other symbols."""
    chunks = symbols.reshape(len(symbols), -1, chunk).astype(np.int64)
    out = np.empty(chunks.shape, np.int64)
    for left_out in range(chunk):
        key = np.arange(chunks.shape[1]) * chunk + left_out
        for j in range(chunk):
            if j != left_out:
                key = key << 16 | chunks[:, :, j]
        out[:, :, left_out] = key
    return out.reshape(len(symbols), -1)


def keyed(classes: DataFrame, chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = chunk_keys(text_bytes(batch.column("signature"))[0].view(np.uint16).reshape(-1, SYMBOLS), chunk)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("rep").take(pa.array(np.repeat(np.arange(len(keys)), keys.shape[1])))],
                                             ["key", "rep"])

    return classes.select("rep", "signature").mapInArrow(run, "key long, rep long")


def block_pairs(members: DataFrame, group: str, size: str) -> DataFrame:
    """Deal the members of each group (``size`` of them) into pairs of blocks: adds ``block, lo, hi``.

    A group of one block is one pair. With more, a member stands once in each pair that its block is part of.
    """
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    out = members.withColumn("_n", blocks).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("_n")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    out = out.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other")).drop("_n", "_other", size)
    # The number is stated, as the work per row is large and its bytes tell little about it.
    parts = 2 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(parts, group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", "rep")


class Forest:
    """Which members of one table are connected."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def _root(self, i: int) -> int:
        while self.label[i] != i:
            self.label[i] = self.label[self.label[i]]
            i = self.label[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self._root(x), self._root(y)
            if p != q:
                self.label[max(p, q)] = min(p, q)
        if len(a):
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def edges(self, rep: np.ndarray) -> pa.RecordBatch:
        """Each member with the smallest one that it is connected with: the same pairs, wherever the same members meet."""
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, rep)
        other = least[self.label]
        own = np.flatnonzero(other != rep)
        return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(other[own])], ["a", "b"])


def lags(end: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: np.ndarray, forest: Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group that are not connected yet, by their distance in the table; ``end`` is each row's group's end."""
    active, lag = np.arange(len(end)), 1
    while len(active := active[active + lag < end[active]]):
        a, b = active, active + lag
        open_ = (forest.label[a] != forest.label[b]) & ((lo[a] == hi[a]) | (block[a] != block[b]))
        if open_.any():
            yield a[open_], b[open_]
        lag += 1


def close_pairs(chunk: int):
    """Of each pair of blocks, what is connected by pairs at the signature distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["key", "lo", "hi"]
        for data in runs(batches, keys):
            data = data.combine_chunks()
            starts = run_starts(data, keys)
            symbols = text_bytes(data.column("signature").chunk(0))[0].view(np.uint16).reshape(-1, SYMBOLS)
            lo, hi, block, rep = (data.column(c).to_numpy() for c in ("lo", "hi", "block", "rep"))
            number = data.column("key").to_numpy() >> 16 * (chunk - 1)
            forest = Forest(len(rep))
            for a, b in lags(np.repeat(starts[1:], np.diff(starts)), lo, hi, block, forest):
                same = (symbols[a] == symbols[b]).reshape(len(a), -1, chunk)
                errors = chunk - same.sum(2)
                # A pair that meets under several keys counts under the first of them only.
                first = (errors <= ERRORS).argmax(1)
                row = np.arange(len(a))
                left_out = np.where(errors[row, first] > 0, same[row, first].argmin(1), 0)
                near = (errors.sum(1) <= distance(chunk)) & (first * chunk + left_out == number[a])
                forest.link(a[near], b[near])
            yield forest.edges(rep)

    return run


def exact_links(similarity: tuple[int, int]):
    """Of each pair of blocks, what is connected by pairs with intersection / union >= similarity."""
    least, whole = similarity

    def compare(sets: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, block: np.ndarray) -> Forest:
        n, sizes = len(sets), np.array([len(s) for s in sets])
        forest = Forest(n)
        values, which = np.unique(np.concatenate(sets), return_inverse=True)
        common = np.bincount(which) > 1
        place = np.cumsum(common) - 1
        width = int(common.sum())
        bits = np.zeros((n, -(-max(width, 1) // 8)), np.uint8)
        at = 0
        for i, size in enumerate(sizes):
            own = which[at:at + size]
            row = np.zeros(bits.shape[1] * 8, bool)
            row[place[own[common[own]]]] = True
            bits[i] = np.packbits(row)
            at += size
        step = max(1, (8 << 20) // bits.shape[1])
        for a, b in lags(np.full(n, n), lo, hi, block, forest):
            fit = np.minimum(sizes[a], sizes[b]) * whole >= np.maximum(sizes[a], sizes[b]) * least
            a, b = a[fit], b[fit]
            for i in range(0, len(a), step):
                x, y = a[i:i + step], b[i:i + step]
                both = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64)
                linked = both * whole >= (sizes[x] + sizes[y] - both) * least
                forest.link(x[linked], y[linked])
        return forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["cluster", "lo", "hi"]
        for data in runs(batches, keys):
            data = data.combine_chunks()
            starts = run_starts(data, keys)
            flat, offsets = text_bytes(data.column("shingles").chunk(0))
            flat, offsets = flat.view(np.uint64), offsets // 8
            lo, hi, block, rep = (data.column(c).to_numpy() for c in ("lo", "hi", "block", "rep"))
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a > 1:
                    sets = [flat[x:y] for x, y in zip(offsets[a:b], offsets[a + 1:b + 1])]
                    yield compare(sets, lo[a:b], hi[a:b], block[a:b]).edges(rep[a:b])

    return run


def sets_of(members: DataFrame, words: int) -> DataFrame:
    """Full sets of ``members(cluster, rep, h1, size, text)``; a text that isn't the class's own is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(*text_bytes(batch.column("text")), words)
            own = batch.column("h1").to_numpy().view(np.uint64)
            keep = [i for i, s in enumerate(sets) if len(s) and mix(s).sum(dtype=np.uint64) == own[i]]
            kept = batch.select(["cluster", "rep", "size"]).take(pa.array(keep, pa.int64()))
            bounds = np.concatenate([[0], np.cumsum([len(sets[i]) * 8 for i in keep])]).astype(np.int64)
            flat = np.concatenate([sets[i] for i in keep]).view(np.uint8) if keep else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_arrays([*kept.columns, binary(flat, bounds)], ["cluster", "rep", "size", "shingles"])

    return members.select("cluster", "rep", "size", "h1", "text").mapInArrow(run, "cluster long, rep long, size long, shingles binary")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Sets are linked if intersection * similarity[1] >= union * similarity[0]; ``component_id`` is the smallest doc_id that
    can be reached over links, and ``kept`` tells whether that is the document itself.
    """
    scratch, chunk = scratch or Scratch(docs.sparkSession, "neardup"), chunk_for(similarity)
    sketches = scratch.save(sketch(docs, words), "sketches")
    same = ["n_shingles", "h1", "h2"]
    classes = scratch.save(sketches.where("n_shingles > 0").groupBy(*same).agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature")), "classes")
    known = classes.where("rep IS NOT NULL")
    keys = keyed(known, chunk)
    buckets = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = keys.join(buckets, "key").join(known.select("rep", "signature"), "rep")
    close = scratch.save(block_pairs(members, "key", "size").mapInArrow(close_pairs(chunk), "a long, b long").distinct(), "close")
    clusters = components(close, scratch).select(F.col("id").alias("rep"), F.col("root").alias("cluster"))
    sized = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("size")), "cluster")
    # Clusters grow with the documents: their join with the texts is a shuffle of both at every size.
    facts = scratch.save(sized.join(known.select("rep", "h1"), "rep"), "clusters").hint("merge")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(facts, "rep")
    links = scratch.save(block_pairs(sets_of(texts, words), "cluster", "size").mapInArrow(exact_links(similarity), "a long, b long").distinct(), "links")
    found = components(links, scratch).select(F.col("id").alias("rep"), "root")
    named = (classes.join(found, "rep", "left").where("copies > 1 OR root IS NOT NULL")
             .select(*[F.col(c).alias(f"_{c}") for c in same], F.coalesce("root", "rep").alias("component_id")))
    joined = sketches.join(named, [sketches[c] == named[f"_{c}"] for c in same], "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=(85, 100))


OP3_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN generate_series(1, len(w) - 2)]
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 85
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(r.component, d.doc_id) AS component_id,
       coalesce(r.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id) r USING (doc_id)
"""
