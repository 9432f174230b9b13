"""Near duplicates by SimHash: all fingerprints within a few bits of each other, compared tile by tile.

1. A document's fingerprint has a bit for each bit of the hashes of its shingles: set if it is set in over half of them. Bits are
   counted for many hashes at once in 16-bit lanes of machine words.
2. Documents with equal fingerprints form a class and go on as one.
3. Classes are sorted by their population counts: that of all bits, then of the halves, quarters and bytes. Ranks in this order
   are cut into blocks. Two fingerprints differ in at least as many bits as their counts do, so only pairs of blocks whose counts come
   within ``radius`` are compared, and these are the units of work: bounded in size, whatever fingerprints there are.
4. A unit cuts its blocks into tiles. A pair of tiles is skipped if the counts of the parts, taken together, differ beyond the radius;
   else all its fingerprints are compared by exclusive-or and bit counts. A unit returns each member with the smallest one that it is
   connected with: fewer rows than members, never all pairs. Members of a tile that are connected already are not compared with
   others of their own component.
5. The connected components of these are the result.

The comparison is exact, and its work grows with the square of the number of different fingerprints, less what the counts rule out
(their parts rule out the more, the more tiles there are). Rows of a unit grow in proportion to the input.

Cases: null, empty and blank texts have the fingerprint zero and are linked like any other; a text with fewer words than a shingle
has its word sequence as its only shingle; rows that repeat a doc_id are judged each by its own text; a null doc_id is never the
smallest id of a component that has others; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm.shared import components, run_starts, runs, slices, table, text_bytes
from wayfield.llm.words import joined_words, split_words
from wayfield.operators.numbering import numbered
from wayfield.sources.scratch import Scratch

SEED = 42
# Blocks that the classes are cut into, as long as a block has no more members than the limit: then there are more blocks.
BLOCKS, MOST_MEMBERS = 32, 1 << 20
# Members of a tile, and fingerprints that a tile is compared with at once.
TILE, COLUMNS = 256, 1 << 15
# Hashes added up in 16-bit lanes.
LANE = 1 << 15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every ``n``-word shingle of the lower-cased texts, and how many each text has."""
    starts, ends, words = split_words(data, offsets)
    joined, first, _ = joined_words(_LOWER[data], starts, ends, words)
    end = first + (ends - starts)
    sizes = np.diff(words)
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    begin = np.repeat(words[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    last = begin + np.repeat(np.minimum(sizes, n), count) - 1
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(first[begin].tolist(), end[last].tolist())), np.uint64, len(begin)), count


def fingerprints(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text the bits that are set in over half of its ``count`` hashes; 0 without any."""
    parts = -(-count // LANE)
    own = np.repeat(np.arange(len(count)), parts)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = (np.cumsum(count) - count)[own] + nth * LANE
    out = np.zeros(len(count), np.uint64)
    if not len(starts):
        return out
    lanes = np.uint64(0x0001000100010001)
    for bit in range(16):
        sums = np.add.reduceat(h >> np.uint64(bit) & lanes, starts)
        for lane in range(0, 64, 16):
            total = np.zeros(len(count), np.int64)
            np.add.at(total, own, (sums >> np.uint64(lane) & np.uint64(0xFFFF)).astype(np.int64))
            out |= (2 * total > count).astype(np.uint64) << np.uint64(bit + lane)
    return out


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each row as a signed number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = fingerprints(*shingle_hashes(*text_bytes(batch.column("text")), words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, fp long")


def _part_counts(fp: Column) -> Column:
    """One number that sorts by the count of all bits, of the upper half, of its and the lower half's upper quarter, and of bytes."""
    def count(low: int, bits: int) -> Column:
        return F.bit_count(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))).cast("bigint")

    key = F.bit_count(fp).cast("bigint")
    for low, bits, width in ((32, 32, 6), (48, 16, 5), (16, 16, 5), (56, 8, 4), (40, 8, 4), (24, 8, 4), (8, 8, 4)):
        key = F.shiftleft(key, width) + count(low, bits)
    return key


def in_units(classes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Deal ``classes(fp)`` into pairs of blocks: ``fp, rank, block, lo, hi``, a row for each pair that its block is part of."""
    spark = classes.sparkSession
    total = classes.count()
    members = min(MOST_MEMBERS, max(TILE, -(-total // BLOCKS)))
    ranked = numbered(classes.select("fp", _part_counts(F.col("fp")).alias("parts")), ["parts", "fp"], scratch)
    ranked = scratch.save(ranked.select("fp", "rank", F.floor(F.col("rank") / members).alias("block"),
                                        F.bit_count("fp").cast("bigint").alias("n")), "ranked")
    # Blocks are in the order of counts: those that come near one are the ones from the first that reaches up to it to the last that begins in its reach.
    spans = scratch.save(ranked.groupBy("block").agg(F.min("n").alias("least"), F.max("n").alias("most")), "spans")
    first = spans.select(F.explode(F.sequence(F.lit(-radius).cast("bigint"), F.col("most"))).alias("least"), "block").groupBy("least").agg(F.min("block").alias("first"))
    last = spans.select(F.explode(F.sequence("least", F.lit(64 + radius).cast("bigint"))).alias("most"), "block").groupBy("most").agg(F.max("block").alias("last"))
    near = (spans.withColumn("least", F.col("least") - radius).withColumn("most", F.col("most") + radius)
                 .join(first, "least").join(last, "most").select("block", "first", "last"))
    units = ranked.join(near, "block").withColumn("other", F.explode(F.sequence("first", "last")))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (units.select("fp", "rank", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
                 .repartition(parts, "lo", "hi").sortWithinPartitions("lo", "hi", "rank"))


def _boxes(fp: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and greatest population counts of each tile: of all bits, halves, quarters and bytes."""
    counts, out = np.bitwise_count(fp.view(np.uint8).reshape(-1, 8)).astype(np.int16), []
    while True:
        out.append((np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)))
        if counts.shape[1] == 1:
            return out
        counts = counts[:, ::2] + counts[:, 1::2]


def _link(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Connect the members ``a`` with ``b``; ``label`` points to the first member of each component."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((up := label[label]) != label).any():
            label[:] = up


def compare(fp: np.ndarray, block: np.ndarray, lo: int, hi: int, radius: int) -> np.ndarray:
    """For each member of one unit the first one that it is connected with over pairs within ``radius``."""
    label = np.arange(len(fp))
    mine = int(np.searchsorted(block, lo, side="right"))
    edge = lambda a, b: np.arange(a, b, TILE)
    starts = edge(0, mine) if lo == hi else np.append(edge(0, mine), edge(mine, len(fp)))
    ends = np.append(starts[1:], len(fp))
    rows = len(edge(0, mine))
    boxes = _boxes(fp, starts)
    for i in range(rows):
        others = np.arange(i, len(starts)) if lo == hi else np.arange(rows, len(starts))
        for least, most in boxes:
            gap = np.maximum(least[others] - most[i], least[i] - most[others]).clip(0).sum(1)
            others = others[gap <= radius]
        if not len(others):
            continue
        tile = np.arange(starts[i], ends[i])
        size = ends[others] - starts[others]
        columns = np.repeat(starts[others] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        for at in range(0, len(columns), COLUMNS):
            some = columns[at:at + COLUMNS]
            if (label[tile] == label[tile[0]]).all():
                some = some[label[some] != label[tile[0]]]
            a, b = np.nonzero(np.bitwise_count(fp[tile][:, None] ^ fp[some]) <= radius)
            _link(label, tile[a], some[b])
    return label


def close_members(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["lo", "hi"]
        for data in runs(batches, keys):
            data = data.combine_chunks()
            starts = run_starts(data, keys)
            fp, block, lo, hi = (data.column(c).to_numpy() for c in ("fp", "block", "lo", "hi"))
            for a, b in zip(starts[:-1], starts[1:]):
                own = np.ascontiguousarray(fp[a:b])
                label = compare(own.view(np.uint64), block[a:b], lo[a], hi[a], radius)
                # Named by the smallest member, so that equal pairs of several units fall together.
                least = np.full(len(own), np.iinfo(np.int64).max)
                np.minimum.at(least, label, own)
                other = least[label]
                yield pa.RecordBatch.from_arrays([pa.array(own[other != own]), pa.array(other[other != own])], ["a", "b"])

    return run


def simhash_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs(doc_id, text)``.

    Fingerprints of ``words``-word shingles, repeats included, are linked if they differ in at most ``radius`` bits; ``component_id`` is
    the smallest doc_id that can be reached over links.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    sketches = scratch.save(sketch(docs, words), "sketches")
    classes = scratch.save(sketches.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    edges = scratch.save(in_units(classes, radius, scratch).mapInArrow(close_members(radius), "a long, b long").distinct(), "edges")
    found = components(edges, scratch).select(F.col("id").alias("fp"), "root")
    rooted = classes.join(found, "fp", "left")
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("smallest"))
    named = (rooted.where("copies > 1 OR root IS NOT NULL").join(least, "root", "left")
                   .select(F.col("fp").alias("_fp"), F.coalesce("smallest", "rep").alias("component_id")))
    # A fingerprint that a third of all rows have is a key that adaptive execution splits: both sides come from tables.
    named = scratch.save(named, "named")
    return (sketches.join(named, sketches["fp"] == named["_fp"], "left")
                    .select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id")))


def op13_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
