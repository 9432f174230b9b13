"""Packing token ids into sequences of fixed length: shortest pack first over the length histogram.

Documents are cut at every ``limit`` ids; what is left of each is shorter. Pieces are then placed by length
alone, on the histogram of lengths, longest first, each into the pack that is the least full so far
(packs that look alike are one entry with a count). The result, packing patterns with counts, names ranks
of pieces among those of their length; a distributed ranking of pieces joins the patterns back.

The histogram has at most ``limit`` entries whatever the input, and so the patterns' size is bounded too.

Cases: a null or empty text is its end id alone; rows that repeat a doc_id are packed each for itself; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfield.llm.shared import binary, packed, ranges, slices, table, text_bytes
from wayfield.llm.tokens import encoder, narrow, with_end
from wayfield.sources.scratch import Scratch

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
LIMIT = 4096


@dataclass(frozen=True)
class Pattern:
    """``count`` equal packs; each holds ``copies`` more pieces of ``length`` than its ``parent`` does."""

    parent: "Pattern | None"
    length: int
    copies: int


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs as ``(count, [(length, copies), ...])`` with the longest piece first.

    A pack stays the least full while it takes pieces until the next one is; these go in at once.
    """
    heap: list[tuple[int, int, int, Pattern | None]] = []  # -free space, order, packs, contents
    order = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and -heap[0][0] >= length:
                space, _, packs, inside = heapq.heappop(heap)
                space = -space
            else:
                space, packs, inside = limit, left, None
            following = -heap[0][0] if heap else 0
            used = min(packs, left)
            copies = max(1, min(space // length, left // used, -(-(space - max(following, length - 1)) // length)))
            if used < packs:
                heapq.heappush(heap, (-space, order, packs - used, inside))
            heapq.heappush(heap, (-(space - copies * length), order + 1, used, Pattern(inside, length, copies)))
            order += 2
            left -= used * copies
    out = []
    for _, _, packs, inside in sorted(heap, key=lambda x: x[1]):
        chain = []
        while inside is not None:
            chain.append((inside.length, inside.copies))
            inside = inside.parent
        out.append((packs, chain[::-1]))
    return out


def places(packs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Where the pieces of each length go: rows ``length, first rank, packs, first sequence, offset`` by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for count, chain in packs:
        offset = 0
        for length, copies in chain:
            for _ in range(copies):
                rows.append((length, taken.get(length, 0), count, sequence, offset))
                taken[length] = taken.get(length, 0) + count
                offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, path: str, end: int, limit: int) -> DataFrame:
    """Pieces ``part, nth, doc_id, start, length, doc_tokens, ids_crc32, ids`` of ``docs(doc_id, text)``.

    ``nth`` numbers the pieces of one length inside a partition.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, seen = TaskContext.get().partitionId(), encoder(path), np.zeros(limit + 1, np.int64)
        for batch in slices(batches):
            ids, before = with_end(*own.encode(*text_bytes(batch.column("text"))), end)
            tokens = np.diff(before)
            pieces = -(-tokens // limit)
            doc = np.repeat(np.arange(len(tokens)), pieces)
            start = ranges(np.zeros(len(tokens), np.int64), pieces) * limit
            length = np.minimum(tokens[doc] - start, limit)
            by_length = np.argsort(length, kind="stable")
            ordered = length[by_length]
            first = np.searchsorted(ordered, ordered)
            nth = np.empty(len(length), np.int64)
            nth[by_length] = np.arange(len(length)) - first + seen[ordered]
            seen += np.bincount(length, minlength=limit + 1)
            wide, at = ids.astype("<u4"), np.append(before[doc] + start, len(ids))
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1], at[1:])]
            stored = ids.astype(narrow(own.size))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(doc), part, np.int32)), pa.array(nth), batch.column("doc_id").take(pa.array(doc)), pa.array(start),
                pa.array(length), pa.array(tokens[doc]), pa.array(crc, pa.int64()), binary(stored.view(np.uint8), at * stored.itemsize)],
                ["part", "nth", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        cut, "part int, nth long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary")


def pack_documents(docs: DataFrame, path: str, end: int = END_ID, limit: int = LIMIT, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, ids_crc32, ids, sequence_id, offset``.

    ``ids`` are little-endian, 16 bits wide where the vocabulary allows. A column that is not asked for is not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    pieces = packed(cut_pieces(docs, path, end, limit), scratch, "pieces")
    counts = scratch.save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    where = spark.sparkContext.broadcast(places(shortest_pack_first(histogram, limit)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = where.value
        key = slots[:, 0] << 48 | slots[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            found = slots[np.searchsorted(key, batch.column("length").to_numpy() << 48 | rank, side="right") - 1]
            columns = [*batch.columns, pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "sequence_id", "offset"])

    narrow_rows = ranked.select("part", "nth", "length", "rank").mapInArrow(
        place, "part int, nth long, length long, rank long, sequence_id long, offset long")
    return (pieces.join(narrow_rows.drop("rank"), ["part", "nth", "length"])
            .select("doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", "sequence_id", "offset"))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packs.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
