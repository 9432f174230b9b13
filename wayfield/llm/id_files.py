"""Token ids in files: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

Each id is replaced by its rank by frequency over the whole corpus. A rank takes one to four bytes; the
numbers of bytes, two bits each, stand four to a byte in a control stream apart from the data. A file is one
row of a Parquet table (any store Spark writes to will do) and holds consecutive documents in ascending
doc_id order: a header of four unsigned 64-bit numbers (format, documents, ids, control bytes), the
documents' ids and numbers of token ids, the control bytes, the data bytes. The table of ranks is stored
beside the files; its length is bounded by the vocabulary.

Cases: a null text is an empty one (its end id alone); rows that repeat a doc_id are separate documents in
the order of their ids; a null doc_id comes first; an empty table gives no files and an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm.shared import binary, packed, running_sum, slices, table, text_bytes
from wayfield.llm.tokens import encoder, narrow, with_end
from wayfield.sources.scratch import Scratch

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
FORMAT = 1
# Ids in a file, unless one document has more.
FILE_IDS = 1 << 18

# Numbers of bytes of the four values that a control byte speaks of.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of non-negative numbers below 2^32."""
    more = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = more
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    spread = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control, spread[np.arange(4) <= more[:, None]]


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers behind :func:`encode_ranks`: lengths from a table, values from shifted bytes."""
    lengths = _LENGTHS[control].ravel()[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_file(doc_ids: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    head = np.array([FORMAT, len(doc_ids), len(ranks), len(control)], "<u8")
    return b"".join([head.tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), control.tobytes(), data.tobytes()])


def read_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc_ids, counts, ranks`` of a file."""
    kind, docs, ids, controls = np.frombuffer(content, "<u8", 4).tolist()
    if kind != FORMAT:
        raise ValueError(f"unknown format {kind}")
    doc_ids, counts = np.frombuffer(content, "<i8", 2 * docs, 32).reshape(2, docs)
    rest = np.frombuffer(content, np.uint8, offset=32 + 16 * docs)
    return doc_ids, counts, decode_ranks(rest[:controls], rest[controls:], ids)


def tokenize_sorted(docs: DataFrame, path: str, end: int) -> DataFrame:
    """``part, row, doc_id, n, ids`` in ascending doc_id order: parts follow each other, rows do within a part."""
    schema = "part int, row long, doc_id long, n long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, own = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in slices(batches):
            ids, before = with_end(*own.encode(*text_bytes(batch.column("text"))), end)
            ids = ids.astype(narrow(own.size))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), batch.column("doc_id"),
                pa.array(np.diff(before)), binary(ids.view(np.uint8), before * ids.itemsize)], ["part", "row", "doc_id", "n", "ids"])
            row += n

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(encode, schema)


def id_ranks(tokenized: DataFrame, size: int) -> np.ndarray:
    """Ids by falling frequency over the whole corpus; ties and unused ids in numeric order.

    Tasks count their own ids; what reaches the driver is one row per id of the vocabulary.
    """
    width = narrow(size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(text_bytes(batch.column("ids"))[0].view(width), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in tokenized.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["id"]] = row["n"]
    return np.argsort(-counts, kind="stable").astype(np.int32)


def write_id_files(docs: DataFrame, path: str, end: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Store all texts of ``docs(doc_id, text)``; returns the files ``part, row, ids, content`` and the ranks ``rank, id``."""
    spark = docs.sparkSession
    size = encoder(path).size
    tokenized = packed(tokenize_sorted(docs, path, end), scratch, "ids")
    by_rank = id_ranks(tokenized, size)
    rank_of = np.empty(size, np.uint32)
    rank_of[by_rank] = np.arange(size)
    shared = spark.sparkContext.broadcast(rank_of)
    width = narrow(size)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            part, row = batch.column("part").to_numpy(), batch.column("row").to_numpy()
            counts, doc_ids = batch.column("n").to_numpy(), batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
            ranks = shared.value[text_bytes(batch.column("ids"))[0].view(width)]
            ends = np.cumsum(counts)
            apart = np.flatnonzero((np.diff(part) != 0) | (np.diff(row) != 1)) + 1
            at, out = 0, []
            while at < len(part):
                stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FILE_IDS, side="right"))
                stop = max(at + 1, min([stop, len(part), *apart[apart > at][:1].tolist()]))
                first = ends[at - 1] if at else 0
                out.append((part[at], row[at], ends[stop - 1] - first, write_file(doc_ids[at:stop], counts[at:stop], ranks[first:ends[stop - 1]])))
                at = stop
            p, r, n, content = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(r, pa.int64()), pa.array(n, pa.int64()), pa.array(content, pa.binary())], ["part", "row", "ids", "content"])

    files = packed(tokenized.mapInArrow(pack, "part int, row long, ids long, content binary"), scratch, "files")
    ranks = scratch.save(spark.createDataFrame(pa.table({"rank": np.arange(size, dtype=np.int32), "id": by_rank})), "ranks")
    return files, ranks


def read_id_files(files: DataFrame, ranks: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (unsigned 32-bit, little-endian) of every document, from the files alone."""
    spark = files.sparkSession
    rows = ranks.collect()  # as many as the vocabulary has ids
    by_rank = np.zeros(len(rows), "<u4")
    by_rank[[r["rank"] for r in rows]] = [r["id"] for r in rows]
    shared = spark.sparkContext.broadcast(by_rank)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, content in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "content"))):
                doc_ids, counts, codes = read_file(content)
                ids = shared.value[codes]
                before = np.concatenate([[0], np.cumsum(counts)])
                n = len(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, row, np.int64)),
                    pa.array(doc_ids, mask=doc_ids == np.iinfo(np.int64).min), pa.array(before[:-1]),
                    pa.array(counts), binary(ids.view(np.uint8), before * 4)], ["part", "row", "doc_id", "inside", "n_tokens", "ids"])

    docs = files.select("part", "row", "content").mapInArrow(unpack, "part int, row long, doc_id long, inside long, n_tokens long, ids binary")
    firsts = running_sum(files.select("part", "row", "ids"), [], ["part", "row"], "ids", scratch, "before").select("part", "row", "before")
    return docs.join(firsts, ["part", "row"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids")


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "id-files")
    files, ranks = write_id_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID, scratch)
    read = read_id_files(files, ranks, scratch)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
