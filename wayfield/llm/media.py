"""Media columns: documents' bytes in progressive JPEG files, and files as RGB tensors.

A payload's bytes are stored as quantised coefficients, a block for each 64 of them: each byte is the signed
number that its place in a list of bytes stands for (frequent ones have small numbers), so the file gives the
payload back exactly and is smaller than it. Reading accumulates all scans into coefficients, from which
come both the payload and, by inverse transform, chroma upsampling and colour conversion, the RGB tensor.
Tensors are stored as a column of bytes; features are taken from the stored ones.

The query goes through the documents in ``PASSES`` shares by hash, at every size, and clears a share's files and tensors
once its features are written: tensors are twice as large as the payloads and hardly compress.

Cases: a null text is an empty one (a payload of 64 zero bytes); rows that repeat a doc_id or a text are stored
each for itself and equally; a file that isn't a progressive JPEG has a null tensor; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm import jpeg
from wayfield.llm.shared import packed, slices, table, text_bytes
from wayfield.sources.scratch import Scratch

# Bytes that are frequent in texts, the most frequent first; all others follow in numeric order.
FREQUENT = b" enatiorhsdlugc.bm,fpwykvT\xc3AIOEzqxj\n"
_LISTED = [*FREQUENT, *[b for b in range(256) if b not in FREQUENT]]
_NUMBERS = np.array([(i + 1) // 2 if i % 2 else -(i // 2) for i in range(256)])
_TO_NUMBER = np.zeros(256, np.int64)
_TO_NUMBER[_LISTED] = _NUMBERS
_TO_BYTE = np.zeros(256, np.uint8)
_TO_BYTE[_NUMBERS + 127] = _LISTED
BLOCK = 64
# Shares of the documents whose files and tensors are on disk together.
PASSES = 8
FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def stored_payloads(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` of ``docs(doc_id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            sizes = np.diff(offsets)
            counts = np.maximum(1, -(-sizes // BLOCK))
            starts = (np.cumsum(counts) - counts) * BLOCK
            payload = np.zeros(int(counts.sum()) * BLOCK, np.uint8)
            payload[np.arange(len(data)) + np.repeat(starts - offsets[:-1], sizes)] = data
            files = jpeg.encode(_TO_NUMBER[payload].reshape(-1, BLOCK), counts, [int(n).to_bytes(8, "big") for n in counts * BLOCK])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def payload_of(image: jpeg.Image, coefficients: np.ndarray) -> np.ndarray:
    """The bytes that :func:`stored_payloads` stored, from the coefficients."""
    order, _ = image.order([0, 1, 2])
    size = int.from_bytes(image.comment, "big")
    return _TO_BYTE[coefficients[order[:size // BLOCK]].ravel() + 127]


def rgb_tensors(media: DataFrame) -> DataFrame:
    """``doc_id, height, width, rgb`` (height x width x 3 bytes, row by row) of ``media(doc_id, media)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                try:
                    (image,), coefficients = jpeg.decode([content or b""])
                    rows.append((doc, image.height, image.width, jpeg.rgb(image, coefficients).tobytes()))
                except ValueError:
                    rows.append((doc, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                                             ["doc_id", "height", "width", "rgb"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, height int, width int, rgb binary")


def read_payloads(media: DataFrame) -> DataFrame:
    """Facts on each stored file, its payload read back and its tensor: :data:`FACTS` and ``height, width, rgb``."""
    schema = f"{FACTS}, height int, width int, rgb binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            files = batch.column("media").to_pylist()
            images, coefficients = jpeg.decode(files)
            rows = []
            for image, content in zip(images, files):
                payload = payload_of(image, coefficients).tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(content),
                             hashlib.sha256(content).hexdigest(), image.height, image.width, jpeg.rgb(image, coefficients).tobytes()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]],
                                             [f.split()[0] for f in schema.split(", ")])

    return media.mapInArrow(run, schema)


def tensor_features(tensors: DataFrame) -> DataFrame:
    """``tensors`` without the tensors but with ``feature``: size and, for each colour, the mean in thousandths, the least and the largest value."""
    others = [f for f in tensors.schema if f.name not in ("height", "width", "rgb")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "rgb"):
            data, offsets = text_bytes(batch.column("rgb"))
            pixels, starts, sizes = data.reshape(-1, 3), offsets[:-1] // 3, np.diff(offsets) // 3
            facts = [(np.add.reduceat(c, starts, dtype=np.int64) * 1000 // sizes, np.minimum.reduceat(c, starts), np.maximum.reduceat(c, starts))
                     for c in (np.ascontiguousarray(pixels[:, i]) for i in range(3))]
            columns = [x.tolist() for colour in facts for x in colour]
            said = [f"{w}x{h} {a},{b},{c} {d},{e},{f} {g},{i},{j}" for w, h, a, b, c, d, e, f, g, i, j in
                    zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), *columns)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in others], pa.array(said)], [*[f.name for f in others], "feature"])

    return tensors.mapInArrow(run, f"{FACTS}, feature string")


def media_features(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """:data:`FACTS` and ``feature`` of every row of ``docs(doc_id, text)``, through stored files and stored tensors."""
    spark = docs.sparkSession
    kept, out = Scratch(spark, "media"), None
    for i in range(passes):
        share = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(passes)) == i)
        with Scratch(spark, "media-share") as own:
            tensors = own.save(read_payloads(packed(stored_payloads(share), own, "media")), "tensors")
            part = kept.save(tensor_features(tensors), "features")
        out = part if out is None else out.unionByName(part)
    return out


def op7_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents").select("doc_id", "text"))
