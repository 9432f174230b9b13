"""Helpers of the training-data operators: saved tables, Arrow batches, distributed prefix sums, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfield.sources.scratch import Scratch

# Text handled by the array kernels at once; a longer document is handled alone, whole.
SLICE_BYTES = 2 << 20
# What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_in(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def packed(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Save binary columns with a codec that finds repeats between rows."""
    path = f"{scratch.path}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most :data:`SLICE_BYTES`, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(text_offsets(batch.column(column))))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _plain(column: pa.Array) -> pa.Array:
    kind = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    return column.fill_null(b"" if kind == pa.large_binary() else "") if column.null_count else column


def text_offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of the rows of a text or binary column; null counts as empty."""
    column = _plain(column)
    return np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and the offsets of its rows, from 0."""
    column = _plain(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    buffer = column.buffers()[2]
    if buffer is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffer, np.uint8, offsets[-1] - offsets[0], offsets[0]), offsets - offsets[0]


def binary(parts: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from one array of bytes and row offsets."""
    if len(parts) < 2 ** 31:
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                     [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(parts))])
    return pa.array([parts[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``start, start + 1, ...`` of the given lengths."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches into tables that hold only whole runs of equal ``keys``."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now]).combine_chunks()
        last = {k: now.column(k)[-1].as_py() for k in keys}
        same = np.ones(now.num_rows, bool)
        for k, v in last.items():
            same &= now.column(k).to_numpy() == v
        cut = now.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield now.slice(0, cut)
        rest = now.slice(cut)
    if rest is not None:
        yield rest


def run_starts(data: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a run of equal ``keys`` begins, and the number of rows."""
    new = np.ones(data.num_rows + 1, bool)
    new[1:-1] = reduce(np.logical_or, [np.diff(data.column(k).to_numpy()) != 0 for k in keys])
    return np.flatnonzero(new)


def running_sum(df: DataFrame, by: list[str], order: list[str], value: str, scratch: Scratch, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of the same ``by``, in the order ``order``.

    Rows are range-sorted by group and order, so a group of any size is spread over partitions;
    partitions are summed alone, and only one row per partition and group is summed over the whole.
    The rows should carry narrow columns only. Rows that tie on ``order`` stand in the order in
    which they were written.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    ranged = scratch.save(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
                            .withColumn("_row", F.monotonically_increasing_id()), name)
    inside = Window.partitionBy("_part", *by).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part", *by).agg(F.sum(value).alias("_sum"))
    before = sums.select(F.col("_part").alias("_p"), *[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)],
                         F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    on = [own["_part"] == before["_p"], *[own[b].eqNullSafe(before[f"_b{i}"]) for i, b in enumerate(by)]]
    return (own.join(before, reduce(lambda a, b: a & b, on)).withColumn(name, F.col("_before") + F.col("_in"))
               .select(*df.columns, name))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, root`` for every end of ``edges(a, b)``: root is the smallest id that can be reached.

    Alternating large-star and small-star rounds, each a written table. Minima are pre-aggregated, written
    and joined back: both sides of these joins come from tables, so adaptive execution splits the key
    of a node with very many neighbours.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    facts = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = scratch.save(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u")
        nearer = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = scratch.save(nearer.where("u <> v").distinct(), "edges")
        # A star forest that a round leaves as it is has as many edges and the same sum of ends.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if facts is not None and tuple(seen) == tuple(facts):
            break
        facts = seen
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
