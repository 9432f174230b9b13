"""Repeated passages by a sparse suffix array.

A passage is a run of ``least`` words or more (words as they are, whatever white space is between them) that
stands in two documents or more. Of all suffixes (a text from some word on) only those are retained that
start where the text itself says so: in each run of 25 neighbouring word 8-grams, at the one with the least
hash. Every passage of 50 words so has a retained suffix among its first 25 words, the same in all copies.

1. Retained suffixes are sorted by their first 26 words (as a hash; a range sort, so that equal ones of any
   number are spread over partitions) and neighbours compared. Suffixes that agree with another document's go on.
2. From these, matches are extended to the left and to the right: each stretch of ``least`` words around the
   suffix is sorted and compared with its neighbours in turn; stretches that are equal are matches, and
   overlapping matches of a document are joined to the longest spans.
3. A match is kept in the document with the smallest id and removed from the others. A word that is removed
   from a document so is always kept in one with a smaller id.

Repeats inside one document are not matches. Cases: null, empty and short texts have no match; rows with a
null doc_id take no part and stay as they are; rows that repeat a doc_id count as one document, whose spans
are those of all its rows; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm.shared import slices, table, text_bytes
from wayfield.llm.words import grams, split_words, word_hashes
from wayfield.sources.scratch import Scratch

LEAST = 50
GRAM, CHOICE = 8, 25


def retained(words: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all passages of ``least`` words inside one text, and the retained suffix of each."""
    if len(words) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.arange(len(words) - least + 1)
    text = np.searchsorted(before, start, side="right") - 1
    start = start[start + least <= before[text + 1]]
    views = np.lib.stride_tricks.sliding_window_view(grams(words, GRAM), CHOICE)
    return start, start + views.argmin(1)[start]


def suffix_keys(docs: DataFrame, least: int) -> DataFrame:
    """``key, doc_id, at``: hash of the first words of each retained suffix and where it starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, before = word_hashes(*text_bytes(batch.column("text")), lower=False)
            at = np.unique(retained(words, before, least)[1])
            text = np.searchsorted(before, at, side="right") - 1
            keys = grams(words, least - CHOICE + 1)[at] if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("doc_id").take(pa.array(text)),
                                              pa.array((at - before[text]).astype(np.int32))], ["key", "doc_id", "at"])

    return docs.mapInArrow(run, "key long, doc_id long, at int")


def stretches_around(docs: DataFrame, least: int) -> DataFrame:
    """``key, doc_id, at``: all stretches of ``least`` words whose retained suffix is in ``docs(doc_id, text, suffixes)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, before = word_hashes(*text_bytes(batch.column("text")), lower=False)
            start, suffix = retained(words, before, least)
            lists = batch.column("suffixes")
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            known = lists.flatten().to_numpy() + before[owner]
            start = start[np.isin(suffix, known)]
            text = np.searchsorted(before, start, side="right") - 1
            keys = grams(words, least)[start] if len(start) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("doc_id").take(pa.array(text)),
                                              pa.array((start - before[text]).astype(np.int32))], ["key", "doc_id", "at"])

    return docs.mapInArrow(run, "key long, doc_id long, at int")


def compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, doc_id, at, first, edge`` of the rows (sorted by all columns) whose key another document has too.

    ``first`` is the first document with the key. Where a run of equal keys may go on in another partition
    ``edge`` is set, ``first`` is as far as this partition knows, and rows stand even if they are alone.
    Held back are only the rows of a run's first document while no other has come.
    """
    held, seen, edge = None, None, True  # seen: key, first document and whether there are others
    for batch in (b for b in batches if b.num_rows):
        data = [batch.column(c).to_numpy() for c in ("key", "doc_id", "at")]
        if held is not None:
            data = [np.concatenate(x) for x in zip(held, data)]
        key, doc, at = data
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        first = doc[starts].copy()
        shared = doc[starts + sizes - 1] != first
        edges = np.zeros(len(starts), bool)
        if seen is not None and key[0] == seen[0]:
            first[0], shared[0] = seen[1], seen[2] or doc[sizes[0] - 1] != seen[1]
            edges[0] = edge
        elif seen is None:
            edges[0] = True
        edge = bool(edges[-1])
        seen = (key[-1], first[-1], bool(shared[-1]))
        whole = len(key) - 1 if shared[-1] else int(starts[-1])
        held = [x[whole:] for x in data]
        keep = np.repeat(shared | edges, sizes)[:whole]
        yield _marked(key[:whole][keep], doc[:whole][keep], at[:whole][keep],
                      np.repeat(first, sizes)[:whole][keep], np.repeat(edges, sizes)[:whole][keep])
    if held is not None:
        n = len(held[0])
        yield _marked(*held, np.full(n, seen[1]), np.ones(n, bool))


def _marked(key: np.ndarray, doc: np.ndarray, at: np.ndarray, first: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, doc, at, first, edge)], ["key", "doc_id", "at", "first", "edge"])


def sorted_and_compared(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "doc_id", "at"]
    return (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                .mapInArrow(compare_neighbours, "key long, doc_id long, at int, first long, edge boolean"))


def repeated_stretches(docs: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """``doc_id, at, first``: every stretch of ``least`` words that another document has too."""
    own = docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id IS NOT NULL")
    suffixes = sorted_and_compared(suffix_keys(own, least)).groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("suffixes"))
    around = stretches_around(own.join(suffixes, "doc_id"), least)
    marked = scratch.save(sorted_and_compared(around), "stretches")
    # Runs at the edges of partitions, put together: at most two keys for each partition, whatever the rows.
    edges = marked.where("edge").groupBy("key").agg(F.min("first").alias("first"), F.max("doc_id").alias("last")).where("first <> last").collect()
    known = F.create_map(*[F.lit(x).cast("bigint") for e in edges for x in (e["key"], e["first"])]) if edges else F.lit(None).cast("map<bigint,bigint>")
    first = F.when(F.col("edge"), F.try_element_at(known, F.col("key"))).otherwise(F.col("first"))
    return marked.select("doc_id", "at", first.alias("first")).where("first IS NOT NULL")


def joined_spans(at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the unions of stretches that overlap or touch; ``at`` is sorted."""
    new = np.flatnonzero(np.append(True, np.diff(at) > least)) if len(at) else np.zeros(0, np.int64)
    return at[new], at[np.append(new[1:], len(at)) - 1] + least if len(at) else at


def per_document(stretches: DataFrame) -> DataFrame:
    return stretches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "first"))).alias("found"))


def repeated_passages(docs: DataFrame, least: int = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, start_word, end_word, first_doc, removed``: the longest repeated spans of each document.

    Words are numbered from 0, ``end_word`` is past the span. Spans to keep (``first_doc`` is the document
    itself) and spans to remove (``first_doc`` is the smallest one that holds a part of it) are apart and may overlap.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, found in zip(batch.column("doc_id").to_pylist(), batch.column("found")):
                at, first = (found.values.field(i).to_numpy() for i in (0, 1))
                for removed in (False, True):
                    own = (first != doc) == removed
                    a, f = at[own], first[own]
                    for x, y in zip(*joined_spans(a, least)):
                        rows.append((doc, int(x), int(y), int(f[np.searchsorted(a, x):np.searchsorted(a, y - least, side="right")].min()), removed))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                                             ["doc_id", "start_word", "end_word", "first_doc", "removed"])

    return per_document(repeated_stretches(docs, least, scratch)).mapInArrow(
        run, "doc_id long, start_word long, end_word long, first_doc long, removed boolean")


def without_repeats(docs: DataFrame, least: int = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with all but one copy of each repeated passage cut out of ``text``; other columns stay.

    With a passage goes the white space behind it. A document that had nothing else is left with what white space is left.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")
    removed = repeated_stretches(docs, least, scratch).where("first <> doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("__at"))
    joined = docs.join(removed.withColumnRenamed("doc_id", "__doc"), F.col("doc_id").cast("bigint") == F.col("__doc"), "left").drop("__doc")
    place = joined.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            lists = batch.column("__at")
            for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)):
                raw = np.frombuffer(texts[i].encode(), np.uint8)
                starts, _, _ = split_words(raw, np.array([0, len(raw)]))
                keep, starts = np.ones(len(raw), bool), np.append(starts, len(raw))
                for a, b in zip(*joined_spans(lists[i].values.to_numpy(), least)):
                    keep[starts[min(a, len(starts) - 1)]:starts[min(b, len(starts) - 1)]] = False
                texts[i] = raw[keep].tobytes().decode()
            columns = [c for c in batch.columns]
            columns[place] = pa.array(texts, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return joined.mapInArrow(run, joined.schema).select(*docs.columns)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
stretches AS (
  SELECT doc_id, i - 1 AS pos, md5(array_to_string(w[i:i + 49], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM words WHERE len(w) >= 50)),
owners AS (SELECT s, min(doc_id) AS owner FROM stretches GROUP BY s HAVING min(doc_id) <> max(doc_id)),
found AS (SELECT doc_id, pos, owner, owner <> doc_id AS removed FROM stretches JOIN owners USING (s)),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, removed ORDER BY pos) AS island FROM (
    SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, removed ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS fresh FROM found))
SELECT doc_id, min(pos)::BIGINT AS start_word, (max(pos) + 50)::BIGINT AS end_word, min(owner) AS first_doc, removed
FROM islands GROUP BY doc_id, removed, island
"""
