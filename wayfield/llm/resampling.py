"""Importance resampling towards a target: hashed n-gram features, gains by bucket, a draw by Gumbel scores.

1. *Features.* Arrow kernels lower-case the texts, split them at the separators and flatten the lists of words, which are
   then dictionary-encoded. Indices shifted against each other form the n-grams; only distinct ones are put into bytes,
   and their CRC-32, continued from that of the words before, gives the bucket. The buckets of each document are written
   to a table, so texts are read once.
2. *Gains.* Buckets are counted in each task and summed: one row for each bucket. The logarithm of how much likelier a
   bucket is in the target than in the documents is its gain. The ``buckets`` gains are sent to the tasks as one array.
3. *Weights.* A document's gains are taken by its buckets and reduced by segment: the floored mean.
4. *Draw.* A Gumbel variate from a hash of the id is added, so that the highest scores are a sample drawn without replacement
   with probabilities in proportion to exp(weight / 1000). Ranks come from a range sort and partition sizes.

Cases: null, empty and blank texts have no words, no features and the weight 0; a text of one word has one feature; a null doc_id
counts as an empty one in the hash and stands before all others among equals; rows that repeat an id are drawn each by
its own score, and rows that are equal in all of it in any order; an empty target or an empty table has counts of 0. Only
``doc_id`` and ``text`` are read, so columns of other names don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm.shared import binary, packed, ranges, slices, table, text_bytes
from wayfield.operators.numbering import numbered
from wayfield.sources.scratch import Scratch

# What separates words: ASCII other than letters and digits (upper case is lowered before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Number of words of each text, dictionary indices of all words, and the dictionary."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(text, "")), pattern=SEPARATORS)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.not_equal(pc.binary_length(flat), 0)
    coded = flat.filter(some).dictionary_encode()
    sizes = np.bincount(parent.filter(some).to_numpy(), minlength=len(text))
    return sizes, coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary()).to_pylist()


def gram_buckets(sizes: np.ndarray, index: np.ndarray, words: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``longest`` words, text by text, and how many each text has."""
    counts = np.stack([np.maximum(sizes - n, 0) for n in range(longest)])
    total = counts.sum(0)
    out = np.zeros(int(total.sum()), np.int32)
    first, at = np.cumsum(sizes) - sizes, np.cumsum(total) - total
    crc = np.array([zlib.crc32(w) for w in words], np.int64)
    gram, begin = index, crc
    for n in range(longest):
        if n:
            # A run of n + 1 words is one of n words and the word n places on, within the text.
            pair = gram[:len(index) - n] * max(1, len(words)) + index[n:]
            distinct, gram = np.unique(pair, return_inverse=True)
            ahead = [zlib.crc32(b" ", c) for c in begin.tolist()]
            before, after = np.divmod(distinct, max(1, len(words)))
            begin = np.array([zlib.crc32(words[b], ahead[a]) for a, b in zip(before.tolist(), after.tolist())], np.int64)
        inside = ranges(first, counts[n])
        out[ranges(at, counts[n])] = (begin % buckets)[gram[inside]]
        at = at + counts[n]
    return out, total


def features(docs: DataFrame, longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """``doc_id, n_words, n_features, buckets`` of ``docs(doc_id, text)``; ``buckets`` has 2 or 4 bytes for each feature."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, index, words = _words(batch.column("text"))
            found, total = gram_buckets(sizes, index, words, longest, buckets)
            own = found.astype(kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(total), binary(own.view(np.uint8), np.append(0, np.cumsum(total)) * own.itemsize)],
                ["doc_id", "n_words", "n_features", "buckets"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = 10_000) -> DataFrame:
    """``bucket, n``: features in each bucket that has any. A task adds up all that it reads."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(text_bytes(batch.column("buckets"))[0].view(kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """1000 times the logarithm of how much likelier each bucket is in the target, floored; one count is added to each bucket.

    Both inputs have at most ``buckets`` rows, and so has what is collected.
    """
    counts = np.zeros((2, buckets), np.float64)
    both = source.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1)))
    for row in both.collect():
        counts[row["side"], row["bucket"]] = row["n"]
    (s, t), (all_s, all_t) = counts, counts.sum(1)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weigh(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean of the gains of a document's features."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n_features").to_numpy()
            taken = np.append(gain.take(text_bytes(batch.column("buckets"))[0].view(kind)), 0)
            sums = np.add.reduceat(taken, np.cumsum(total) - total) if len(total) else total
            weight = np.where(total > 0, sums // np.maximum(total, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight)],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2,
                        buckets: int = 10_000, seed: int = 7, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every row of ``docs(doc_id, text)``.

    ``target(text)`` shows what is wanted. Of the documents with ``least_words`` words, ``percent`` of a hundred are drawn;
    ``rank`` is null for the others.
    """
    scratch = scratch or Scratch(docs.sparkSession, "resample")
    found = packed(features(docs, longest, buckets), scratch, "features")
    wanted = features(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets), buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")
    scored = scratch.save(weigh(found, gain).withColumn("score", F.col("weight") + gumbel)
                          .withColumn("_down", -F.col("score")).withColumn("_row", F.monotonically_increasing_id()), "scored")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    # The row's number keeps any share of equal rows apart in the range sort.
    ranked = numbered(scored.where(able), ["_down", "doc_id", "_row"], scratch)
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("bigint")
    return (ranked.withColumn("rank", rank).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint")))
                  .select("doc_id", "n_words", "n_features", "weight", "score", "rank"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = """
WITH texts AS (
  SELECT 0 AS side, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark),
words AS (
  SELECT side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
grams AS (
  SELECT side, doc_id, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS f FROM words),
bytes AS (  -- each byte is followed by eight shifts
  SELECT f, flatten([[('0x' || substr(hex(f), 2 * i - 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, strlen(f) + 1)]) AS s
  FROM (SELECT DISTINCT f FROM grams)),
hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, s),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 10000 AS bucket FROM bytes),
counts AS (SELECT bucket, count(*) FILTER (side = 0)::DOUBLE AS s, count(*) FILTER (side = 1)::DOUBLE AS t FROM grams JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT count(*) FILTER (side = 0)::DOUBLE AS all_s, count(*) FILTER (side = 1)::DOUBLE AS all_t FROM grams),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM grams JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE side = 0),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
