"""Quality scores: histogram gradient-boosted trees over document statistics.

Statistics are counted over whole texts in array passes inside the tasks. The trees are grown on a sample
of labelled rows that is bounded by ``sample`` (the rows with the least hash of their ids, so the same at
every run); every other step covers all rows. Trees have one depth and are stored as flat arrays (feature
and bin edge of each inner node, value of each leaf), so that all trees are walked at once, one array step a level.

Cases: null and empty texts have statistics (all 0) and a score like any other; labels or ids that are null
are not learnt from; a document with several labels counts with the lowest; without labels of both kinds
every score is the share of label 1 (0.5 if there are none); rows that repeat a doc_id are scored each for
itself; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read, and of labels
``doc_id`` and ``quality``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm.shared import slices, table, text_bytes
from wayfield.llm.words import _BYTE, SPACE, span_hashes, split_words, word_hashes

# Labelled rows that trees are grown on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS = 120, 4, 64
RATE, PENALTY, LEAST_WEIGHT = 0.1, 1.0, 2.0
# A score from which a document counts as good.
GOOD = 0.7


def _of(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_UPPER, _LOW = _of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _of("abcdefghijklmnopqrstuvwxyz")
_DIGIT, _STOP, _COMMA, _BAR, _SIGN = _of("0123456789"), _of(".!?"), _of(",;:"), _of("|"), _of("#$%&*@^~+=<>{}[]\\_`/")
_HIGH = np.arange(256) >= 128
_KINDS = [_UPPER, _LOW, _DIGIT, SPACE, _of("\n"), _STOP, _COMMA, _BAR, _SIGN, _HIGH]

STATISTICS = ["bytes", "words", "lines", "upper", "lower", "digits", "space", "line_feeds", "stops", "commas", "bars", "signs", "high_bytes",
              "word_mean", "word_spread", "word_longest", "short_words", "capital_words", "sign_words", "stop_words", "distinct_words",
              "top_word", "distinct_lines", "line_words"]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of :data:`STATISTICS` for each text; counts as logarithms, the others as shares and means."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    starts, ends, before = split_words(data, offsets)
    words = np.diff(before).astype(np.float64)
    per = lambda x, y: x / np.maximum(y, 1)
    kinds = [_sums(kind[data], offsets) for kind in _KINDS]
    lines = kinds[4] + (size > 0)
    length = (ends - starts).astype(np.float64)
    mean = per(_sums(length, before), words)
    spread = np.sqrt(np.maximum(0, per(_sums(length ** 2, before), words) - mean ** 2))
    longest, distinct, top, lines_apart = (np.zeros(n) for _ in range(4))
    hashes, _ = word_hashes(data, offsets)
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    breaks[1:] |= np.append(data[:-1] == 0x0A, False) if len(data) else False
    line_starts = np.flatnonzero(breaks[:-1])
    line_hashes, line_before = span_hashes(data, line_starts, _BYTE), np.searchsorted(line_starts, offsets)
    for i in range(n):
        own = hashes[before[i]:before[i + 1]]
        if len(own):
            counts = np.unique(own, return_counts=True)[1]
            longest[i], distinct[i], top[i] = length[before[i]:before[i + 1]].max(), len(counts) / len(own), counts.max() / len(own)
        own = line_hashes[line_before[i]:line_before[i + 1]]
        if len(own):
            lines_apart[i] = len(np.unique(own)) / len(own)
    first, last = data[starts], data[ends - 1] if len(ends) else data[:0]
    shares = [per(_sums(x, before), words) for x in (length <= 3, _UPPER[first], (_SIGN | _BAR)[last], _STOP[last])]
    columns = [np.log1p(size), np.log1p(words), np.log1p(lines), *[per(k, size) for k in kinds], mean, spread, longest,
               *shares, distinct, top, lines_apart, per(words, lines)]
    return np.column_stack(columns)


@dataclass(frozen=True)
class Trees:
    """Flat trees: inner node i has the children 2i + 1 and 2i + 2; a value above ``edge`` goes to the second."""

    feature: np.ndarray  # trees x inner nodes
    edge: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float
    labels: int = 0  # rows that the trees were grown on

    def scores(self, rows: np.ndarray) -> np.ndarray:
        margin = np.full(len(rows), self.base)
        if len(self.feature):
            tree = np.arange(len(self.feature))
            for at in range(0, len(rows), 4096):
                part = rows[at:at + 4096]
                node = np.zeros((len(part), len(tree)), np.int64)
                row = np.arange(len(part))[:, None]
                while node[0, 0] < self.feature.shape[1]:
                    node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.edge[tree, node])
                margin[at:at + 4096] += self.leaf[tree, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-margin))


def grow(rows: np.ndarray, label: np.ndarray) -> Trees:
    """Trees by second-order boosting of the logistic loss on binned values, level by level."""
    share = label.mean() if len(label) else 0.5
    none = np.zeros((0, 2 ** DEPTH - 1))
    if len(label) == 0 or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Trees(none.astype(int), none, np.zeros((0, 2 ** DEPTH)), float(np.log(share / (1 - share))), len(label))
    width = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)])
    cells = (np.arange(width) * BINS)[None, :] + binned
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(label), base)
    inner = 2 ** DEPTH - 1
    features, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        slope, weight = label - p, p * (1 - p)
        feature, cut, value = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(2 ** DEPTH)
        node = np.zeros(len(label), np.int64)
        for level in range(DEPTH):
            first, count = 2 ** level - 1, 2 ** level
            at = ((node - first)[:, None] * (width * BINS) + cells).ravel()
            shape = (count, width, BINS)
            g = np.bincount(at, np.repeat(slope, width), count * width * BINS).reshape(shape).cumsum(2)
            h = np.bincount(at, np.repeat(weight, width), count * width * BINS).reshape(shape).cumsum(2)
            whole_g, whole_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g ** 2 / (h + PENALTY) + (whole_g - g) ** 2 / (whole_h - h + PENALTY) - whole_g ** 2 / (whole_h + PENALTY)
            gain[(h < LEAST_WEIGHT) | (whole_h - h < LEAST_WEIGHT)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for i in range(count):
                f, b = divmod(int(best[i]), BINS)
                feature[first + i] = f
                if gain[i, f, b] > 1e-9 and b < len(edges[f]):
                    cut[first + i] = edges[f][b]
            node = 2 * node + 1 + (rows[np.arange(len(node)), feature[node]] > cut[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, slope, 2 ** DEPTH) / (np.bincount(leaf, weight, 2 ** DEPTH) + PENALTY)
        margin += value[leaf]
        features.append(feature), cuts.append(cut), leaves.append(value)
    return Trees(np.array(features), np.array(cuts), np.array(leaves), base, len(label))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from; one without an id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (without its text) and an array of statistics."""
    others = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = statistics(*text_bytes(batch.column("text")))
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in others], arrays], [*[f.name for f in others], "statistics"])

    return docs.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "statistics array<double>"]))


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` of the labelled rows that are not held out."""
    learnt = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # Not more than ``sample`` rows of two numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(learnt), "doc_id").select("quality", "doc_id", "text")
    rows = with_statistics(found).orderBy("doc_id", "quality").limit(sample).toPandas()
    if not len(rows):
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return grow(np.stack(rows["statistics"].to_numpy()), rows["quality"].to_numpy(float))


def score_quality(docs: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, 0 to 1."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = trees.scores(statistics(*text_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def op2_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = learn_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, trees)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
