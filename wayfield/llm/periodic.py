"""Periodic runs: stretches of words that repeat with a period, found along the diagonals of a text.

The lag q has a diagonal of matches: word i matches if it equals word i - q. Going through a text from left to
right, the earlier occurrences of each word lengthen the matches of their lags; when the match of a lag ends
and is long enough, its run is emitted. Three facts keep this sparse and exact, however often a word occurs:

1. A run has at least ``times`` >= 3 periods. So its words also match in *windows*: for a period of k / 2 < q <= k, some
   window of k words and the one q earlier lie in the run. (For the narrowest width k, any q <= k and ``least`` >= 2k.)
2. If q is the run's smallest period, the window's *nearest* earlier occurrence is at the lag q: a nearer one
   would mean a smaller period. So each word lengthens one diagonal only for each of the widths 8, 16, 32, ...
3. Neighbouring words on the same diagonal are one match; where the lag changes, the match has ended, and the
   words that it spans are a run that neither neighbour extends. Its period is its smallest one.

The work is n log n for n words, also where one word or line fills the text. Texts are cut at no place; batches of
texts are handled at once as arrays, and words that recur in no window leave after the first width. Windows are
compared by 64-bit hashes within their text.

Cases: null, empty and blank texts have no words and no run, and their collapsed text is empty; rows that repeat an id
are judged each by its own text; a null doc_id is kept; an empty table gives an empty result. Only ``doc_id`` and
``text`` are read, so columns of other names don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm.shared import ranges, slices, table, text_bytes
from wayfield.llm.words import joined_words, mix, split_words, word_hashes

LEAST, TIMES = 24, 3
SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs array<struct<start:long, length:long, period:long>>, collapsed string")
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _wider(g: np.ndarray, k: int) -> np.ndarray:
    """Hashes of windows of 2k words from those of k words; the last k places of the array have none."""
    return mix(g[:-k] * _LEFT + (g[k:] * _RIGHT ^ (g[k:] >> np.uint64(29)))) if len(g) > k else g[:0]


def _recurring(g: np.ndarray) -> np.ndarray:
    """True where a hash may stand more than once; false where it surely does not."""
    bits = max(10, int(len(g)).bit_length() + 2)
    slot = (g >> np.uint64(64 - bits)).astype(np.int64)
    return np.bincount(slot, minlength=1 << bits)[slot] > 1


def find_runs(h: np.ndarray, words: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """``text, start, length, period`` of all runs, by text, start and period.

    ``h`` are the hashes of the words of all texts, ``words`` the number of words before each text (one entry more).
    """
    if times < 3 or least < 4:
        raise ValueError("runs are found from 3 periods and 4 words on")
    k = 1 << (least // 2).bit_length() - 1
    sizes = np.diff(words)
    number = np.arange(len(sizes))
    g, width = h, 1
    while width < k:
        g, width = _wider(g, width), 2 * width
    doc = np.repeat(number, sizes)[:len(g)]
    at = np.arange(len(g))
    at = at[at + k <= words[doc + 1]]
    at = at[_recurring(g[at])]
    offset, found, low = words[:-1], [], 0
    while len(at):
        # Nearest earlier occurrence of each window in its text.
        key = mix(g[at] + doc[at].astype(np.uint64) * _RIGHT)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        lag = np.zeros(len(at), np.int64)
        lag[order[1:][same]] = at[order[1:][same]] - at[order[:-1][same]]
        on = (lag > low) & (lag <= k)
        place, q = at[on], lag[on]
        if len(place):
            # A match goes on while the next word is on the same diagonal.
            first = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (np.diff(q) != 0)))
            last = np.append(first[1:], len(place)) - 1
            start, period = place[first] - q[first], q[first]
            length = place[last] + k - start
            good = length >= np.maximum(least, times * period)
            text = doc[start[good]]
            found.append((number[text], start[good] - offset[text], length[good], period[good]))
        # A wider window can only recur where this one does, and only a long text has room for its period.
        at = at[again & (sizes[doc[at]] >= times * (k + 1))]
        if not len(at):
            break
        kept = np.unique(doc[at])
        shift = np.cumsum(sizes[kept]) - sizes[kept]
        new = np.searchsorted(kept, doc[at])
        at = at - offset[kept][new] + shift[new]
        inside = ranges(offset[kept], sizes[kept])
        full = np.append(g, np.zeros(int(offset[-1] + sizes[-1]) - len(g), np.uint64))[inside]
        number, sizes, offset = number[kept], sizes[kept], shift
        doc = np.repeat(np.arange(len(kept)), sizes)
        g = _wider(full, k)
        low, k = k, 2 * k
        at = at[at + k <= (offset + sizes)[doc[at]]]
    text, start, length, period = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def longest(text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """For each text with runs the row of the one with the greatest length / period; ties go to the smallest start, then period."""
    order = np.lexsort((period, start, -(length / period), text))
    return order[np.append(True, np.diff(text[order]) != 0)] if len(order) else order


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES,
                  reorder: Callable[[pa.Array, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The runs of every text of ``docs(doc_id, text)`` and the text without its repeats, one row per row.

    A run is a stretch of words that repeats with its smallest period, is at least ``least`` words and ``times`` periods
    long, and cannot be extended. ``runs`` has all of them by start and period; ``start, length, period,
    exponent_milli`` belong to the one with most periods and are null without one. ``collapsed`` has the words that no run
    holds after its first period, joined by one blank. ``reorder(ids, words)`` may say which word stands at each place.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, words = split_words(data, offsets)
            h, _ = word_hashes(data, offsets, lower=False)
            if reorder is not None:
                place = reorder(batch.column("doc_id"), words)
                h, starts, ends = h[place], starts[place], ends[place]
            text, start, length, period = find_runs(h, words, least, times)
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, words[text] + start + period, 1)
            np.add.at(edge, words[text] + start + length, -1)
            keep = np.cumsum(edge[:-1]) == 0
            left = np.append(0, np.cumsum(keep))[words]
            joined, _, bounds = joined_words(data, starts[keep], ends[keep], left)
            n, n_runs = batch.num_rows, np.bincount(text, minlength=batch.num_rows)
            best = np.full(n, -1)
            top = longest(text, start, length, period)
            best[text[top]] = top
            none = best < 0
            values = [pa.array(np.append(x, 0)[best], mask=none) for x in (start, length, period, 1000 * length // np.maximum(period, 1))]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_runs)).astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(x) for x in (start, length, period)], ["start", "length", "period"]))
            collapsed = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(joined)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(words)), pa.array(n_runs), *values, lists, collapsed.cast(pa.string())],
                ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def every_tenth_periodic(ids: pa.Array, words: np.ndarray) -> np.ndarray:
    """Which word stands at each place when one in ten texts, by a checksum of its id, goes on periodically from some word on."""
    place = np.arange(words[-1])
    for i, (doc, first, end) in enumerate(zip(ids.to_pylist(), words[:-1].tolist(), words[1:].tolist())):
        n = end - first
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            place[first + a:end] = first + a + np.arange(n - a) % p
    return place


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), reorder=every_tenth_periodic)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP12_SQL = """
WITH RECURSIVE given AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, doc_id::VARCHAR AS digits FROM documents),
steps AS (  -- the bytes of the id, each followed by eight shifts
  SELECT doc_id, w, len(w) AS n, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(digits, '')]) AS s FROM given),
hashed AS (
  SELECT doc_id, w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, s),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h FROM steps),
planned AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS e FROM hashed),
texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + e)) END] FOR i IN range(n)] ELSE w END AS w FROM planned),
words AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM texts),
matches AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM matches),
stretches AS (
  SELECT doc_id, min(i) - q AS start, count(*) + q AS length, q FROM islands GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
said AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         arg_min({'start': start, 'length': length, 'period': period}, {'e': -length::DOUBLE / period, 's': start, 'p': period}) AS best
  FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
left_over AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS collapsed FROM words w ANTI JOIN dropped d ON d.doc_id = w.doc_id AND d.i = w.i GROUP BY w.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
       (1000 * best.length // best.period)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts t LEFT JOIN said USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
