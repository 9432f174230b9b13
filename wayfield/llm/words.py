"""Words and shingles of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_MULT = _random.integers(1, 2 ** 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 64), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span from one start to the next; bytes with code 0 in ``byte`` don't count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    data, starts = data[starts[0]:], starts - starts[0]
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(byte[data] * _power_table(int(lengths.max()))[place], starts))


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word, and the number of words before each text (one entry more)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = edge[:-1].copy(), edge[1:].copy()
    opens[1:] |= space[:-1]
    closes[:-1] |= space[1:]
    starts, ends = np.flatnonzero(opens & ~space), np.flatnonzero(closes & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z as a-z if ``lower``), and the number of words before each text."""
    starts, _, words = split_words(data, offsets)
    byte = (_LOWER if lower else _BYTE).copy()
    byte[SPACE] = 0
    return span_hashes(data, starts, byte), words


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; the last ``n - 1`` places are left out."""
    total = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        total += h[i:len(h) - n + 1 + i] * _MULT[i]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word shingles.

    A text with fewer words has its whole word sequence as its only shingle, one without words has none.
    """
    h, words = word_hashes(data, offsets)
    whole = grams(h, n)
    out = []
    for a, b in zip(words[:-1], words[1:]):
        if b - a >= n:
            out.append(np.unique(whole[a:b - n + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _MULT[:b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text joined by one blank: all bytes, the first byte of each word, and the bytes before each text.

    ``words`` is the number of words before each text, one entry more than texts. The words may stand in any order in ``data``.
    """
    lengths = ends - starts
    gap = np.ones(len(starts), np.int64)
    gap[words[:-1][np.diff(words) > 0]] = 0
    after = np.cumsum(lengths + gap)
    out = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    first = after - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[place + np.repeat(first, lengths)] = data[place + np.repeat(starts, lengths)]
    return out, first, np.append(0, after)[words]
