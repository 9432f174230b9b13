"""Token ids of whole texts with a tokenizer file of the ``tokenizers`` library.

A text's ids are the ids of its stretches, if the stretches are cut only where no piece of the tokenizer's
own pre-tokenizer can reach across. Stretches repeat a lot, so each worker encodes a stretch once and keeps
its ids; the rest is array work. The cuts hold for byte-level and word-end BPE files that split text into
letters, digits, marks and white space (see :func:`stretches`); tests compare with whole texts.

Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from tokenizers import Tokenizer

from wayfield.llm.shared import ranges
from wayfield.llm.words import _BYTE, span_hashes

# Stretches a worker keeps; beyond, it starts anew.
KEPT = 400_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
# First bytes of characters that can't be white space.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A]] = True


def stretches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of stretches that can be encoded alone.

    Cuts: before the last blank or line feed ahead of a solid character (white space before it is a
    piece of its own, and a blank belongs to what follows), after a line feed ahead of a solid
    character, and between a letter and a mark (a contraction starts with its mark).
    """
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    if len(data) > 1:
        solid = _SOLID[data[1:]]
        cut[:-2] |= _BLANK[data[:-1]] & solid
        cut[1:-1] |= (data[:-1] == 0x0A) & solid | _LETTER[data[:-1]] & _MARK[data[1:]]
    return np.flatnonzero(cut[:-1])


@cache
def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of many texts at once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.lowers = self.tokenizer.normalizer is not None
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _short(self, text: str) -> str | None:
        """The text as one piece for the BPE model, if it is a single word of common letters."""
        if self.lowers:
            text = text.strip(" \n")
            body = text = text.lower() if text and max(text) < "ƀ" and "İ" not in text else ""
        else:
            body = text[1:] if text[:1] == " " else text
        if not body.isalpha() or (self.lowers and not unicodedata.is_normalized("NFC", text)):
            return None
        return text.encode().decode("latin-1").translate(_byte_letters())

    def _learn(self, keys: list[int], texts: list[str]) -> None:
        found: list[list[int]] = [[]] * len(texts)
        rest = []
        model = self.tokenizer.model
        for i, text in enumerate(texts):
            if (short := self._short(text)) is not None:
                found[i] = [t.id for t in model.tokenize(short)]
            else:
                rest.append(i)
        for i, encoded in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
            found[i] = encoded.ids
        counts = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((x for ids in found for x in ids), np.int32, int(counts.sum()))
        at = len(self.slot)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + len(keys) > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        self.ids[self.used:self.used + len(flat)] = flat
        self.counts[at:at + len(keys)] = counts
        self.starts[at:at + len(keys)] = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        self.slot.update(zip(keys, range(at, at + len(keys))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another (int32), and how many ids stand before each text."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts = stretches(data, offsets)
        keys, first, which = np.unique(span_hashes(data, starts, _BYTE), return_index=True, return_inverse=True)
        if len(self.slot) + len(keys) > KEPT:
            self._clear()
        names = keys.tolist()
        slots = np.fromiter((self.slot.get(k, -1) for k in names), np.int64, len(names))
        if len(new := np.flatnonzero(slots < 0)):
            ends = np.append(starts[1:], len(data))
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            at, whole = len(self.slot), data.tobytes()
            self._learn([names[i] for i in new], [whole[a:b].decode("utf-8", "replace") for a, b in spans])
            slots[new] = np.arange(at, at + len(new))
        slots = slots[which]
        counts = self.counts[slots].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[ranges(self.starts[slots], counts)], before[np.searchsorted(starts, offsets)]


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    return Encoder(path)


def with_end(ids: np.ndarray, before: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the id ``end`` to each text."""
    out = np.insert(ids, before[1:], end)
    return out, before + np.arange(len(before))


def narrow(size: int) -> np.dtype:
    """The smallest little-endian type for ids below ``size``."""
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
