"""Progressive JPEG files as coefficient arrays, many at a time.

The decoder accumulates all scans (spectral selection and successive approximation) of a batch of files into one
array of blocks x 64 coefficients in zigzag order. Stretches between restart markers are independent: they are the
lanes of the array steps, whatever file they come from. Files without restart markers are right but slow.
The encoder writes 4:2:0 files with restart markers; both keep the coefficients exactly.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np

RESTART = 4
U64 = np.uint64


@cache
def zigzag() -> np.ndarray:
    """Place (8 * row + column) of each coefficient in zigzag order: along the diagonals, turning at each."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return np.array([8 * r + c for r, c in sorted(cells, key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))])


def code_lengths(weights: dict[int, float]) -> list[tuple[int, int]]:
    """(length, symbol) of a Huffman code without the all-ones word and with at most 16 bits, shortest first."""
    floor_ = sum(weights.values()) / 2 ** 14
    heap = [(max(w, floor_), s, [s]) for s, w in weights.items()] + [(0.0, 1 << 20, [-1])]
    depth: dict[int, int] = defaultdict(int)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            depth[s] += 1
        heapq.heappush(heap, (a + b, min(i, j), x + y))
    return sorted((n, s) for s, n in depth.items() if s >= 0)


def table_segment(kind: int, number: int, lengths: list[tuple[int, int]]) -> bytes:
    counts = [sum(n == k for n, _ in lengths) for k in range(1, 17)]
    return segment(0xC4, bytes([kind << 4 | number, *counts, *[s for _, s in lengths]]))


def segment(marker: int, content: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(content) + 2).to_bytes(2, "big") + content


@cache
def lookup(content: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length, and symbol << 8; from a table's counts and symbols."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(content[length - 1]):
            out[code << (16 - length):(code + 1) << (16 - length)] = length | content[at] << 8
            code, at = code + 1, at + 1
        code <<= 1
    return out


def codes(lengths: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Code word and length by symbol."""
    word, bits, code, last = np.zeros(256, U64), np.zeros(256, np.int64), 0, 0
    for n, s in lengths:
        code <<= n - last
        word[s], bits[s], last = code, n, n
        code += 1
    return word, bits


# --- reading ---

@dataclass
class Scan:
    components: list[int]
    start: int
    end: int
    high: int
    low: int
    tables: list[tuple[bytes, bytes]]
    data: tuple[int, int]
    restart: int


@dataclass
class Image:
    width: int = 0
    height: int = 0
    sampling: list[tuple[int, int]] = field(default_factory=list)
    quant: list[np.ndarray] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""
    first_block: list[int] = field(default_factory=list)

    @property
    def shape(self) -> tuple:
        return self.width, self.height, tuple(self.sampling)

    def grid(self, c: int) -> tuple[int, int]:
        return _grids(self.shape)[c]

    def order(self, components: list[int]) -> tuple[np.ndarray, int]:
        """Blocks in the order of a scan, and how many make a unit between which restarts may stand."""
        blocks, unit = _order(self.shape, tuple(components))
        return blocks + self.first_block[0], unit


@lru_cache(maxsize=4096)
def _grids(shape: tuple) -> list[tuple[int, int]]:
    """Rows and columns of blocks of each component, whole units of the frame."""
    width, height, sampling = shape
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    rows, columns = -(-height // (8 * most_v)), -(-width // (8 * most_h))
    return [(rows * v, columns * h) for h, v in sampling]


@lru_cache(maxsize=4096)
def _order(shape: tuple, components: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """:meth:`Image.order` for an image whose blocks begin at 0."""
    width, height, sampling = shape
    grids = _grids(shape)
    first = np.cumsum([0] + [r * c for r, c in grids])
    if len(components) > 1:
        parts = []
        for c in components:
            (h, v), (rows, columns) = sampling[c], grids[c]
            at = np.arange(rows * columns).reshape(rows // v, v, columns // h, h).transpose(0, 2, 1, 3)
            parts.append(at.reshape(-1, v * h) + first[c])
        blocks = np.concatenate(parts, 1)
        return blocks.ravel(), blocks.shape[1]
    c = components[0]
    (h, v), most_h, most_v = sampling[c], max(h for h, _ in sampling), max(v for _, v in sampling)
    rows, used = -(-(height * v) // (8 * most_v)), -(-(width * h) // (8 * most_h))
    return (np.arange(rows)[:, None] * grids[c][1] + np.arange(used)).ravel() + first[c], 1


@lru_cache(maxsize=256)
def _huffman(body: bytes) -> dict[int, bytes]:
    out = {}
    while body:
        n = 17 + sum(body[1:17])
        out[body[0]] = body[1:n]
        body = body[n:]
    return out


@lru_cache(maxsize=256)
def _quant(body: bytes) -> dict[int, np.ndarray]:
    out = {}
    while body:
        wide = body[0] >> 4
        out[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
        body = body[1 + 64 * (1 + wide):]
    return out


def parse(content: bytes) -> Image:
    """Headers and scans of a file; ValueError if it isn't a progressive JPEG."""
    if content[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    raw = np.frombuffer(content, np.uint8)
    mark = np.flatnonzero(raw[:-1] == 0xFF)
    following = raw[mark + 1]
    ends = mark[(following != 0) & (following != 0xFF) & ((following < 0xD0) | (following > 0xD7))]
    image, quant, huffman, names, restart, at = Image(), {}, {}, [], 0, 2
    which: list[int] = []
    while at + 4 <= len(content):
        marker, size = content[at + 1], int.from_bytes(content[at + 2:at + 4], "big")
        body = content[at + 4:at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quant |= _quant(body)
        elif marker == 0xC4:
            huffman |= _huffman(body)
        elif marker == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for i in range(body[5]):
                name, hv, q = body[6 + 3 * i:9 + 3 * i]
                names.append(name), image.sampling.append((hv >> 4, hv & 15)), which.append(q)
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xD0)):
            raise ValueError("not a progressive JPEG")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            image.comment = bytes(body)
        elif marker == 0xDA:
            n = body[0]
            parts = [(names.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            later = ends[np.searchsorted(ends, at):]
            stop = int(later[0]) if len(later) else len(content)
            tables = [(huffman.get(t >> 4, b""), huffman.get(16 | t & 15, b"")) for _, t in parts]
            image.scans.append(Scan([c for c, _ in parts], body[-3], body[-2], body[-1] >> 4, body[-1] & 15, tables, (at, stop), restart))
            at = stop
            if content[at + 1:at + 2] == b"\xd9":
                break
    if not image.sampling or not image.width or not image.height:
        raise ValueError("no progressive frame")
    image.quant = [quant[q] for q in which]
    return image


class Lanes:
    """Bit positions of independent stretches of entropy-coded data."""

    def __init__(self, pieces: list[np.ndarray], orders: list[tuple[np.ndarray, int]], restarts: list[int]):
        data = np.concatenate(pieces)
        bounds = np.cumsum([0] + [len(p) for p in pieces])
        ff = np.flatnonzero(data[:-1] == 0xFF)
        following = data[ff + 1]
        marks = ff[(following >= 0xD0) & (following <= 0xD7)]
        keep = np.ones(len(data), bool)
        keep[ff[following == 0] + 1] = False
        keep[marks] = keep[marks + 1] = False
        place = np.concatenate([[0], np.cumsum(keep)])
        starts = np.sort(np.concatenate([bounds[:-1], marks + 2]))
        self.at = place[starts] * 8
        plain = np.concatenate([data[keep], np.full(16, 0xFF, np.uint8)])
        n = len(plain) - 7
        window = np.zeros(n, U64)
        for i in range(8):
            window |= plain[i:i + n].astype(U64) << U64(56 - 8 * i)
        self.window = window
        blocks, first, count, base = [], [], [], 0
        for (order, unit), restart, lanes in zip(orders, restarts, np.diff(np.searchsorted(starts, bounds))):
            step = restart * unit if restart else len(order)
            begin = np.arange(0, max(len(order), 1), step)[:lanes]
            begin = np.concatenate([begin, np.full(lanes - len(begin), len(order))])
            first.append(base + begin)
            count.append(np.minimum(step, len(order) - begin))
            blocks.append(order)
            base += len(order)
        self.blocks, self.first, self.count = np.concatenate(blocks), np.concatenate(first), np.concatenate(count)
        self.end = len(plain) * 8 - 64

    def ahead(self, at: np.ndarray) -> np.ndarray:
        """The bits from each position on, at the top of 64 (57 are valid)."""
        at = np.minimum(at, self.end)
        return self.window[at >> 3] << (at & 7).astype(U64)


def _bits(x: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` bits after the first ``skip``."""
    return ((x << skip.astype(U64)) >> U64(1) >> (63 - n).astype(U64)).astype(np.int64)


def _signed(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)


def _dc_first(lanes: Lanes, coefficients: np.ndarray, components: np.ndarray, tables: list[np.ndarray], low: int) -> None:
    at, before = lanes.at.copy(), np.zeros((len(lanes.at), int(components.max()) + 1), np.int64)
    for i in range(int(lanes.count.max())):
        on = np.flatnonzero(lanes.count > i)
        component = components[i % len(components)]
        x = lanes.ahead(at[on])
        entry = tables[component][x >> U64(48)]
        length, size = entry & 255, entry >> 8
        before[on, component] += _signed(_bits(x, length, size), size)
        coefficients[lanes.blocks[lanes.first[on] + i], 0] = before[on, component] << low
        at[on] += length + size


def _dc_next(lanes: Lanes, coefficients: np.ndarray, low: int) -> None:
    for i in range(int(lanes.count.max())):
        on = np.flatnonzero(lanes.count > i)
        bit = (lanes.ahead(lanes.at[on] + i) >> U64(63)).astype(np.int64)
        coefficients[lanes.blocks[lanes.first[on] + i], 0] |= bit << low


def _ac_first(lanes: Lanes, coefficients: np.ndarray, table: np.ndarray, start: int, end: int, low: int) -> None:
    flat = coefficients.reshape(-1)
    on = np.flatnonzero(lanes.count > 0)
    at, block, last = lanes.at[on].copy(), lanes.first[on].copy(), (lanes.first + lanes.count)[on]
    k = np.full(len(on), start)
    base = lanes.blocks[block] * 64
    while len(at):
        x = lanes.ahead(at)
        entry = table[x >> U64(48)]
        length, symbol = entry & 255, entry >> 8
        run, size = symbol >> 4, symbol & 15
        ends = (size == 0) & (run < 15)
        extra = _bits(x, length, np.where(ends, run, size))
        at += length + np.where(ends, run, size)
        k += run
        put = np.flatnonzero((size > 0) & (k <= end))
        flat[base[put] + k[put]] = _signed(extra[put], size[put]) << low
        k += 1
        done = np.flatnonzero(ends | (k > end) | (length == 0))
        if len(done):
            block[done] += 1 + np.where(ends[done], (1 << run[done]) - 1 + extra[done], 0)
            k[done] = start
            if (block[done] >= last[done]).any():
                more = block < last
                at, block, last, k = at[more], block[more], last[more], k[more]
                base = lanes.blocks[block] * 64
            else:
                base[done] = lanes.blocks[block[done]] * 64


def _ac_next(lanes: Lanes, coefficients: np.ndarray, table: np.ndarray, start: int, end: int, low: int) -> None:
    n = len(lanes.at)
    at, run, put, to_end, skip = lanes.at.copy(), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
    for i in range(int(lanes.count.max())):
        own = lanes.count > i
        block = lanes.blocks[np.minimum(lanes.first + i, len(lanes.blocks) - 1)]
        to_end, run = skip > 0, np.full(n, -1)
        skip = np.maximum(0, skip - 1)
        for k in range(start, end + 1):
            ask = np.flatnonzero(own & ~to_end & (run < 0))
            x = lanes.ahead(at[ask])
            entry = table[x >> U64(48)]
            length, symbol = entry & 255, entry >> 8
            r, s = symbol >> 4, symbol & 15
            ends = (s == 0) & (r < 15)
            extra = _bits(x, length, np.where(ends, r, s))
            at[ask] += length + np.where(ends, r, s)
            skip[ask] = np.where(ends, (1 << r) + extra - 1, skip[ask])
            to_end[ask] = ends
            run[ask] = np.where(ends, -1, r)
            put[ask] = np.where(s > 0, np.where(extra > 0, 1, -1) << low, 0)
            value = coefficients[block, k]
            known = np.flatnonzero(own & (value != 0))
            bit = (lanes.ahead(at[known]) >> U64(63)).astype(np.int64)
            at[known] += 1
            coefficients[block[known], k] += (np.sign(value[known]) * (bit << low)).astype(coefficients.dtype)
            new = np.flatnonzero(own & (value == 0) & ~to_end)
            here = new[run[new] == 0]
            coefficients[block[here], k] = put[here]
            run[new] -= 1


def decode(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Images and the coefficients of all their blocks; ``first_block`` of an image says where a component's blocks begin."""
    images, total = [], 0
    for content in files:
        image = parse(content)
        for c in range(len(image.sampling)):
            rows, columns = image.grid(c)
            image.first_block.append(total)
            total += rows * columns
        images.append(image)
    coefficients = np.zeros((total, 64), np.int32)
    # Scans of one kind and place in the files are read together.
    for i in range(max((len(x.scans) for x in images), default=0)):
        kinds: dict[tuple, list[tuple[Image, bytes, Scan]]] = defaultdict(list)
        for image, content in zip(images, files):
            if i < len(image.scans):
                s = image.scans[i]
                shape = tuple((c, *image.sampling[c]) for c in s.components) if s.start == 0 else ()
                kinds[s.start, s.end, s.high, s.low, tuple(s.tables), shape].append((image, content, s))
        for (start, end, high, low, tables, shape), found in kinds.items():
            pieces = [np.frombuffer(content, np.uint8, s.data[1] - s.data[0], s.data[0]) for _, content, s in found]
            lanes = Lanes(pieces, [image.order(s.components) for image, _, s in found], [s.restart for _, _, s in found])
            if start:
                (_ac_next if high else _ac_first)(lanes, coefficients, lookup(tables[0][1]), start, end, low)
            elif high:
                _dc_next(lanes, coefficients, low)
            else:
                members = [j for j, (_, h, v) in enumerate(shape) for _ in range(h * v)] if len(shape) > 1 else [0]
                _dc_first(lanes, coefficients, np.array(members), [lookup(t[0]) for t in tables], low)
    return images, coefficients


@cache
def _basis() -> np.ndarray:
    """Coefficients in zigzag order to 8 x 8 samples."""
    x = np.arange(8)
    wave = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("ru,cv->uvrc", wave, wave).reshape(64, 64)[zigzag()]


def planes(image: Image, coefficients: np.ndarray) -> list[np.ndarray]:
    """Red, green and blue at full resolution: inverse transform, chroma repeated, colours converted."""
    samples, parts = _basis(), []
    most_h, most_v = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
    for c, (h, v) in enumerate(image.sampling):
        rows, columns = image.grid(c)
        first = image.first_block[c]
        blocks = (coefficients[first:first + rows * columns] * image.quant[c]) @ samples
        parts.append(blocks.astype(np.float32).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8))

    def whole(plane: np.ndarray, c: int) -> np.ndarray:
        h, v = image.sampling[c]
        plane = plane.repeat(most_v // v, 0) if most_v > v else plane
        plane = plane.repeat(most_h // h, 1) if most_h > h else plane
        return plane[:image.height, :image.width]

    # Half for rounding, and a little that settles ties whatever the order in which sums were taken.
    y = whole(parts[0], 0) + np.float32(128.501)
    if len(parts) < 3:
        return [np.clip(y, 0, 255).astype(np.uint8)] * 3
    b, r = parts[1], parts[2]
    same = image.sampling[1] == image.sampling[2]
    green = [whole(np.float32(0.344136) * b + np.float32(0.714136) * r, 1)] if same else [whole(np.float32(0.344136) * b, 1), whole(np.float32(0.714136) * r, 2)]
    colours = [y + whole(np.float32(1.402) * r, 2), sum((-g for g in green), y), y + whole(np.float32(1.772) * b, 1)]
    return [np.clip(c, 0, 255, out=c).astype(np.uint8) for c in colours]


def rgb(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """The image as a tensor, height x width x 3 bytes."""
    return np.stack(planes(image, coefficients), 2)


# --- writing ---

def _weights(zero: float, sizes: list[float], end: float) -> dict[int, float]:
    out = {r << 4 | s + 1: zero ** r * w for r in range(16) for s, w in enumerate(sizes)}
    return out | {0x00: end, 0xF0: zero ** 16}


@cache
def _tables() -> tuple[list[tuple[int, int]], ...]:
    """DC, AC of the first band, AC of the second band, AC refinements."""
    return (code_lengths({s: w for s, w in enumerate([0.12, 0.12, 0.2, 0.24, 0.2, 0.06, 0.03, 0.02, 0.01, 0.005])}),
            code_lengths(_weights(0.36, [0.3, 0.25, 0.06, 0.02, 0.01, 0.005, 0.003, 0.001], 0.01)),
            code_lengths(_weights(0.17, [0.17, 0.3, 0.26, 0.07, 0.02, 0.01, 0.005, 0.003], 0.005)),
            code_lengths({r << 4 | 1: 0.5 ** (r + 1) for r in range(16)} | {0x00: 0.3, 0xF0: 0.5 ** 17}))


class Bits:
    """Entropy-coded stretches of one scan of many files: codes row by row, a row for each lane."""

    @staticmethod
    def bytes_of(word: np.ndarray, bits: np.ndarray, lanes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all lanes, stuffed and with restart markers, and where each lane begins (one entry more).

        ``word, bits`` are codes in order, ``lanes`` says where each lane's codes begin (one entry more) and ``last``
        which lanes are the last of a scan, of whose file's lanes the markers count.
        """
        total = np.concatenate([[0], np.cumsum(bits)])
        used = total[lanes[1:]] - total[lanes[:-1]]
        size = -(-used // 8)
        begin = np.concatenate([[0], np.cumsum(size)]) * 8
        of = np.repeat(np.arange(len(used)), np.diff(lanes))
        at = total[:-1] + (begin[:-1] - total[lanes[:-1]])[of]
        # Ones fill the last byte of a lane.
        fill = size * 8 - used
        at = np.concatenate([at, begin[:-1] + used])
        word = np.concatenate([word, (U64(1) << fill.astype(U64)) - U64(1)])
        bits = np.concatenate([bits, fill])
        place, shift = at >> 6, 64 - (at & 63) - bits
        words = np.zeros(int(begin[-1] // 64) + 2, U64)
        head = np.where(shift >= 0, word << np.maximum(shift, 0).astype(U64), word >> np.maximum(-shift, 0).astype(U64))
        over = np.flatnonzero(shift < 0)
        n = len(used)
        for p, w in ((place[:-n], head[:-n]), (place[-n:], head[-n:]), (place[over] + 1, word[over] << (64 + shift[over]).astype(U64))):
            order = p if len(p) < 2 or (np.diff(p) >= 0).all() else None
            if order is None:
                sort = np.argsort(p, kind="stable")
                p, w = p[sort], w[sort]
            if len(p):
                new = np.flatnonzero(np.append(True, np.diff(p) > 0))
                words[p[new]] |= np.bitwise_or.reduceat(w, new)
        plain = words.astype(">u8").view(np.uint8)[:begin[-1] // 8]
        # A zero after each 0xFF, and a marker after each lane but the last of a scan.
        full = plain == 0xFF
        place = np.cumsum(1 + full) - 1 - full
        marks = np.cumsum(np.where(last, 0, 2))
        edges = begin // 8
        place += np.repeat(np.concatenate([[0], marks[:-1]]), size)
        stuffed = np.concatenate([[0], np.cumsum(full)])[edges]
        starts = edges + stuffed + np.concatenate([[0], marks])
        out = np.zeros(int(starts[-1]), np.uint8)
        out[place] = plain
        between = np.flatnonzero(~last)
        numbers = np.arange(len(last)) - np.maximum.accumulate(np.where(np.append(True, last[:-1]), np.arange(len(last)), 0))
        out[starts[between + 1] - 2], out[starts[between + 1] - 1] = 0xFF, 0xD0 + numbers[between] % 8
        return out, starts


# Bits of a magnitude, and the bits that tell a value from others of as many bits.
_SIZES = np.array([int(x).bit_length() for x in range(1024)], np.int16)
_EXTRA = np.array([x if x >= 0 else x + (1 << (-x).bit_length()) - 1 for x in range(-1023, 1024)], np.int16)


def _size(x: np.ndarray) -> np.ndarray:
    return _SIZES[np.abs(x)]


def _extra(x: np.ndarray) -> np.ndarray:
    return _EXTRA[x + 1023].astype(U64)


def _ac_codes(values: np.ndarray, table: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of first AC scans: a column for each coefficient of the band and one for the end of the block."""
    word, length = codes(table)
    n, width = values.shape
    values, column = values.astype(np.int16), np.arange(width, dtype=np.int16)
    set_ = values != 0
    before = np.maximum.accumulate(np.where(set_, column, np.int16(-1)), 1)
    run = column - 1 - np.concatenate([np.full((n, 1), -1, np.int16), before[:, :-1]], 1)
    size = _size(values)
    symbol = np.where(set_, (run & 15) << 4 | size, 0)
    bits = np.zeros((n, width + 1), np.int64)
    out = np.zeros((n, width + 1), U64)
    bits[:, :-1] = np.where(set_, length[symbol] + size, 0)
    out[:, :-1] = np.where(set_, word[symbol] << size.astype(U64) | _extra(values), U64(0))
    for row, col in zip(*np.nonzero(set_ & (run > 15))):
        for _ in range(int(run[row, col]) >> 4):
            out[row, col] |= word[0xF0] << U64(bits[row, col])
            bits[row, col] += length[0xF0]
    ends = before[:, -1] < width - 1
    bits[ends, -1], out[ends, -1] = length[0], word[0]
    return out, bits


def _ac_next_codes(values: np.ndarray, table: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the last AC refinement: bands of at most 15 coefficients, so that a run never needs more than its symbol.

    Bits of known coefficients follow the symbol under whose run they fall.
    """
    word, length = codes(table)
    n, width = values.shape
    known, new = np.abs(values) > 1, np.abs(values) == 1
    out, bits = np.zeros((n, width + 1), U64), np.zeros((n, width + 1), np.int64)
    tail, tail_bits, run = np.zeros(n, U64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    low = (np.abs(values) & 1).astype(U64)
    for k in range(width):
        at = new[:, k]
        symbol = run << 4 | 1
        code = word[symbol] << U64(1) | (values[:, k] > 0).astype(U64)
        out[:, k] = np.where(at, code << tail_bits.astype(U64) | tail, U64(0))
        bits[:, k] = np.where(at, length[symbol] + 1 + tail_bits, 0)
        tail = np.where(known[:, k], tail << U64(1) | low[:, k], np.where(at, U64(0), tail))
        tail_bits = np.where(known[:, k], tail_bits + 1, np.where(at, 0, tail_bits))
        run = np.where(at, 0, run + (~known[:, k] & ~at))
    ends = (run > 0) | (tail_bits > 0)
    out[:, -1] = np.where(ends, word[0] << tail_bits.astype(U64) | tail, U64(0))
    bits[:, -1] = np.where(ends, length[0] + tail_bits, 0)
    return out, bits


SPLIT = 5


def encode(blocks: np.ndarray, counts: np.ndarray, comments: list[bytes]) -> list[bytes]:
    """A progressive 4:2:0 file for each run of ``counts`` rows of ``blocks`` (64 coefficients in zigzag order).

    Six blocks make a unit of 16 x 16 pixels (four luma, two chroma); missing ones are 0. Scans: DC without its last
    bit, its last bit; AC 1-5 without their last bit, AC 6-63, the last bit of AC 1-5.
    """
    dc, low_ac, high_ac, next_ac = _tables()
    units = np.maximum(1, -(-counts // 6))
    rows = -(-units // 4095)
    columns = -(-units // rows)
    images = []
    base = 0
    spread = np.zeros((int((rows * columns).sum()) * 6, 64), np.int64)
    first = np.cumsum(counts) - counts
    for i in range(len(counts)):
        image = Image(int(columns[i]) * 16, int(rows[i]) * 16, [(2, 2), (1, 1), (1, 1)])
        n = int(rows[i] * columns[i])
        image.first_block = [base, base + 4 * n, base + 5 * n]
        order, _ = image.order([0, 1, 2])
        spread[order[:counts[i]]] = blocks[first[i]:first[i] + counts[i]]
        images.append(image)
        base += 6 * n

    def scan(components: list[int], start: int, end: int, high: int, low: int) -> list[bytes]:
        found = [image.order(components) for image in images]
        unit = found[0][1]
        order = np.concatenate([o for o, _ in found])
        sizes = np.array([len(o) for o, _ in found])
        lane_counts = -(-sizes // (RESTART * unit))
        ends = np.cumsum(lane_counts)
        lane = np.full(ends[-1], RESTART * unit)
        lane[ends - 1] = sizes - (lane_counts - 1) * RESTART * unit
        lane = np.concatenate([[0], np.cumsum(lane)])
        last = np.zeros(len(lane) - 1, bool)
        last[ends - 1] = True
        if start == 0:
            value = spread[order, 0]
            if high:
                word, bits = (value & 1).astype(U64), np.ones(len(value), np.int64)
            else:
                value = value >> 1
                # Each component's difference to its last block in the lane.
                of, inside = np.repeat(np.arange(len(lane) - 1), np.diff(lane)), np.arange(len(value)) - np.repeat(lane[:-1], np.diff(lane))
                back = np.where(inside % 6 < 4, np.where(inside % 6 > 0, 1, 3), 6)
                fresh = (inside < 6) & ((inside == 0) | (inside >= 4))
                diff = value - np.where(fresh, 0, value[np.arange(len(value)) - np.where(fresh, 0, back)])
                size = _size(diff)
                code, length = codes(dc)
                word, bits = code[size] << size.astype(U64) | _extra(diff), length[size] + size
        else:
            value = spread[order, start:end + 1]
            if high:
                word, bits = _ac_next_codes(value, next_ac)
            else:
                word, bits = _ac_codes(np.sign(value) * (np.abs(value) >> low), low_ac if low else high_ac)
            lane = lane * word.shape[1]
            word, bits = word.ravel(), bits.ravel()
        used = np.flatnonzero(bits)
        lane = np.searchsorted(used, lane)
        data, starts = Bits.bytes_of(word[used], bits[used], lane, last)
        edges = starts[np.concatenate([[0], ends])]
        whole, table = data.tobytes(), (0 if start == 0 else 3 if high else 1 if low else 2)
        head = segment(0xDA, bytes([len(components), *[x for c in components for x in (c + 1, table)], start, end, high << 4 | low]))
        return [head + whole[a:b] for a, b in zip(edges[:-1], edges[1:])]

    parts = [scan([0, 1, 2], 0, 0, 0, 1), scan([0, 1, 2], 0, 0, 1, 0)]
    for start, end, high, low in ((1, SPLIT, 0, 1), (SPLIT + 1, 63, 0, 0), (1, SPLIT, 1, 0)):
        parts += [scan([c], start, end, high, low) for c in range(3)]
    tables = b"".join([table_segment(0, 0, dc), table_segment(1, 1, low_ac), table_segment(1, 2, high_ac), table_segment(1, 3, next_ac)])
    ones = segment(0xDB, bytes([0] + [1] * 64))
    frame = bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = []
    for i, image in enumerate(images):
        shape = segment(0xC2, bytes([8]) + image.height.to_bytes(2, "big") + image.width.to_bytes(2, "big") + frame)
        head = [b"\xff\xd8", segment(0xFE, comments[i]), ones, shape, tables, segment(0xDD, RESTART.to_bytes(2, "big"))]
        out.append(b"".join([*head, *[p[i] for p in parts], b"\xff\xd9"]))
    return out
