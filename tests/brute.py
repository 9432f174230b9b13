"""Small plain-Python answers the operators are checked against."""

from __future__ import annotations

import heapq
import math

from fractions import Fraction

from wayfield.schema import GridMeta


def grid(spark, rows, res=10.0):
    """Cells and grid of a nested list of elevations (None for no data)."""
    meta = GridMeta(len(rows), len(rows[0]), 0.0, res * len(rows), res, -res, "local")
    data = [(r * meta.ncols + c, r, c, None if z is None else float(z))
            for r, row in enumerate(rows) for c, z in enumerate(row)]
    return spark.createDataFrame(data, "cell_id long, row int, col int, z double"), meta


def hours(dh, dz, cap="speed"):
    arg = 3.5 * abs(dz / dh + 0.05)
    if cap == "speed":
        return dh / 1000 / max(6 * math.exp(-arg), 1e-12)
    return dh / 6000 * math.exp(min(arg, 80))


def steps(k):
    """Steps by their squared length."""
    lengths = {8: (1, 2), 16: (1, 2, 5), 24: (1, 2, 4, 5, 8), 32: (1, 2, 4, 5, 8, 10), 64: range(1, 19)}[k]
    return [(dr, dc) for dr in range(-3, 4) for dc in range(-3, 4) if dr * dr + dc * dc in lengths]


def edges(rows, meta, k, mult=None, cap="speed"):
    out = {}
    for r, row in enumerate(rows):
        for c, z in enumerate(row):
            here = out.setdefault(r * meta.ncols + c, [])
            for dr, dc in steps(k):
                rr, cc = r + dr, c + dc
                if 0 <= rr < meta.nrows and 0 <= cc < meta.ncols and z is not None and rows[rr][cc] is not None:
                    to = rr * meta.ncols + cc
                    w = hours(math.hypot(dr * meta.res_y, dc * meta.res_x), rows[rr][cc] - z, cap)
                    here.append((to, w * (mult or {}).get(to, 1.0)))
    return out


def distances(graph, source):
    best, queue, done = {source: 0.0}, [(0.0, source)], set()
    while queue:
        d, v = heapq.heappop(queue)
        if v in done:
            continue
        done.add(v)
        for u, w in graph[v]:
            if d + w < best.get(u, math.inf):
                best[u] = d + w
                heapq.heappush(queue, (d + w, u))
    return best


def predecessors(graph, best):
    ways = {}
    for v, d in best.items():
        for u, w in graph[v]:
            if d < best[u]:
                ways.setdefault(u, []).append((round((d + w) * 1e9), v))
    return {u: min(options)[1] for u, options in ways.items()}


def path(pred, source, dest):
    cells = [dest]
    while cells[-1] != source:
        cells.append(pred[cells[-1]])
    return cells[::-1]


def walk(c1, r1, c2, r2):
    """The cells nearest to the ideal line, one for each step along its longer side; halfway, that nearer the start."""
    longest = max(abs(c2 - c1), abs(r2 - r1), 1)

    def at(start, end, i):
        way = math.ceil(Fraction(abs(end - start) * i, longest) - Fraction(1, 2))
        return start + way if end > start else start - way

    return [(at(c1, c2, i), at(r1, r2, i)) for i in range(max(abs(c2 - c1), abs(r2 - r1)) + 1)]


def box(counts, meta, b, fold):
    out = {}
    for cell, n in counts.items():
        r, c = divmod(cell, meta.ncols)
        for rr in range(max(0, r - b), min(meta.nrows, r + b + 1)):
            for cc in range(max(0, c - b), min(meta.ncols, c + b + 1)):
                to = rr * meta.ncols + cc
                out[to] = fold(out[to], n) if to in out else n
    return out
