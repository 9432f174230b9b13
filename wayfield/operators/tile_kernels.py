"""Array arithmetic for one tile, used inside the grouped tasks of the path operators.

A tile owns a square of cells and works on an *area* that laps over its neighbours by some cells,
so that paths weaving along an edge stay inside one area. Around the area lies the ring, as wide
as the stencil reaches. Both are kept as one flat frame with enough spare room at its ends that
adding any step to any position stays inside. Several sources share one array, one frame after
another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from wayfield.functions.costs import ARRAY_MATH, cost_function
from wayfield.functions.offsets import offsets, radius, step_length
from wayfield.schema import GridMeta

# Costs within one tick (hours) of each other count as equal when a predecessor is chosen.
TICKS_PER_HOUR = 1e9
# A path goes through all tiles along a grid, a round each. A grid longer than this many tiles is cut into larger ones: of up to
# TASK_CELLS cells, and of up to TILE_CELLS while there are still too many.
TILES_ALONG = 16
TASK_CELLS = 1 << 18
TILE_CELLS = 1 << 20
# Least side of the tiles of an overlay on a long grid.
CROSSING_TILE = 256


def tile_side(meta: GridMeta, least: int) -> int:
    """Side of the tiles of a path search: ``least``, doubled where the grid has too many of them along its longer side."""
    longer, side = max(meta.nrows, meta.ncols), least
    if longer <= TILES_ALONG * least:
        return least

    def cells(side):
        return min(side, meta.nrows) * min(side, meta.ncols)

    while side < longer and cells(2 * side) <= (TILE_CELLS if longer > TILES_ALONG * side else TASK_CELLS):
        side *= 2
    return side


def many_sources_side(meta: GridMeta, side: int) -> int:
    """Side of the tiles where the groups of sources alone keep all tasks busy: as large as a task can hold.

    Each round relaxes a tile anew for all sources whose costs came in, so the fewer tiles, the less is done twice.
    """
    longer = max(meta.nrows, meta.ncols)
    while side < longer and min(2 * side, meta.nrows) * min(2 * side, meta.ncols) <= TILE_CELLS:
        side *= 2
    return side


def crossing_side(meta: GridMeta, side: int) -> int:
    """Side of the tiles of an overlay, at most ``side``: no larger than it takes to have few of them along the grid.

    What lies between tiles is searched once there, and what lies in a tile again for each source and target.
    """
    least = CROSSING_TILE
    while TILES_ALONG * least < max(meta.nrows, meta.ncols):
        least *= 2
    return min(side, least)


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least ``a[i, k] + b[k, j]`` over all k, for each i and j; a few rows at a time, so that they stay in the cache."""
    out = np.full((len(a), b.shape[1]), np.inf)
    step = max(1, (1 << 15) // max(1, b.shape[1]))
    for at in range(0, len(a), step):
        some, best = a[at:at + step], out[at:at + step]
        value = np.empty_like(best)
        for k in np.flatnonzero(np.isfinite(some).any(axis=0)):
            np.add(some[:, k, None], b[k], out=value)
            np.minimum(best, value, out=best)
    return out


@dataclass(frozen=True)
class Stencil:
    """What a task needs to know about the grid and its moves.

    ``size`` is the least side of a tile; on long grids it is raised, see :func:`tile_side`, unless it is to be taken ``as_given``.
    """

    meta: GridMeta
    k: int = 16
    size: int = 256
    cap: str = "speed"
    cost: str = "tobler"
    lap: int | None = None
    as_given: bool = False

    def __post_init__(self):
        if not self.as_given:
            object.__setattr__(self, "size", tile_side(self.meta, self.size))

    @property
    def tile_cells(self) -> int:
        return min(self.size, self.meta.nrows) * min(self.size, self.meta.ncols)

    @property
    def reach(self) -> int:
        return radius(self.k)

    @property
    def overlap(self) -> int:
        """Cells an area laps over the tile's own square; the neighbour must hold lap and ring."""
        lap = self.size // 16 if self.lap is None else self.lap
        return max(0, min(lap, self.size - self.reach))


class Frame:
    """Positions of one tile."""

    def __init__(self, tile: int, stencil: Stencil):
        meta, size, lap = stencil.meta, stencil.size, stencil.overlap
        self.stencil = stencil
        self.reach = stencil.reach
        self.ncols = meta.ncols
        down, across = divmod(int(tile), -(-meta.ncols // size))
        own_rows = down * size, min((down + 1) * size, meta.nrows)
        own_cols = across * size, min((across + 1) * size, meta.ncols)
        self.row0, self.col0 = max(0, own_rows[0] - lap), max(0, own_cols[0] - lap)
        self.height = min(meta.nrows, own_rows[1] + lap) - self.row0
        self.width = min(meta.ncols, own_cols[1] + lap) - self.col0
        self.stride = self.width + 2 * self.reach
        self.lead = self.reach * self.stride + self.reach
        self.length = (self.height + 2 * self.reach) * self.stride + 2 * self.lead
        self.moves = offsets(stencil.k)
        self.steps = np.array([dr * self.stride + dc for dr, dc in self.moves])
        self.lengths = [step_length(dr, dc, meta) for dr, dc in self.moves]
        rows, cols = np.divmod(np.arange(self.height * self.width), self.width)
        self.area = self.at(rows, cols)
        self.in_area = self._mask(self.area)
        # The tile's own cells, and those of them that lie in the ring of another tile's area.
        rows, cols = rows + self.row0, cols + self.col0
        mine = ((rows >= own_rows[0]) & (rows < own_rows[1]) & (cols >= own_cols[0]) & (cols < own_cols[1]))
        band = np.zeros(len(rows), bool)
        for at, (first, end), last in ((rows, own_rows, meta.nrows), (cols, own_cols, meta.ncols)):
            for depth, open_side in ((at - first, first > 0), (end - 1 - at, end < last)):
                if open_side:
                    band |= (depth >= lap) & (depth < lap + self.reach)
        self.own = self.area[mine]
        self.in_own = self._mask(self.own)
        self.border = self.area[mine & band]

    def _mask(self, positions):
        mask = np.zeros(self.length, bool)
        mask[positions] = True
        return mask

    def at(self, rows, cols):
        return self.lead + (rows + self.reach) * self.stride + cols + self.reach

    def positions(self, cells):
        rows, cols = np.divmod(cells, self.ncols)
        return self.at(rows - self.row0, cols - self.col0)

    def cells(self, positions):
        rows, cols = np.divmod(positions - self.lead, self.stride)
        return (rows - self.reach + self.row0) * self.ncols + cols - self.reach + self.col0

    def body(self, layer):
        """The padded extent of one layer as rows and columns."""
        return layer[self.lead:self.length - self.lead].reshape(-1, self.stride)

    def window(self, dr, dc):
        """Where a padded extent holds the origins of move (dr, dc) into the area."""
        top, left = self.reach - dr, self.reach - dc
        return slice(top, top + self.height), slice(left, left + self.width)

    def weights(self, z, m):
        """Cost of arriving at each position of the area by each step; infinite where there is no move."""
        formula = cost_function(self.stencil.cost)
        out = np.full((len(self.steps), self.length), np.inf)
        for i, (step, dh) in enumerate(zip(self.steps, self.lengths)):
            w = formula(dh, z[self.area] - z[self.area - step], self.stencil.cap, ARRAY_MATH)
            if m is not None:
                w = w * m[self.area]
            out[i, self.area] = np.where(np.isnan(w), np.inf, w)
        return out


def relax(d, w, steps, live=None):
    """Lower the distances ``d`` (sources x positions) until no move improves any of them; returns the number of rounds.

    With ``live`` only moves from those flat positions, and what they improve, can still improve any. A round moves on from the positions that are nearly the nearest of their own source, so sources
    that are far apart in cost do not wait for each other, and it touches only what has changed.
    """
    length = w.shape[1]
    flat = d.reshape(-1)
    finite = w[np.isfinite(w)]
    width = 2.0 * float(np.median(finite)) if len(finite) else 0.0
    if live is None:
        live = np.flatnonzero(np.isfinite(flat))
    queued = np.zeros(len(flat), bool)
    queued[live] = True
    rounds = 0
    while len(live):
        rounds += 1
        here, source = flat[live], live // length
        least = np.full(len(d), np.inf)
        np.minimum.at(least, source, here)
        near = here <= (least + width)[source]
        now, base = live[near], here[near]
        queued[now] = False
        following = [live[~near]]
        at = now % length
        for i, step in enumerate(steps):
            to = now + step
            value = base + w[i].take(at + step)
            better = np.flatnonzero(value < flat.take(to))
            if not len(better):
                continue
            to = to.take(better)
            flat[to] = value.take(better)
            to = to[~queued.take(to)]
            queued[to] = True
            following.append(to)
        live = np.concatenate(following)
    return rounds


def predecessors(d, w, frame):
    """Index of the move that reaches each cell of the area at least cost, -1 where there is none.

    Among moves of equal cost (to the tick) the one from the lowest cell wins: moves are stored
    in row-major order, so going through them backwards visits origins in ascending order.
    """
    moves = np.full((len(d), frame.height * frame.width), -1, np.int8)
    windows = [frame.window(dr, dc) for dr, dc in frame.moves]
    arriving = [frame.body(x)[frame.window(0, 0)] for x in w]
    for cost, chosen in zip(d, moves.reshape(len(d), frame.height, frame.width)):
        area = frame.body(cost)
        goal = area[frame.window(0, 0)]
        best = np.full(goal.shape, np.inf)
        for i in range(len(windows) - 1, -1, -1):
            origin = area[windows[i]]
            ticks = np.rint((origin + arriving[i]) * TICKS_PER_HOUR)
            better = (ticks < best) & (origin < goal)
            best[better] = ticks[better]
            chosen[better] = i
    return moves


def exits(starts, moves, frame):
    """Follow predecessors from flat ``starts`` until they leave the area or end.

    ``moves`` is flat (sources x positions). Returns the flat position left to, -1 where the walk
    ends at its source, and the number of steps.
    """
    at = starts.copy()
    count = np.zeros(len(at), np.int64)
    left = np.full(len(at), -1, np.int64)
    going = np.arange(len(at))
    while len(going):
        move = moves[at[going]]
        going = going[move >= 0]
        nxt = at[going] - frame.steps[move[move >= 0]]
        at[going] = nxt
        count[going] += 1
        inside = frame.in_area[nxt % frame.length]
        left[going[~inside]] = nxt[~inside]
        going = going[inside]
    return left, count


def visits(starts, moves, frame):
    """Every position of the area on the walks from ``starts``: (index of the walk, step, position)."""
    at, who, step = starts, np.arange(len(starts)), 0
    while len(at):
        yield who, step, at
        move = moves[at]
        ok = move >= 0
        at, who = at[ok] - frame.steps[move[ok]], who[ok]
        inside = frame.in_area[at % frame.length]
        at, who, step = at[inside], who[inside], step + 1


def sweep(total, moves, frame):
    """Let the counts ``total`` (flat, sources x positions) flow along the predecessors, children first.

    Each position ends with what started there or passed through it. Returns the flat positions
    outside the area that counts left to, and how many; every position is visited once.
    """
    at = np.flatnonzero(moves >= 0)
    parent = np.full(len(moves), -1, np.int64)
    parent[at] = at - frame.steps[moves[at]]
    inside = np.zeros(len(moves), bool)
    inside[at] = frame.in_area[parent[at] % frame.length]
    waiting = np.bincount(parent[at[inside[at]]], minlength=len(moves)).astype(np.int32)
    mark = np.zeros(len(moves), np.int32)
    ready = at[waiting[at] == 0]
    while len(ready):
        ready = ready[inside[ready]]
        to = parent[ready]
        np.add.at(total, to, total[ready])
        np.subtract.at(waiting, to, 1)
        # Of a position that several children reached last, the last mark stays.
        to = to[waiting[to] == 0]
        mark[to] = np.arange(len(to))
        to = to[mark[to] == np.arange(len(to))]
        ready = to[parent[to] >= 0]
    out = at[~inside[at] & (total[at] != 0)]
    left, which = np.unique(parent[out], return_inverse=True)
    n = np.zeros(len(left), np.int64)
    np.add.at(n, which, total[out])
    return left, n
