"""Least cumulative cost from many sources over the grid.

The grid is cut into tiles, each working on an area that laps over its neighbours. What tiles know
about each other is a small relation, the *ring*: for each (source, tile) the best cost of the
cells just outside the tile's area. A round relaxes, inside each (tile, group of sources) whose
ring improved, all cells of the area, and sends the costs of the tile's own cells to the rings
that hold them; Spark merges them by minimum. Rounds follow the number of areas a path leaves, not
the number of cells, and the state of a round is a few percent of the cells. Once no ring
improves, one pass derives the predecessors of every cell.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from wayfield.functions.geo import cell_col, cell_row
from wayfield.functions.offsets import offsets
from wayfield.operators.numbering import numbered
from wayfield.operators.tile_kernels import Frame, Stencil, exits, predecessors, relax, sweep
from wayfield.operators.tiles import StoredTiles, halo_tiles, tile_count, tile_of, with_halo
from wayfield.schema import GridMeta
from wayfield.sources.journal import Journal
from wayfield.sources.scratch import Scratch, task_slots

# Sources relaxed together in one group, fewer where tiles are so large that a group would hold more costs than this.
SOURCES_PER_GROUP = 32
GROUP_CELLS = 1 << 23
# Ring row that holds a tile's worst target cost once all its targets are reached.
TARGETS_DONE = -1
# Ring row that stands for a (source, tile) whose costs are final.
SETTLED = -2
# Rounds after which final parts of the ring leave the loop.
SETTLE_EVERY = 8

RING = ("source", "tile", "bucket", "cell_id", "d")
LONGS = pa.list_(pa.int64())
BLOCK_SCHEMA = pa.schema([("tile", pa.int64()), ("z", pa.binary()), ("m", pa.binary()), ("targets", pa.binary()),
                          ("target_weights", pa.binary()), ("halo", pa.int64())])
BORDER_SCHEMA = pa.schema([("source", pa.int64()), ("tile", pa.int64()), ("bucket", pa.int32()),
                           ("cell_id", pa.int64()), ("d", pa.float64())])
TREE_SCHEMA = pa.schema([
    ("source", pa.int64()), ("tile", pa.int64()), ("bucket", pa.int32()),
    ("moves", pa.list_(pa.int8())), ("own_moves", pa.list_(pa.int8())), ("d", pa.list_(pa.float64())),
    ("hop_cell", LONGS), ("hop_next", LONGS), ("hop_steps", LONGS),
    ("goal_cell", LONGS), ("goal_d", pa.list_(pa.float64())), ("leave_cell", LONGS), ("leave_n", LONGS)])


class Unfinished(RuntimeError):
    """A search that may be resumed has done as many rounds as it was given."""


@dataclass
class CostTrees:
    """Least-cost trees of a set of sources, one row per (source, tile).

    ``moves`` holds the predecessor move of each cell of the tile's area; the ``hop`` columns say
    for border cells where their path leaves the area and after how many steps; the ``leave``
    columns say in which cells outside the area how many paths from the tile's own targets arrive.
    The ``goal`` columns hold the costs of the targets, and hops start there too, if ``with_goals``
    was set (so a row for each source and target: not for searches between all points).
    ``own_moves`` and ``d`` cover the tile's own cells and are null unless asked for.
    """

    trees: DataFrame
    stencil: Stencil
    scratch: Scratch
    rounds: int
    blocks: DataFrame

    @property
    def meta(self) -> GridMeta:
        return self.stencil.meta


def with_row_col(cells: DataFrame, meta: GridMeta) -> DataFrame:
    return (cells.withColumn("row", cell_row(F.col("cell_id"), meta))
                 .withColumn("col", cell_col(F.col("cell_id"), meta)))


def group_sources(sources: DataFrame, stencil: Stencil, scratch: Scratch) -> DataFrame:
    """Distinct source cells with their tile and the group they are relaxed in.

    Sources are grouped tile by tile, so that a group moves over the grid together and needs the
    blocks of few tiles at a time; however many sources a tile holds, groups stay the same size.
    """
    meta = stencil.meta
    at = with_row_col(sources.select("cell_id").distinct(), meta)
    placed = scratch.save(at.select(F.col("cell_id").alias("source"), tile_of(
        F.col("row"), F.col("col"), meta, stencil.size).alias("tile")), "sources")
    ranked = numbered(placed, ["tile", "source"], scratch)
    together = max(1, min(SOURCES_PER_GROUP, GROUP_CELLS // stencil.tile_cells))
    return ranked.select("source", "tile", F.floor(F.col("rank") / together).cast("int").alias("bucket"))


def pack_tiles(cells: DataFrame | StoredTiles, stencil: Stencil, mult: DataFrame | None = None,
               targets: DataFrame | None = None) -> DataFrame:
    """One row per tile: elevations and multipliers of its padded extent, positions and weights of
    targets (``cell_id`` and, if there is one, ``m``), and how many halo cells have an elevation.

    The inputs are stacked and not joined, so all of them are shuffled once, by tile. Stored tiles are not:
    only multipliers and targets go to where they lie.
    """
    meta = stencil.meta
    none = F.lit(None).cast("double")
    stored = cells if isinstance(cells, StoredTiles) else None
    padding = stencil.overlap + stencil.reach
    if stored is not None:
        if stored.size != stencil.size:
            raise ValueError(f"tiles are stored with a side of {stored.size}, {stencil.size} is needed")
        cells = stored.within(padding)
    own_mult = mult is None and "m" in cells.columns
    known = cells.where(F.col("z").isNotNull() | F.col("m").isNotNull()) if own_mult else cells.where(F.col("z").isNotNull())
    rows = lying = known.select(*(["tile"] if stored is not None else []), "row", "col", "z",
                                F.col("m") if own_mult else none.alias("m"), F.lit(0).cast("bigint").alias("t"))
    if stored is not None:
        rows = lying.drop("tile").limit(0)
    if mult is not None:
        rows = rows.unionByName(with_row_col(mult, meta).select(
            "row", "col", none.alias("z"), "m", F.lit(0).cast("bigint").alias("t")))
    if targets is not None:
        weight = F.col("m").cast("bigint") if "m" in targets.columns else F.lit(1).cast("bigint")
        weighed = targets.groupBy("cell_id").agg(F.sum(weight).alias("t"))
        rows = rows.unionByName(with_row_col(weighed, meta).select("row", "col", none.alias("z"), none.alias("m"), "t"))
    has_mult = mult is not None or own_mult

    def pack(key, rows):
        frame = Frame(key[0].as_py(), stencil)
        at = frame.at(column(rows, "row") - frame.row0, column(rows, "col") - frame.col0)
        layers = []
        for name, empty in (("z", np.nan), ("m", 1.0)):
            values = rows.column(name).to_numpy()
            known = ~np.isnan(values)
            layer = np.full(frame.length, empty)
            layer[at[known]] = values[known]
            layers.append(layer)
        weight = column(rows, "t")
        goal = np.flatnonzero((weight > 0) & frame.in_own[at])
        goal, weight = at[goal].astype(np.int64), weight[goal]
        halo = np.count_nonzero(~np.isnan(layers[0][~frame.in_area]))
        return pa.table([key[:1], [layers[0].tobytes()], [layers[1].tobytes() if has_mult else None],
                         [goal.tobytes()], [weight.tobytes()], [halo]], schema=BLOCK_SCHEMA)

    local = with_halo(rows, meta, stencil.size, padding)
    schema = from_arrow_schema(BLOCK_SCHEMA)
    if stored is not None:
        groups = lying.groupBy("tile")
        if mult is None and targets is None:
            return groups.applyInArrow(pack, schema)
        columns = ["tile", "row", "col", "z", "m", "t"]
        return groups.cogroup(local.select(columns).groupBy("tile")).applyInArrow(
            lambda key, here, more: pack(key, pa.concat_tables([here.select(columns), more.select(columns)], promote_options="permissive")), schema)
    slots = min(task_slots(cells.sparkSession), tile_count(meta, stencil.size))
    return local.repartition(slots, "tile").groupBy("tile").applyInArrow(pack, schema)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _load_tile(key, ring, block, stencil):
    """Frame, weights, targets, sources and starting distances of one (tile, bucket) group."""
    frame = Frame(key[0].as_py(), stencil)
    if len(block):
        z, m, goal, weight = (None if v is None else np.frombuffer(v, t) for v, t in
                              ((block.column(name)[0].as_py(), t) for name, t in
                               (("z", np.float64), ("m", np.float64), ("targets", np.int64), ("target_weights", np.int64))))
    else:  # a tile without any elevation has no block
        z, m, goal, weight = np.full(frame.length, np.nan), None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = frame.weights(z, m)
    sources, who = np.unique(column(ring, "source"), return_inverse=True)
    d = np.full((len(sources), frame.length), np.inf)
    d[who, frame.positions(column(ring, "cell_id"))] = column(ring, "d")
    relax(d, w, frame.steps)
    return frame, w, goal, weight, sources, d


def _border_costs(stencil: Stencil):
    def run(key, ring, block):
        if not len(ring):
            return BORDER_SCHEMA.empty_table()
        frame, _, goal, _, sources, d = _load_tile(key, ring, block, stencil)
        who, at = np.nonzero(np.isfinite(d[:, frame.border]))
        at = frame.border[at]
        out = [(sources[who], frame.cells(at), d[who, at])]
        if len(goal):
            worst = d[:, goal].max(axis=1)
            done = np.isfinite(worst)
            out.append((sources[done], np.full(done.sum(), TARGETS_DONE), worst[done]))
        source, cell, cost = (np.concatenate(x) for x in zip(*out))
        return pa.table([source, pa.repeat(key[0], len(source)), pa.repeat(key[1], len(source)), cell, cost],
                        schema=BORDER_SCHEMA)
    return run


def _tree_rows(stencil: Stencil, keep_cells: bool, with_goals: bool, goal_hops: bool):
    def run(key, ring, block):
        if not len(ring):
            return TREE_SCHEMA.empty_table()
        frame, w, goal, weight, sources, d = _load_tile(key, ring, block, stencil)
        n = len(sources)
        moves = np.full(d.shape, -1, np.int8)
        moves[:, frame.area] = best = predecessors(d, w, frame)
        out, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(goal) and len(frame.area) < stencil.meta.n_cells:  # else nothing can leave the area
            total = np.zeros(d.shape, np.int64)
            total[:, goal] = np.where(moves[:, goal] >= 0, weight, 0)
            out, count = sweep(total.reshape(-1), moves.reshape(-1), frame)
        goal = goal if with_goals else goal[:0]
        wanted = np.union1d(frame.border, goal if goal_hops else goal[:0]).astype(np.int64)
        who, at = np.nonzero(np.isfinite(d[:, wanted]))
        left, steps = exits(who * frame.length + wanted[at], moves.reshape(-1), frame)
        nxt = np.where(left >= 0, frame.cells(left % frame.length), -1)
        hit_who, hit = np.nonzero(np.isfinite(d[:, goal]))

        def per_source(owner, values):
            ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(ends, pa.array(values))

        def per_cell(values):
            return per_source(np.repeat(np.arange(n), values.shape[1]), values.reshape(-1))

        own = [per_cell(x[:, frame.own]) if keep_cells else pa.nulls(n, TREE_SCHEMA.field(name).type)
               for name, x in (("own_moves", moves), ("d", d))]
        columns = [sources, pa.repeat(key[0], n), pa.repeat(key[1], n), per_cell(best), *own,
                   per_source(who, frame.cells(wanted[at])), per_source(who, nxt), per_source(who, steps),
                   per_source(hit_who, frame.cells(goal[hit])), per_source(hit_who, d[hit_who, goal[hit]]),
                   per_source(out // frame.length, frame.cells(out % frame.length)), per_source(out // frame.length, count)]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns],
                        schema=TREE_SCHEMA)
    return run


def _per_group(ring: DataFrame, blocks: DataFrame, slots: int, run, schema: pa.Schema) -> DataFrame:
    """Apply ``run`` to each (tile, bucket) of ``ring`` together with the tile's block.

    Blocks are copied once per group of sources that needs them. The number of partitions is
    fixed, since a few ring rows can mean much work.
    """
    keys = ring.select(F.col("tile").alias("tile"), F.col("bucket").alias("bucket")).distinct()
    copies = keys.join(blocks, "tile").repartition(slots, "tile", "bucket")
    return (ring.repartition(slots, "tile", "bucket").groupBy("tile", "bucket")
                .cogroup(copies.groupBy("tile", "bucket")).applyInArrow(run, from_arrow_schema(schema)))


def _to_rings(border: DataFrame, stencil: Stencil) -> DataFrame:
    """Send each border cell to the tiles whose ring holds it; marks stay with their tile."""
    meta = stencil.meta
    row, col = cell_row(F.col("cell_id"), meta), cell_col(F.col("cell_id"), meta)
    rings = F.array_except(halo_tiles(row, col, meta, stencil.size, stencil.overlap + stencil.reach),
                           halo_tiles(row, col, meta, stencil.size, stencil.overlap))
    to = F.when(F.col("cell_id") == TARGETS_DONE, F.array("tile")).otherwise(rings)
    return border.select("source", F.explode(to).alias("tile"), "bucket", "cell_id", "d")


def _bounds(ring: DataFrame, target_tiles: int) -> DataFrame:
    """Cost beyond which a source need not look: its worst target, once all are reached."""
    return (ring.where(F.col("cell_id") == TARGETS_DONE).groupBy("source")
                .agg(F.count("*").alias("tiles"), F.max("d").alias("bound"))
                .where(F.col("tiles") == target_tiles).select("source", "bound"))


def _final_rows(split: DataFrame) -> DataFrame:
    return split.where("settled and cell_id >= 0").select(*RING)


def cost_trees(cells: DataFrame | StoredTiles, sources: DataFrame, stencil: Stencil, mult: DataFrame | None = None,
               targets: DataFrame | None = None, bounded: bool = False, keep_cells: bool = False,
               blocks: DataFrame | None = None, with_goals: bool = False, width: float | None = None,
               resume: str | None = None, max_rounds: int | None = None, goal_hops: bool = True) -> CostTrees:
    """Solve least cost from every cell in ``sources`` (``cell_id``) over the grid.

    With ``bounded`` the search of a source ends at the cost of its farthest target, which changes
    no result at the targets. ``blocks`` are packed tiles to use again. ``with_goals`` keeps a row for
    each source and target. With ``width`` a tile waits until its least fresh ring cost lies in the lowest cost
    bucket of its source: there are more rounds, but tiles are hardly ever relaxed before their ring is final.
    Without ``goal_hops`` there are no hops from targets, which only traced paths need.

    ``resume`` is a folder of the shared store for this search alone: if one over the same data was begun there, it goes on
    after the last round it finished. With ``max_rounds`` a call ends with :class:`Unfinished` after that many rounds.
    """
    spark = cells.sparkSession
    scratch = Scratch(spark, "cost", resume)
    journal = Journal(spark, resume, f"cost trees {stencil} {bounded} {keep_cells} {with_goals} {width} {goal_hops}") if resume else None
    meta, size = stencil.meta, stencil.size
    slots = task_slots(spark)
    begun = journal.state if journal else None
    if blocks is None:
        blocks = journal.table(begun["blocks"]) if begun else scratch.save(pack_tiles(cells, stencil, mult, targets), "blocks")
    if begun and "trees" in begun:
        return CostTrees(journal.table(begun["trees"]), stencil, scratch, begun["rounds"], blocks)
    target_tiles = 0
    if bounded and targets is not None:
        target_tiles = blocks.where(F.length("targets") > 0).count()

    if begun:
        ring, rounds, live = journal.table(begun["ring"]), begun["rounds"], begun["live"]
        splits = [journal.table(note) for note in begun["splits"]]
    else:
        starts = with_row_col(group_sources(sources, stencil, scratch).withColumn("cell_id", F.col("source")), meta)
        ring = scratch.save(with_halo(starts, meta, size, stencil.overlap + stencil.reach).select(
            "source", "tile", "bucket", "cell_id", F.lit(0.0).alias("d"),
            F.lit(True).alias("fresh"), F.lit(True).alias("live")), "ring")
        splits: list[DataFrame] = []
        rounds = 0
        # Where no tile has a cell around it, nothing can leave one.
        live = blocks.where("halo > 0").limit(1).count() > 0

    def finished(**more) -> None:
        if journal:
            journal.record(ring=ring, rounds=rounds, live=live, splits=splits,
                           **({"blocks": blocks} if hasattr(blocks, "_wayfield_path") else {}), **more)

    here = rounds
    while live:
        if max_rounds is not None and rounds - here >= max_rounds:
            raise Unfinished(f"{rounds} rounds done")
        rounds += 1
        older = [ring]
        if width is not None:
            ring = scratch.save(_in_bucket(ring, width), "ring")
            older.append(ring)
        now = "now" if width is not None else "live"
        border = _per_group(ring.where(now).select(*RING), blocks, slots, _border_costs(stencil), BORDER_SCHEMA)
        bounds = _bounds(ring, target_tiles) if target_tiles else None
        merged = _merge(ring, _to_rings(border, stencil), slots, bounds, bool(splits))
        seen = Observation()
        ring = scratch.save(merged.observe(seen, F.count_if("live").alias("live")), "ring")
        live = seen.get["live"] > 0
        if live and rounds % SETTLE_EVERY == 0:
            split = scratch.save(_settle(ring, blocks, stencil), "split", "settled")
            splits.append(split)
            ends = split.where("settled and cell_id >= 0").select("source", "tile", "bucket").distinct()
            older.append(ring)
            ring = scratch.save(
                split.where("not settled or cell_id < 0").drop("settled").unionByName(ends.select(
                    "*", F.lit(SETTLED).cast("bigint").alias("cell_id"), F.lit(0.0).alias("d"),
                    F.lit(False).alias("fresh"), F.lit(False).alias("live"))), "ring")
        finished()
        for table in older:
            scratch.drop(table)

    known = reduce(DataFrame.unionByName, [_final_rows(split) for split in splits], ring.where("cell_id >= 0").select(*RING))
    trees = scratch.save(_per_group(known, blocks, slots, _tree_rows(stencil, keep_cells, with_goals, goal_hops), TREE_SCHEMA), "trees")
    finished(trees=trees)
    return CostTrees(trees, stencil, scratch, rounds, blocks)


def _merge(ring: DataFrame, news: DataFrame, slots: int, bounds: DataFrame | None, some_settled: bool) -> DataFrame:
    """Ring with the news worked in, telling which rows improved (or wait) and whose tiles must be relaxed.

    News for a settled (source, tile) cannot improve it and is dropped.
    """
    waits = F.col("fresh") & ~F.col("now") if "now" in ring.columns else F.lit(False)
    known = ring.select(*RING, F.col("d").alias("old"), waits.alias("waits"))
    merged = (known.unionByName(news.withColumns({"old": F.lit(None).cast("double"), "waits": F.lit(False)}))
                   .repartition(slots, "tile", "bucket").groupBy("tile", "bucket", "source", "cell_id")
                   .agg(F.min("d").alias("d"), F.min("old").alias("old"), F.max("waits").alias("waits")))
    pair = Window.partitionBy("tile", "bucket", "source")
    if some_settled:
        over = F.max(F.col("cell_id") == SETTLED).over(pair)
        merged = merged.withColumn("over", over).where(~F.col("over") | (F.col("cell_id") < 0))
    useful = F.lit(True)
    if bounds is not None:
        merged = merged.join(bounds, "source", "left")
        useful = F.coalesce(F.col("d") < F.col("bound"), F.lit(True))
        merged = merged.where(useful | F.col("old").isNotNull() | (F.col("cell_id") == TARGETS_DONE))
    fresh = (F.col("cell_id") >= 0) & useful & (F.col("old").isNull() | (F.col("d") < F.col("old")) | F.col("waits"))
    merged = merged.withColumn("fresh", fresh)
    live = F.max("fresh").over(pair) & (F.col("cell_id") >= 0)
    return merged.select(*RING, "fresh", live.alias("live"))


def _in_bucket(ring: DataFrame, width: float) -> DataFrame:
    """Ring with column ``now``: true for the rows of each (source, tile) whose least fresh cost is in its source's lowest bucket."""
    front = ring.where("fresh").groupBy("source").agg(F.floor(F.min("d") / width).alias("front"))
    pair = Window.partitionBy("tile", "bucket", "source")
    least = F.min(F.when(F.col("fresh"), F.col("d"))).over(pair)
    return (ring.withColumn("least", F.floor(least / width)).join(front, "source", "left")
                .select(*RING, "fresh", "live", (F.col("live") & F.coalesce(F.col("least") == F.col("front"), F.lit(False))).alias("now")))


def _settle(ring: DataFrame, blocks: DataFrame, stencil: Stencil) -> DataFrame:
    """Ring with column ``settled``: true for every row of a (source, tile) that cannot change.

    Whatever still moves for a source costs at least the least cost among its fresh rows. A tile
    whose whole halo is known at no more than that is final. This keeps the ring that goes through
    every round to the moving front.
    """
    meta = stencil.meta
    front = ring.where("fresh").groupBy("source").agg(F.min("d").alias("front"))
    halos = blocks.select("tile", "halo")
    pair = Window.partitionBy("tile", "bucket", "source")
    areas = halo_tiles(cell_row(F.col("cell_id"), meta), cell_col(F.col("cell_id"), meta),
                       meta, stencil.size, stencil.overlap)
    in_halo = (F.col("cell_id") >= 0) & ~F.array_contains(areas, F.col("tile"))
    worst = F.max(F.when(F.col("cell_id") >= 0, F.col("d"))).over(pair)
    settled = (~F.max("live").over(pair) & (F.count_if(in_halo).over(pair) == F.col("halo"))
               & F.coalesce(worst <= F.col("front"), F.lit(True)))
    return (ring.join(halos, "tile", "left").join(front, "source", "left")
                .select(*RING, "fresh", "live", F.coalesce(settled, F.lit(False)).alias("settled")))


def _spread(solved: CostTrees, column: str) -> DataFrame:
    """One row per cell from a per-tile array: ``source, cell_id, value`` and the tile's width."""
    meta, size = solved.meta, solved.stencil.size
    across = F.lit(-(-meta.ncols // size)).cast("bigint")
    row0 = F.call_function("div", F.col("tile"), across) * size
    col0 = F.pmod(F.col("tile"), across) * size
    width = F.least(F.lit(size).cast("bigint"), F.lit(meta.ncols) - col0)
    at = solved.trees.select("source", row0.alias("row0"), col0.alias("col0"), width.alias("width"),
                             F.posexplode(column).alias("pos", "value"))
    row = F.col("row0") + F.call_function("div", F.col("pos").cast("bigint"), F.col("width"))
    col = F.col("col0") + F.pmod(F.col("pos"), F.col("width"))
    return at.select("source", (row * F.lit(meta.ncols).cast("bigint") + col).alias("cell_id"), "value")


def distances(solved: CostTrees) -> DataFrame:
    """``source, cell_id, d`` of every reached cell; the trees must have been made with their cells."""
    cells = _spread(solved, "d").where(F.col("value") < float("inf"))
    return cells.select("source", "cell_id", F.col("value").alias("d"))


def tree_predecessors(solved: CostTrees) -> DataFrame:
    """``source, cell_id, pred`` of every reached cell but the sources; needs the trees' cells."""
    ncols = solved.meta.ncols
    jump = F.array(*[F.lit(dr * ncols + dc).cast("bigint") for dr, dc in offsets(solved.stencil.k)])
    return (_spread(solved, "own_moves").where(F.col("value") >= 0)
            .select("source", "cell_id", (F.col("cell_id") - F.get(jump, F.col("value").cast("int"))).alias("pred")))


def goals(solved: CostTrees) -> DataFrame:
    """``source, bucket, cell_id, d`` of the targets each source reaches."""
    return solved.trees.select("source", "bucket", F.inline(F.arrays_zip("goal_cell", "goal_d"))).select(
        "source", "bucket", F.col("goal_cell").alias("cell_id"), F.col("goal_d").alias("d"))


def target_costs(solved: CostTrees) -> DataFrame:
    """``source, cell_id, d`` of the targets each source reaches."""
    return goals(solved).select("source", "cell_id", "d")


def hops(solved: CostTrees) -> DataFrame:
    """``source, cell_id, next_cell, steps`` for border and target cells; -1 ends at the source."""
    return solved.trees.select(
        "source", F.inline(F.arrays_zip("hop_cell", "hop_next", "hop_steps"))).select(
        "source", F.col("hop_cell").alias("cell_id"), F.col("hop_next").alias("next_cell"),
        F.col("hop_steps").alias("steps"))


def cost_distance(cells: DataFrame | StoredTiles, sources: DataFrame, stencil: Stencil, mult: DataFrame | None = None) -> DataFrame:
    """Least cost from every source to every cell it reaches."""
    from wayfield.operators import strips  # builds on this module

    if side := strips.strips_for(cells, sources, stencil.meta):
        return strips.strip_costs(cells, sources, stencil, mult, side)
    return distances(cost_trees(cells, sources, stencil, mult, keep_cells=True))


def cost_predecessors(cells: DataFrame | StoredTiles, sources: DataFrame, stencil: Stencil, mult: DataFrame | None = None) -> DataFrame:
    """The cell each reached cell is best entered from, for every source: ``source, cell_id, pred``."""
    from wayfield.operators import strips

    if side := strips.strips_for(cells, sources, stencil.meta):
        return strips.strip_predecessors(cells, sources, stencil, mult, side)
    return tree_predecessors(cost_trees(cells, sources, stencil, mult, keep_cells=True))


def pairwise_cost(cells: DataFrame | StoredTiles, points: DataFrame, stencil: Stencil, mult: DataFrame | None = None) -> DataFrame:
    """Origin-destination costs between all point cells."""
    from wayfield.operators import strips

    if side := strips.strips_for(cells, points, stencil.meta):
        return strips.strip_costs(cells, points, stencil, mult, side, points)
    return target_costs(cost_trees(cells, points, stencil, mult, targets=points, bounded=True, with_goals=True, goal_hops=False))


def reachability(costs: DataFrame, dests: DataFrame) -> DataFrame:
    """Destinations of one origin with their cost: ``dest_id, cell_id, d, reachable``.

    ``costs`` has one row per cell. Many destinations may share a cell; the join is an equi-join
    that adaptive execution broadcasts or splits.
    """
    return (dests.join(costs.select("cell_id", "d"), "cell_id", "left")
                 .select("dest_id", "cell_id", "d", F.col("d").isNotNull().alias("reachable")))
