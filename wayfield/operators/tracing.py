"""Paths and path counts from least-cost trees.

Paths cross tiles along the *hops* of the trees, a relation no larger than the rings, so what
flows between tiles is an iterated join and sum. The cells inside the tiles are filled in
afterwards, in one pass over all tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from wayfield.functions.geo import cell_col, cell_row, cell_to_world
from wayfield.operators.distance import CostTrees, column, goals, hops, with_row_col
from wayfield.operators.numbering import numbered
from wayfield.operators.terrain import dilate
from wayfield.operators.tile_kernels import Frame, Stencil, sweep, visits
from wayfield.operators.tiles import tile_count, tile_of
from wayfield.schema import GridMeta
from wayfield.sources.features import vertices_text
from wayfield.sources.scratch import Scratch, task_slots

# Path pieces unpacked together in one group.
PIECES_PER_GROUP = 4096
# Lines have marks every so many steps: what comes before a mark is made once for all lines through it.
MARK_STEPS = 128

COUNT_SCHEMA = pa.schema([("source", pa.int64()), ("cell_id", pa.int64()), ("n", pa.int64())])
PIECE_SCHEMA = pa.schema([("source", pa.int64()), ("dest_cell", pa.int64()), ("step", pa.int64()),
                          ("cell_id", pa.int64())])
WALK_SCHEMA = pa.schema([("source", pa.int64()), ("bucket", pa.int32()), ("tile", pa.int64()), ("cell_id", pa.int64()), ("next_cell", pa.int64()),
                         ("steps", pa.int64()), ("last", pa.int64()), ("end_cell", pa.int64()), ("cells", pa.list_(pa.int64()))])


def _rounds(step, first: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``first`` and all tables that follow from it by ``step`` until one is empty."""
    def saved(rows: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        return scratch.save(rows.observe(seen, F.count("*").alias("n")), name), seen.get["n"]

    table, n = saved(first)
    everything = table
    while n:
        table, n = saved(step(table))
        if n:
            everything = everything.unionByName(table)
        else:
            scratch.drop(table)
    return everything


def flow(hop_table: DataFrame, tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """Paths passing through each cell where paths start or enter a tile.

    ``tokens`` (``source, bucket, cell_id, n``) are the path starts. Tokens that meet in a cell are summed before they move on.
    """
    def onward(now: DataFrame) -> DataFrame:
        return (now.join(hop_table, ["source", "cell_id"]).where(F.col("next_cell") >= 0)
                   .groupBy("source", "bucket", F.col("next_cell").alias("cell_id")).agg(F.sum("n").alias("n")))

    entries = _rounds(onward, tokens, scratch, "tokens")
    return entries.groupBy("source", "bucket", "cell_id").agg(F.sum("n").alias("n"))


def path_exits(solved: CostTrees) -> DataFrame:
    """Paths that leave the area they start in, as tokens: one for each source and cell they leave to.

    A source's own cell starts no path.
    """
    left = solved.trees.select("source", "bucket", F.inline(F.arrays_zip("leave_cell", "leave_n")))
    return left.groupBy("source", "bucket", F.col("leave_cell").alias("cell_id")).agg(F.sum("leave_n").alias("n"))


def _load_trees(key, starts, trees, stencil):
    """Frame, sources, flat moves and the flat start positions of one group."""
    frame = Frame(key[0].as_py(), stencil)
    sources = column(trees, "source")
    moves = np.full((len(sources), frame.length), -1, np.int8)
    moves[:, frame.area] = trees.column("moves").combine_chunks().flatten().to_numpy().reshape(len(sources), -1)
    order = np.argsort(sources)
    row = order[np.searchsorted(sources, column(starts, "source"), sorter=order)]
    return frame, sources, moves.reshape(-1), row * frame.length + frame.positions(column(starts, "cell_id"))


def _count_cells(stencil: Stencil, per_source: bool):
    def run(key, entries, trees):
        if not len(trees):
            return COUNT_SCHEMA.empty_table()
        coming = entries.filter(entries.column("targets").is_null())
        frame, sources, moves, at = _load_trees(key, coming, trees, stencil)
        total = np.zeros(moves.size, np.int64)
        for content in entries.filter(entries.column("targets").is_valid()).to_pylist():  # one row
            goal, weight = (np.frombuffer(content[c], np.int64) for c in ("targets", "target_weights"))
            view = total.reshape(len(sources), -1)
            view[:, goal] = np.where(moves.reshape(len(sources), -1)[:, goal] >= 0, weight, 0)
        np.add.at(total, at, column(coming, "n"))
        sweep(total, moves, frame)
        total = total.reshape(len(sources), -1)
        total[:, ~frame.in_area] = 0
        total *= column(trees, "weight")[:, None]
        if not per_source:
            total = total.sum(axis=0, keepdims=True)
        who, at = np.nonzero(total)
        return pa.table({"source": sources[who] if per_source else np.full(len(who), -1),
                         "cell_id": frame.cells(at), "n": total[who, at]})
    return run


def _in_tiles(solved: CostTrees, table: DataFrame) -> DataFrame:
    """Add the tile of each row's cell."""
    meta, size = solved.meta, solved.stencil.size
    return (with_row_col(table, meta)
            .withColumn("tile", tile_of(F.col("row"), F.col("col"), meta, size)).drop("row", "col"))


def path_counts(solved: CostTrees, source_weights: DataFrame | None = None, per_source: bool = True) -> DataFrame:
    """How many paths from each source to the targets of its search pass through each cell.

    Paths are counted with the weights of the targets and, if given, of the sources (``cell_id, m``).
    What moves between tiles are counts at the cells where paths enter a tile, so their number does
    not depend on that of the targets; inside a tile one sweep adds up what starts and what enters.
    With ``per_source=False`` the counts are summed over sources inside the tasks: ``cell_id, n``,
    where a cell may still come in several rows.
    """
    scratch = solved.scratch
    entries = flow(scratch.save_bucketed(hops(solved), "hops", "source", "cell_id"), path_exits(solved), scratch)
    scratch.forget_tables()
    slots = task_slots(entries.sparkSession)
    # Fresh column ids: without tile changes the entries come straight from the same scan.
    trees = solved.trees.select([F.col(c).alias(c) for c in ("source", "tile", "bucket", "moves")])
    none = F.lit(None).cast("binary")
    seeds = (solved.trees.select("tile", "bucket").distinct()
             .join(solved.blocks.where(F.length("targets") > 0).select("tile", "targets", "target_weights"), "tile"))
    nothing = F.lit(None).cast("bigint")
    entries = (_in_tiles(solved, entries).select("source", "tile", "bucket", "cell_id", "n", none.alias("targets"), none.alias("target_weights"))
               .unionByName(seeds.select(nothing.alias("source"), "tile", "bucket", nothing.alias("cell_id"), nothing.alias("n"), "targets", "target_weights")))
    if source_weights is not None:
        weights = source_weights.select(F.col("cell_id").alias("source"), F.col("m").cast("bigint").alias("weight"))
        trees = trees.join(weights, "source")
    else:
        trees = trees.withColumn("weight", F.lit(1).cast("bigint"))
    counted = (entries.repartition(slots, "tile", "bucket").groupBy("tile", "bucket")
               .cogroup(trees.repartition(slots, "tile", "bucket").groupBy("tile", "bucket"))
               .applyInArrow(_count_cells(solved.stencil, per_source), from_arrow_schema(COUNT_SCHEMA)))
    if not per_source:
        return counted.select("cell_id", "n")
    if tile_count(solved.meta, solved.stencil.size) == 1:
        return counted
    # Areas lap over each other, so two tiles may count paths on the same cell.
    return counted.groupBy("source", "cell_id").agg(F.sum("n").alias("n"))


def density(counts: DataFrame, source_weights: DataFrame | None = None) -> DataFrame:
    """Paths through each cell over all sources: sparse ``cell_id, value``."""
    if source_weights is not None:
        weights = source_weights.select(F.col("cell_id").alias("source"), F.col("m").alias("_w"))
        counts = counts.join(weights, "source").select("cell_id", (F.col("n") * F.col("_w")).alias("n"))
    return counts.groupBy("cell_id").agg(F.sum("n").alias("value"))


def density_summary(counts: DataFrame, meta: GridMeta) -> DataFrame:
    """Largest, least and mean (whole number) count over the cells that have one."""
    some = counts.where(F.col("n") > 0)
    return some.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("max_density"), F.coalesce(F.min("n"), F.lit(0)).alias("min_density"),
        F.coalesce(F.call_function("div", F.sum("n"), F.count("*")), F.lit(0)).alias("avg_density"),
        F.count("*").alias("nonzero_cells"), F.lit(meta.n_cells).cast("bigint").alias("total_cells"))


def _piece_cells(stencil: Stencil):
    def run(key, pieces, trees):
        if not len(pieces) or not len(trees):
            return PIECE_SCHEMA.empty_table()
        frame, _, moves, starts = _load_trees(key, pieces, trees, stencil)
        parts = list(visits(starts, moves, frame))
        who = np.concatenate([w for w, _, _ in parts])
        back = np.concatenate([np.full(len(w), s) for w, s, _ in parts])
        at = np.concatenate([a for _, _, a in parts]) % frame.length
        step = (column(pieces, "last") - column(pieces, "back"))[who] - back
        return pa.table({"source": column(pieces, "source")[who], "dest_cell": column(pieces, "dest_cell")[who],
                         "step": step, "cell_id": frame.cells(at)})
    return run


def _walks(stencil: Stencil):
    """The first ``length`` cells of each piece, those nearest to the source first, and the cell it comes to after them."""
    def run(key, pieces, trees):
        if not len(pieces) or not len(trees):
            return WALK_SCHEMA.empty_table()
        frame, _, moves, here = _load_trees(key, pieces, trees, stencil)
        length = column(pieces, "length")
        ends = np.cumsum(length)
        visited = np.zeros(ends[-1], np.int64)
        step, going = 0, np.flatnonzero(length > 0)
        while len(going):
            now = here[going]
            visited[ends[going] - 1 - step] = now % frame.length
            move = moves[now]
            going, now, move = going[move >= 0], now[move >= 0], move[move >= 0]
            here[going] = now - frame.steps[move]
            step += 1
            going = going[length[going] > step]
        cells = pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), frame.cells(visited)).cast(pa.list_(pa.int64()))
        return pieces.select(WALK_SCHEMA.names[:-2]).append_column("end_cell", pa.array(frame.cells(here % frame.length))).append_column("cells", cells)
    return run


def _per_tile(solved: CostTrees, placed: DataFrame, run, schema: pa.Schema) -> DataFrame:
    """Run a kernel on the path pieces of each tile and its trees; where there are many pieces, in several groups."""
    slots = task_slots(placed.sparkSession)
    share = placed.groupBy("tile", "bucket").agg(F.ceil(F.count("*") / PIECES_PER_GROUP).alias("salts"))
    placed = (placed.join(share, ["tile", "bucket"])
              .withColumn("salt", F.pmod(F.xxhash64("cell_id"), F.col("salts")).cast("int")).drop("salts"))
    trees = (solved.trees.select("source", "tile", "bucket", "moves").join(share, ["tile", "bucket"])
             .withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int")))).drop("salts"))
    keys = ["tile", "bucket", "salt"]
    return (placed.repartition(slots, *keys).groupBy(*keys)
            .cogroup(trees.repartition(slots, *keys).groupBy(*keys))
            .applyInArrow(run, from_arrow_schema(schema)))


def jump_tables(hop_table: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Pointer doubling over hops: the n-th table leads 2^n hops on, the last one to the source from everywhere.

    ``source, cell_id, next_cell, steps``; ``next_cell`` is -1 where the way ends before, and ``steps`` then counts up to the source.
    So the number of tables is the logarithm of the most tiles that a path crosses.
    """
    tables = [scratch.save_bucketed(hop_table.select("source", "cell_id", "next_cell", "steps"), "jumps", "source", "cell_id")]
    while tables[-1].where("next_cell >= 0").limit(1).count():
        now = tables[-1]
        ahead = now.select(F.col("source").alias("_source"), F.col("cell_id").alias("_cell"),
                           F.col("next_cell").alias("_next"), F.col("steps").alias("_steps"))
        moved = (now.where("next_cell >= 0").join(ahead.hint("merge"), (F.col("source") == F.col("_source")) & (F.col("next_cell") == F.col("_cell")))
                    .select("source", "cell_id", F.col("_next").alias("next_cell"), (F.col("steps") + F.col("_steps")).alias("steps")))
        tables.append(scratch.save_bucketed(moved.unionByName(now.where("next_cell < 0")), "jumps", "source", "cell_id"))
    return tables


def path_nodes(starts: DataFrame, jumps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Every cell where a path from ``starts`` (``source, bucket, dest_cell, cell_id``) enters a tile, one row for each path and cell.

    Jumps are taken from the longest to the shortest, each from all cells known by then. The rows compress so well that Spark
    would take millions of them for a small table to broadcast through the driver: these joins are merge joins by hint.
    """
    nodes = scratch.save(starts, "nodes")
    for jump in reversed(jumps[:-1]):
        onward = (nodes.join(jump.where("next_cell >= 0").select("source", "cell_id", "next_cell").hint("merge"), ["source", "cell_id"])
                       .select("source", "bucket", "dest_cell", F.col("next_cell").alias("cell_id")))
        older, nodes = nodes, scratch.save(nodes.unionByName(onward), "nodes")
        scratch.drop(older)
    return nodes


def trace_paths(solved: CostTrees, dest_cells: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Ordered cells of the path to each destination cell: ``source, dest_cell, step, cell_id``.

    With ``numbers`` (``path_id, cell_id``) those of each numbered path: ``path_id, step, cell_id``. Paths get their numbers while they have a row
    for each tile, so rows for their cells are neither stored nor shuffled.

    ``dest_cells`` is distinct ``cell_id``. Steps count from the source. Where a path enters tiles is found by pointer doubling. The piece
    inside a tile is walked once for each source and cell where paths enter, however many of them do, and given to its paths at
    the end. That join's keys are hot near a source; it is a join of two tables, which adaptive execution splits.
    """
    scratch = solved.scratch
    jumps = jump_tables(hops(solved), scratch)
    depth = jumps[-1].select("source", "cell_id", F.col("steps").alias("last"))
    first = (goals(solved).join(dest_cells.select("cell_id"), "cell_id", "left_semi")
             .select("source", "bucket", F.col("cell_id").alias("dest_cell"), "cell_id"))
    nodes = path_nodes(first, jumps, scratch)
    entered = nodes.select("source", "bucket", "cell_id").distinct().join(depth.hint("merge"), ["source", "cell_id"])
    # A piece is walked under the name of the cell where it is entered.
    placed = scratch.save(_in_tiles(solved, entered.withColumn("dest_cell", F.col("cell_id")).withColumn("back", F.lit(0).cast("bigint"))), "placed")
    scratch.forget_tables()
    walked = _per_tile(solved, placed, _piece_cells(solved.stencil), PIECE_SCHEMA)
    pieces = scratch.save(walked.withColumnRenamed("dest_cell", "node"), "pieces")
    on = nodes.select("source", "dest_cell", F.col("cell_id").alias("node"))
    if numbers is not None:
        named = numbers.select("path_id", F.col("cell_id").alias("dest_cell"))
        on = scratch.save(on.join(named, "dest_cell").select("path_id", "source", "node"), "named")
        return on.join(pieces.hint("merge"), ["source", "node"]).select("path_id", F.col("step").cast("int").alias("step"), "cell_id")
    return on.join(pieces.hint("merge"), ["source", "node"]).select("source", "dest_cell", "step", "cell_id")


def number_paths(reach: DataFrame, scratch: Scratch) -> DataFrame:
    """Give the reachable destinations path numbers 0, 1, ... by ``dest_id``."""
    known = reach.where("reachable").select("dest_id", "cell_id", "d")
    return numbered(known, ["dest_id"], scratch, "path_id")


def path_raster(cell_counts: DataFrame, meta: GridMeta, b: int) -> DataFrame:
    """Paths through each cell with a box of radius ``b`` around every path cell."""
    return dilate(cell_counts.select("cell_id", F.col("n").alias("value")), meta, b, "sum")


def path_lines(solved: CostTrees, numbered: DataFrame, anchor: str = "corner") -> DataFrame:
    """One line per path: ``path_id, dest_id, dest_cell, pts, wkt``.

    Every ``MARK_STEPS`` steps before it leaves a tile, a path has a mark. Only the *tail* up to the first mark is a path's own (or its
    destination cell's). The *body* from there to the tile's edge is walked once for each mark, and the line from the source to that edge
    is put together once for each cell where a tile is entered. So vertices are made in proportion to cells, and a whole line comes into
    being when its row is given out: a shuffle moves tails, and the line up to a mark once for each mark. A mark's tails start within
    ``MARK_STEPS`` steps of it, so no key is hot.
    """
    scratch, meta = solved.scratch, solved.meta
    jumps = jump_tables(hops(solved), scratch)
    depth = jumps[-1].select("source", "cell_id", F.col("steps").alias("last"))
    way = ["source", "cell_id"]

    def placed(cells: DataFrame) -> DataFrame:
        """Cells with their tile, where and after how many steps they leave it, and how many steps they are from the source."""
        return _in_tiles(solved, cells.join(jumps[0].hint("merge"), way).join(depth.hint("merge"), way))

    def walked(pieces: DataFrame, length, name: str) -> DataFrame:
        pieces = scratch.save(pieces.withColumn("length", length), "placed")
        return scratch.save(_per_tile(solved, pieces, _walks(solved.stencil), WALK_SCHEMA), name)

    steps, far = F.col("steps"), F.col("steps") >= MARK_STEPS
    to_edge = steps + F.when(F.col("next_cell") < 0, 1).otherwise(0)  # the source itself is a vertex
    first = goals(solved).join(numbered.select("cell_id"), "cell_id", "left_semi").select("source", "bucket", "cell_id")
    tails = walked(placed(first), F.when(far, steps % MARK_STEPS).otherwise(to_edge), "tails")
    marks = tails.where(far).select("source", "bucket", "tile", F.col("end_cell").alias("cell_id"), "next_cell", (steps - steps % MARK_STEPS).alias("steps"),
                                    (F.col("last") - steps % MARK_STEPS).alias("last")).distinct()
    entered = tails.where("next_cell >= 0").select("source", "bucket", F.col("next_cell").alias("dest_cell"), F.col("next_cell").alias("cell_id")).distinct()
    nodes = path_nodes(entered, jumps, scratch)
    between = walked(placed(nodes.select("source", "bucket", "cell_id").distinct()), to_edge, "between")
    bodies = walked(marks, to_edge, "bodies")
    scratch.forget_tables()

    def drawn(walks: DataFrame, *columns) -> DataFrame:
        def vertex(cell, step):
            x, y = cell_to_world(cell_row(cell, meta), cell_col(cell, meta), meta, anchor)
            return F.struct(step.alias("step"), x.alias("x"), y.alias("y"))
        pts = F.transform("cells", lambda cell, i: vertex(cell, F.col("last") - F.size("cells") + 1 + i))
        return walks.select(*columns, "last", pts.alias("pts"), F.nullif(vertices_text(pts), F.lit("")).alias("text"))

    def joined(before: str, after: str):
        return (F.concat(F.coalesce(before + "pts", F.array()), after + "pts").alias("pts"), F.concat_ws(", ", before + "text", after + "text").alias("text"))

    in_order = lambda name: F.transform(F.sort_array(F.collect_list(F.struct("last", name))), lambda piece: piece[name])
    to_tile = (nodes.select("source", "dest_cell", "cell_id").join(drawn(between, *way).hint("merge"), way).groupBy("source", "dest_cell")
                    .agg(F.flatten(in_order("pts")).alias("pts"), F.concat_ws(", ", in_order("text")).alias("text")))
    to_edge_of = to_tile.select("source", F.col("dest_cell").alias("next_cell"), F.col("pts").alias("before_pts"), F.col("text").alias("before_text"))
    to_mark = drawn(bodies, *way, "tile", "next_cell").join(to_edge_of, ["source", "next_cell"], "left")
    # A tail without a mark goes on where the next tile is entered.
    starts = (to_mark.select("source", "tile", F.col("cell_id").alias("end_cell"), *joined("before_", ""))
              .unionByName(to_tile.select("source", F.lit(-1).cast("bigint").alias("tile"), F.col("dest_cell").alias("end_cell"), "pts", "text"))
              .withColumnsRenamed({"pts": "before_pts", "text": "before_text"}))
    on = ["source", "tile", "end_cell"]
    ends = drawn(tails, "source", F.when(far, F.col("tile")).when(F.col("next_cell") >= 0, -1).alias("tile"), "end_cell", F.col("cell_id").alias("dest_cell"))
    numbers = numbered.select("path_id", "dest_id", F.col("cell_id").alias("dest_cell"))
    lines = (numbers.join(ends, "dest_cell").repartition(task_slots(numbered.sparkSession), *on)
                    .join(starts.hint("merge"), on, "left").select("path_id", "dest_id", "dest_cell", *joined("before_", "")))
    return lines.select("path_id", "dest_id", "dest_cell", "pts", F.concat(F.lit("LINESTRING ("), "text", F.lit(")")).alias("wkt"))


def lcpa_summary(reach: DataFrame, crossing: DataFrame) -> DataFrame:
    """Destinations, cells of all written paths, their cost.

    ``crossing`` is ``cell_id, n``, paths through each cell: every cell of a path counts in it once.
    Unreachable destinations count as destinations only.
    """
    cells = crossing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_path_cells"), F.lit(1).alias("_one"))
    known = reach.agg(F.count("*").alias("num_destinations"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("total_cost"), F.lit(1).alias("_one"))
    return known.join(cells, "_one").select("num_destinations", "total_path_cells", "total_cost")
